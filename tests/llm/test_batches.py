"""Workers get texts a little at a time, and give back what these needed."""

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import common, packing, simhash

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark, n=2000):
    return spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" word ")), 200).alias("text"))


def test_stored_holds_arrow_batches_to_their_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    before = spark.conf.get(KEY)
    got = common.stored(documents(spark).mapInArrow(common.giving_back(sizes), "n long, size long"), "sizes", 1 << 18).collect()
    assert spark.conf.get(KEY) == before
    assert sum(r["n"] for r in got) == 2000 and len(got) > 4 and max(r["size"] for r in got) < 1 << 19


def test_texts_go_to_workers_in_small_batches(spark, monkeypatch):
    seen, plain = {}, common.stored_at

    def recorded(df, name):
        seen[name] = df.sparkSession.conf.get(KEY)
        return plain(df, name)

    monkeypatch.setattr(common, "stored_at", recorded)
    docs = documents(spark, 50)
    assert packing.pack(docs).select("doc_id").distinct().count() == 50
    assert simhash.drop_near_duplicates(docs).count() > 0
    assert seen["pieces"] == seen["fingerprints"] == f"{common.TEXT_BATCH}b" != seen["numbered"]

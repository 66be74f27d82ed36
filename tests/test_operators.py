"""Ties, empty groups, nulls and the plans of some operators."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.fixed import clamp, div, leb128_size, round_shift, rounded_div
from tessera.operators import blocks as B
from tessera.operators import histograms as H
from tessera.operators import lookups as L
from tessera.operators import sequences as S
from tessera.streaming.slots import run_stream, slot_state

from .conftest import SF


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_fixed_point(spark):
    assert one(spark, round_shift(F.lit(-7), 1)) == -3
    assert one(spark, div(F.lit(-7), 2)) == -3
    assert one(spark, div(F.lit(-7), 0)) is None
    assert one(spark, rounded_div(F.lit(7), F.lit(2))) == 4
    assert one(spark, clamp(F.lit(300), 0, 255)) == 255
    for x, n in ((0, 1), (127, 1), (128, 2), (1 << 14, 3), ((1 << 56) - 1, 8), (1 << 56, 9)):
        assert one(spark, leb128_size(F.lit(x))) == n


def test_top_values_break_ties_by_value(spark):
    df = spark.createDataFrame([("a", v) for v in (3, 3, 1, 1, 2)], "k string, v int")
    assert rows(H.top_values(df, F.col("v"), "k", 2)) == [("a", 1, 1, 2), ("a", 2, 3, 2)]


def test_nearest_breaks_ties_by_index(spark):
    assert one(spark, L.nearest(F.lit(5), [4, 6]))["index"] == 0


def test_kmeans_keeps_empty_clusters(spark):
    hist = spark.createDataFrame([(1, 2), (2, 2)], "value long, n long")
    assert rows(L.kmeans_steps(hist, [1, 100], 2)) == [(0, 2, 4)]


def test_too_many_centroids_are_refused(spark):
    b = spark.range(300).select(F.col("id").alias("label"), F.array(F.lit(0)).cast("array<bigint>").alias("b"))
    with pytest.raises(ValueError):
        L.nearest_block(b.withColumnRenamed("label", "vec_id"), b)


def test_capped_bucket_keeps_the_first(spark):
    df = spark.createDataFrame([(1, i) for i in range(5)], "k long, at long")
    assert rows(L.capped_bucket_matches(df, df, F.col("k"), ["k"], ["at"], 2).select("n_kept", "n_probes", "n_matches")) == [(2, 5, 10)]


def test_first_interval(spark):
    events = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2024-01-01 00:00:00'), (2, TIMESTAMP_NTZ'2024-01-02 00:00:00'), (3, CAST(NULL AS TIMESTAMP_NTZ)) AS t(id, ts)")
    entries = spark.sql("SELECT * FROM VALUES (4, TIMESTAMP_NTZ'2023-12-31 23:00:00', TIMESTAMP_NTZ'2024-01-02 00:00:00'), (2, TIMESTAMP_NTZ'2024-01-01 00:00:00', TIMESTAMP_NTZ'2024-01-01 01:00:00') AS t(idx, start, end)")
    assert rows(L.first_interval(events, "ts", "id", entries)) == [(1, 2), (2, None), (3, None)]


def test_scan_order():
    assert B.SCAN[:6] == [0, 8, 1, 2, 9, 16]
    assert sorted(B.SCAN) == list(range(64))


def test_offsets_across_ranges(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("n"))
    got = {r["id"]: r["offset"] for r in S.offsets(df, "id", "n", 64).collect()}
    total = 0
    for i in range(1000):
        assert got[i] == total
        total += i % 7


def test_offsets_shuffle_no_rows_to_one_partition(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("n"))
    plan = S.offsets(df, "id", "n", 64)._jdf.queryExecution().executedPlan().toString()
    single = plan[plan.index("SinglePartition") :]
    assert "HashAggregate" in single


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, v int, id long")
    assert H.top_values(none, F.col("v"), "k", 2).count() == 0
    assert H.symbol_costs(none, "v", "k").count() == 0
    assert S.offsets(none, "id", "v", 8).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    streamed = run_stream(spark, str(tmp_path / "in"), str(tmp_path / "checkpoint"), "slots")
    assert rows(streamed) == rows(slot_state(events))


def test_pruned_scan(spark):
    from tessera.plans.catalogue import QUERIES

    plan = QUERIES["hist_values"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double>" in plan


def test_entry_without_llm(spark, monkeypatch):
    import sys

    import __spark_entry__ as entry

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name in ("tessera.llm", "corpus_pipeline"):
                raise ModuleNotFoundError(name, name=name)

    for name in [n for n in sys.modules if n.startswith(("tessera.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    assert "hist_values" in entry.queries()
    assert not any(n.startswith("op") for n in entry.queries())

"""Tables in the shared folder."""

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from tessera.llm import common

from ..conftest import ROOT


def test_no_local_folder_on_a_cluster():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_tables_are_deleted_at_the_end(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from tessera.llm.common import stored
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
assert stored(spark.range(5), "t").count() == 5
assert list(__import__("pathlib").Path({str(tmp_path)!r}).glob("tessera-t-*"))
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=240, capture_output=True)
    assert not list(Path(tmp_path).glob("tessera-t-*"))


def test_clashing_columns_of_token_files_and_packing(spark):
    from pyspark.sql import functions as F

    from tessera.llm import packing, tokenfiles

    docs = spark.createDataFrame([(2, "one two three"), (1, None), (None, ""), (1, "four")], "doc_id long, text string")
    names = ["shard", "segment", "first", "levels", "docs", "start", "n_tokens", "ids", "key", "part", "bin", "offset", "final", "moving", "piece", "length", "before", "n"]
    clashing = docs.select("*", *(F.lit(f"own {name}").alias(name) for name in names))
    one = lambda df: sorted(((r["doc_id"] or 0, r["n_tokens"]) for r in tokenfiles.read_tokens(tokenfiles.write_tokens(df)).collect()))
    assert one(clashing) == one(docs) and len(one(docs)) == 4
    packed = lambda df: sorted((r["doc_id"] or 0, r["length"]) for r in packing.pack(df).collect())
    assert packed(clashing) == packed(docs) and len(packed(docs)) == 4


def test_pool_pieces_move_and_the_rest_stays(spark):
    """Many small partitions: rounds of exchange need no more sequences, and each piece keeps its ids."""
    import numpy as np

    from tessera.llm import packing

    rng = np.random.default_rng(7)
    rows = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(rng.integers(1, 1500, 400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    small, whole = (packing.pack(docs, part_bytes=size).collect() for size in (40_000, 24 << 20))
    sequences = [len({r["sequence_id"] for r in x}) for x in (small, whole)]
    assert sequences[0] <= sequences[1] * 1.05 + 1
    assert {(r["doc_id"], r["piece"], bytes(r["ids"])) for r in small} == {(r["doc_id"], r["piece"], bytes(r["ids"])) for r in whole}
    for x in (small, whole):
        filled = {}
        for r in sorted(x, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == filled.get(r["sequence_id"], 0)
            filled[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(filled.values()) <= packing.CAPACITY


def test_a_task_with_too_many_partitions_is_refused(spark, monkeypatch):
    from tessera.llm import packing

    monkeypatch.setattr(packing, "WINDOW_BITS", 2)
    docs = spark.createDataFrame([(i, "some words of a text") for i in range(40)], "doc_id long, text string").coalesce(1)
    assert packing.packed_where_they_lie(docs, part_pieces=20).count() == 40
    with pytest.raises(Exception, match="smaller splits"):
        packing.packed_where_they_lie(docs, part_pieces=5).count()

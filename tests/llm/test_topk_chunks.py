"""Exact search in several chunks of broadcast queries, and components that are too large."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import topk


def test_chunks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BITS", 3)
    monkeypatch.setattr(topk, "BLOCK_BITS", 5)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 6))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    q = np.floor(256 * x).astype(int)
    want = []
    for i in range(0, 500, 10):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(500) if j != i)[:2]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, k=2, chunk_blocks=3).collect())
    assert got == want


@pytest.mark.parametrize("large", [1e8, 1e30])
def test_large_components_are_refused(spark, large):
    df = spark.createDataFrame([(0, [large, 1.0]), (1, [large, large])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(df, F.col("vec_id") % 50 == 0)


def test_components_up_to_the_bound_are_exact(spark):
    df = spark.createDataFrame([(0, [1e6, -1e6]), (1, [1e6 - 1, -1e6]), (2, [-1e6, 1e6])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    one = 256 * 10**6
    assert got == [(0, 1, 1, one * (one - 256) + one * one), (0, 2, 2, -2 * one * one)]

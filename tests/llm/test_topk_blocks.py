"""Exact search where nearly all entries pass the threshold, over blocks of mixed lengths, and with few classes."""

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, topk


def best_of(x, queries, k):
    q = np.floor(256 * np.asarray(x)).astype(np.int64)
    scores = q @ q.T
    return [(i, n + 1, j, -s) for i in queries for n, (s, j) in enumerate(sorted((-int(scores[i, j]), j) for j in range(len(q)) if j != i)[:k])]


def test_what_is_stored_has_no_rows_of_entries(spark, monkeypatch):
    plain, longest, rows = common.stored_at, {}, {}

    def recorded(df, name):
        table, path = plain(df, name)
        sizes = [F.size(c) for c, kind in table.dtypes if kind.startswith("array")]
        found = table.agg(F.max(reduce(lambda a, b: a + b, sizes, F.lit(0))), F.count("*")).first()
        longest[name], rows[name] = found[0] or 0, found[1]
        return table, path

    monkeypatch.setattr(common, "stored_at", recorded)
    monkeypatch.setattr(topk, "stored_at", recorded, raising=False)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1, 8)) + 0.05 * rng.normal(size=(3000, 8))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=2).collect())
    assert got == best_of(x, range(0, 3000, 20), 2)
    assert max(longest.values()) <= 8 + 3, longest
    assert max(rows.values()) <= 3000, rows


@pytest.mark.parametrize("lists", [3, 4])
def test_fewer_classes_than_asked_for(spark, lists):
    x = [[1.0, 0.5, -1.0, 0.25], [-1.0, 0.5, 0.5, 0.0], [-2.0, -0.5, 0.5, 0.0]]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, k=5, lists=lists).collect())
    assert got == best_of(x, [0], 5)


def test_blocks_hold_every_row_once_and_no_more_than_allowed(spark, monkeypatch):
    monkeypatch.setattr(topk, "HELD", 60)
    rows = [(i, -i, [(-1) ** j * (i * 7**j) for j in range(i % 9)]) for i in range(500)] + [(500, -500, [2**40] * 100)]
    df = spark.createDataFrame(rows, "id long, value long, v array<bigint>").repartition(2)
    found = []
    for r in topk._in_blocks(df, 3, ("ids", "values", "flat")).collect():
        assert 0 < len(r["ids"]) <= 8 and (len(r["ids"]) == 1 or len(r["ids"]) * r["dim"] <= 60)
        found += zip(r["ids"], r["values"], topk._matrix(bytes(r["flat"]), len(r["ids"]), r["dim"]).tolist(), strict=True)
    assert sorted(found) == rows


@pytest.mark.parametrize("most", [1, 10**3, 10**5, 10**8])
def test_partial_scores_are_exact_in_every_type(most):
    rng = np.random.default_rng(most)
    q, c = rng.integers(-most, most, (150, 6), endpoint=True), rng.integers(-most, most, (40, 6), endpoint=True)
    row = {"dim": 6, "qgids": np.arange(150), "gids": np.arange(40), "qflat": q.tobytes(), "flat": c.tobytes()}
    for some, parts in topk._partial_scores(row, 2):
        for part, of in zip(parts, (slice(0, 3), slice(3, 6)), strict=True):
            want = q[some, of] @ c[:, of].T
            assert (part.astype(np.int64) == want).all()
            least = want[:, 7] + np.arange(len(want)) % 3 - 1
            assert (topk._at_least(part, least) == (want >= least[:, None])).all()
            assert not topk._at_least(part, np.full(len(want), 2**62)).any() and topk._at_least(part, np.full(len(want), -(2**61))).all()

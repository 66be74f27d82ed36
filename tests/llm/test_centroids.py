"""Clustering by bounds against plain Python integers; bounds spare scans; ties, copies and what takes no part."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import centroids


def plain(rows, k, rounds, scale, seed=1):
    vectors = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in vectors if i is not None)
    cents = [v for _, v in order[:k]]
    distance = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    for r in range(rounds + 1):
        of = [min(range(len(cents)), key=lambda j: (distance(v, cents[j]), j)) for _, v in vectors]
        if r < rounds:
            for j in range(len(cents)):
                mine = [v for (_, v), o in zip(vectors, of, strict=True) if o == j]
                if mine:
                    cents[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((str(i), o, distance(v, cents[o])) for (i, v), o in zip(vectors, of, strict=True))), cents


def clustered(seed, n, dim, groups):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 4
    return [(i, (centres[i % groups] + rng.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("k", "rounds"), [(1, 2), (7, 0), (7, 6), (40, 3)])
def test_against_plain_python(spark, k, rounds):
    rows = clustered(k, 240, 5, 6) + [(500 + i, [1.0, -1.0, 0.5, 0.0, 2.0]) for i in range(40)] + [(None, [0.1] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({n: F.lit("own") for n in ("v", "cluster", "upper", "lower", "distance")}).repartition(5)
    found = centroids.cluster(df, k, rounds, dim=5, scale=8)
    want, cents = plain(rows, k, rounds, 8)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in found.members.collect()) == want
    assert found.centroids == cents


def test_bounds_spare_scans(spark):
    rows = clustered(2, 600, 8, 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = centroids.cluster(df, 5, 6, dim=8, scale=64)
    assert found.members.filter("scanned").count() <= 200  # the rest is known by its bounds
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in found.members.collect()) == plain(rows, 5, 6, 64)[0]


def test_what_takes_no_part_and_ties(spark):
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [1.0]), (6, [math.nan, 0.0]), (7, [None, 0.0]), (8, [math.inf, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = centroids.cluster(df, 3, 2, dim=2, scale=1)
    assert sorted(r["vec_id"] for r in found.members.collect()) == [1, 1, 2, 3]
    want, _ = plain([r for r in rows if r[0] <= 3], 3, 2, 1)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in found.members.collect()) == want
    assert centroids.cluster(df.limit(0), 3, 2, dim=2) is None
    with pytest.raises(ValueError, match="62 bits"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), 1, 1, dim=2)


def test_bounds_hold_after_drift():
    rng = np.random.default_rng(3)
    v = rng.integers(-60, 60, (2000, 6))
    old, new = rng.integers(-40, 40, (9, 6)), None
    cluster, distance, lower = centroids._scan(v, old)
    upper = np.sqrt(distance) * (1 + centroids.SLACK)
    for step in range(4):
        new = old + rng.integers(-3, 4, old.shape) * (step % 3)
        drift, half = centroids._drifts(old, new)
        cluster, distance, upper, lower, scanned = centroids.reassigned(v, cluster, upper, lower, new, drift, half)
        d = centroids.squared(v, new)
        assert (cluster == d.argmin(axis=1)).all()
        own = np.sqrt(d[np.arange(len(v)), cluster])
        assert (upper >= own).all()
        d[np.arange(len(v)), cluster] = 1 << 60
        assert (lower <= np.sqrt(d.min(axis=1))).all()
        assert step != 0 or not scanned.all()
        old = new


def test_large_components_are_exact():
    v = np.array([[1 << 28, -(1 << 28)], [(1 << 28) - 1, 5]])
    assert centroids.squared(v, v[:1]).tolist() == [[0], [1 + (5 + (1 << 28)) ** 2]]

"""Operator 11, centroid clustering with Hamerly's bounds, exact on integer vectors.

A stored row per vector holds its cluster, an upper bound of the distance to its own centroid and a lower bound of the
distance to all others. When centroids move, the upper bound grows by its centroid's drift and the lower one shrinks by
the largest drift of any other. While the upper bound is less than the lower one, or than half the way from its centroid to the
nearest other, the vector stays where it is and no distance is computed. Otherwise its exact distance makes the upper
bound tight, and if that doesn't settle it, the vector is ambiguous and scanned in full. Scans use integers, so ties are
seen and go to the smaller number; bounds are widened by more than their rounding.

Centroids (k times the dimension) and their sums are what reaches the driver and goes out to tasks, however many vectors
there are. Sums are formed within tasks before they are shuffled. Each round reads the last one's table and writes its
own, after which the last one is deleted.

Edge cases: vectors that are null, of another length, or hold nulls, NaN or infinities take no part; repeated ids are
rows of their own; rows without an id are clustered but never chosen as a first centroid; of equal vectors among the
first centroids the smaller number gets all; with fewer than k vectors there are as few centroids; an empty table gives an
empty result; other columns are not carried. Components so large that distances or sums may need more than 62 bits raise a
ValueError before the first round.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored_at

#: Relative width that bounds are loosened by, beyond all rounding of double arithmetic on them.
SLACK = 1e-9
STATE = "vec_id {kind}, v array<bigint>, cluster int, distance bigint, upper double, lower double, scanned boolean"


class Clusters(NamedTuple):
    """(vec_id, v, cluster, distance, upper, lower, scanned) of every vector, and the centroids that they were assigned to."""

    members: DataFrame
    centroids: list[list[int]]


def integer_vectors(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, v array<bigint>) of the rows that take part: floor(scale * x) of each component, as double."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter((F.size("embedding") == dim) & F.coalesce(whole, F.lit(False)))
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x)).alias("v"))


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of v to all rows of c."""
    most = float(np.abs(v).max(initial=0)) + float(np.abs(c).max(initial=0))
    if most * most * max(1, v.shape[1]) < 2**52:  # then sums of products are exact in floating point
        v, c = v.astype(np.float64), c.astype(np.float64)
        return ((v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((v - one) ** 2).sum(axis=1) for one in c], axis=1)


def own_squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of v to the same row of c."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def _scan(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties to the smaller number), its squared distance, and the root of the second least, as a lower bound."""
    d = squared(v, centroids)
    cluster = d.argmin(axis=1)
    least = np.take_along_axis(d, cluster[:, None], 1)[:, 0]
    np.put_along_axis(d, cluster[:, None], np.iinfo(np.int64).max, 1)
    second = np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - SLACK) if d.shape[1] > 1 else np.full(len(v), np.inf)
    return cluster, least, second


def reassigned(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray, half: np.ndarray) -> tuple:
    """(cluster, distance, upper, lower, scanned) after the centroids have drifted. half: half the way to the nearest other one."""
    first, second = (np.sort(drift)[::-1].tolist() + [0.0, 0.0])[:2]
    upper = (upper + drift[cluster]) * (1 + SLACK)
    lower = (lower - np.where((drift[cluster] == first), second if (drift == first).sum() == 1 else first, first)) * (1 - SLACK)
    distance, scanned = np.full(len(v), -1, np.int64), np.zeros(len(v), bool)
    safe = np.maximum(lower, half[cluster])
    near = np.flatnonzero(~(upper < safe))
    distance[near] = own_squared(v[near], centroids[cluster[near]])
    upper[near] = np.sqrt(distance[near].astype(np.float64)) * (1 + SLACK)
    ambiguous = near[~(upper[near] < safe[near])]
    if len(ambiguous):
        cluster[ambiguous], distance[ambiguous], lower[ambiguous] = _scan(v[ambiguous], centroids)
        upper[ambiguous] = np.sqrt(distance[ambiguous].astype(np.float64)) * (1 + SLACK)
        scanned[ambiguous] = True
    return cluster, distance, upper, lower, scanned


def _drifts(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid moved at most, and half its way to the nearest other one at least."""
    drift = np.sqrt(own_squared(new, old).astype(np.float64)) * (1 + SLACK)
    apart = squared(new, new).astype(np.float64)
    np.fill_diagonal(apart, np.inf)
    return drift, np.sqrt(apart.min(axis=1)) / 2 * (1 - SLACK)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _assign(rows: DataFrame, centroids: list[list[int]], before: list[list[int]] | None, last: bool) -> DataFrame:
    """The state of all rows for the given centroids; before: those that the rows' bounds are for. last: with all distances."""
    dim, kind = len(centroids[0]), dict(rows.dtypes)["vec_id"]
    now = np.array(centroids, np.int64)
    moved = _drifts(np.array(before, np.int64), now) if before else None

    def assign(batches):
        for batch in batches:
            v = _matrix(batch.column("v"), dim)
            if moved is None:
                cluster, distance, lower = _scan(v, now)
                upper, scanned = np.sqrt(distance.astype(np.float64)) * (1 + SLACK), np.ones(len(v), bool)
            else:
                given = [batch.column(n).to_numpy(zero_copy_only=False).copy() for n in ("cluster", "upper", "lower")]
                cluster, distance, upper, lower, scanned = reassigned(v, *given, now, *moved)
            if last:
                missing = np.flatnonzero(distance < 0)
                distance[missing] = own_squared(v[missing], now[cluster[missing]])
            columns = [batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(upper), pa.array(lower), pa.array(scanned)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "cluster", "distance", "upper", "lower", "scanned"])

    return rows.mapInArrow(assign, STATE.format(kind=kind))


def _means(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Floor of each cluster's componentwise mean; an empty cluster keeps its centroid."""
    dim, k = len(centroids[0]), len(centroids)

    def sums(batches):
        total, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            cluster, v = batch.column("cluster").to_numpy(), _matrix(batch.column("v"), dim)
            np.add.at(n, cluster, 1)
            np.add.at(total, cluster, v)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = state.select("cluster", "v").mapInArrow(sums, "cluster int, n bigint, sums array<bigint>")
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dim))).alias("sums")).collect()
    means = {r["cluster"]: [s // r["n"] for s in r["sums"]] for r in found}
    return [means.get(i, c) for i, c in enumerate(centroids)]


def _check_size(rows: DataFrame, dim: int) -> None:
    """Raises if a squared distance, or a sum over all rows, may need more than 62 bits."""
    found = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("most"), F.count("*").alias("n")).first()
    most = found["most"] or 0.0
    if 4 * most * most * dim >= 2**62 or most * found["n"] >= 2**62:
        raise ValueError("components are so large that distances or sums may need more than 62 bits")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> Clusters | None:
    """Clusters of the vectors with ``dim`` components after ``rounds`` rounds; None if there are no vectors.

    First centroids are the ``k`` vectors with the least sha256 of ``seed:vec_id``.
    """
    rows, at = stored_at(integer_vectors(vectors, dim, scale), "vectors")
    _check_size(rows, dim)
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = [r["v"] for r in rows.filter("vec_id IS NOT NULL").orderBy(place, "v").limit(k).collect()]
    if not centroids:
        return None
    before = None
    for step in range(rounds + 1):
        new, new_at = stored_at(_assign(rows, centroids, before, step == rounds), f"clusters-{step}")
        discard(rows.sparkSession, at)
        rows, at = new, new_at
        if step < rounds:
            before, centroids = centroids, _means(rows, centroids)
    return Clusters(rows, centroids)

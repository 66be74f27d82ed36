"""Prediction, blending, displacement and small-network operators on 8 x 8 integer blocks, within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import clamp, div
from .blocks import N, shifted, total


def squared_error(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


INNER = [(r, c) for r in range(1, N) for c in range(1, N)]


def best_predictor(blocks: DataFrame) -> DataFrame:
    """(vec_id, mode, sse): the inner cells predicted from the first row and column, least error, ties to the first.

    Modes: 0 mean of both, 1 the column's first cell, 2 the row's first cell, 3 the one of left, above and corner
    nearest to left + above - corner (in that order).
    """
    b = F.col("b")
    mean = div(sum((b[c] for c in range(2, N)), b[1]) + sum((b[r * N] for r in range(2, N)), b[N]), 2 * N - 2)

    def paeth(r: int, c: int) -> Column:
        left, above, corner = b[r * N], b[c], b[0]
        base = left + above - corner
        options = F.array(*(F.struct(F.abs(base - x).alias("d"), F.lit(i).alias("i"), x.alias("x")) for i, x in enumerate((left, above, corner))))
        return F.array_min(options)["x"]

    modes = [lambda r, c: mean, lambda r, c: b[c], lambda r, c: b[r * N], paeth]
    inner = F.array(*(b[r * N + c] for r, c in INNER))
    errors = F.array(*(F.struct(squared_error(inner, F.array(*(mode(r, c) for r, c in INNER))).alias("sse"), F.lit(i).alias("mode")) for i, mode in enumerate(modes)))
    return blocks.select("vec_id", F.array_min(errors).alias("x")).select("vec_id", "x.mode", "x.sse")


def blended(pairs: DataFrame, mask: list[int]) -> DataFrame:
    """(vec_id, other_id, b): cell by cell (m a + (64 - m) b + 32) >> 6."""
    m = F.array(*map(F.lit, mask))
    both = F.zip_with(F.zip_with("b", m, lambda x, w: x * w), F.zip_with("other", m, lambda y, w: y * (F.lit(64) - w)), lambda x, y: F.shiftright(x + y + 32, 6))
    return pairs.select("vec_id", "other_id", both.alias("b"))


def displacement(pairs: DataFrame, reach: int) -> DataFrame:
    """(vec_id, dr, dc, sad): where ``other``, moved by up to ``reach`` with its edges repeated, is most like ``b``."""
    steps = range(-reach, reach + 1)
    sad = lambda dr, dc: total(F.zip_with("b", shifted("other", dr, dc, True), lambda x, y: F.abs(x - y)))
    options = F.array(*(F.struct(sad(dr, dc).alias("sad"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in steps for dc in steps))
    return pairs.select("vec_id", F.array_min(options).alias("x")).select("vec_id", "x.dr", "x.dc", "x.sad")


def luma_residual(blocks: DataFrame) -> DataFrame:
    """(vec_id, mean, ac): sums of 2 x 2 cells less their rounded mean."""
    b = F.col("b")
    sums = F.array(*(b[r * N + c] + b[r * N + c + 1] + b[r * N + N + c] + b[r * N + N + c + 1] for r in range(0, N, 2) for c in range(0, N, 2)))
    rows = blocks.select("vec_id", sums.alias("s")).withColumn("mean", F.shiftright(total(F.col("s")) + 8, 4))
    return rows.select("vec_id", "mean", F.transform("s", lambda x: x - F.col("mean")).alias("ac"))


def dense(blocks: DataFrame, weights: list[list[int]]) -> DataFrame:
    """(vec_id, label, out): one layer with rectified outputs."""
    w = F.array(*(F.array(*map(F.lit, row)) for row in weights))
    return blocks.select("vec_id", "label", F.transform(w, lambda row: F.greatest(total(F.zip_with("b", row, lambda x, y: x * y)), F.lit(0))).alias("out"))


def smoothed_edge(blocks: DataFrame, edge: int, blimit: int, most: int) -> DataFrame:
    """(vec_id, n, moved): rows whose samples next to a vertical edge are close enough to be smoothed, and by how much."""
    b = F.col("b")
    rows = []
    for r in range(N):
        p1, p0, q0, q1 = (b[r * N + edge + i] for i in (-2, -1, 0, 1))
        near = F.abs(p0 - q0) * 2 + F.shiftright(F.abs(p1 - q1), 1) <= blimit
        rows.append(F.when(near, clamp(F.shiftright((q0 - p0) * 3 + (p1 - q1) + 4, 3), -most, most)))
    moves = blocks.select("vec_id", F.filter(F.array(*rows), lambda x: x.isNotNull()).alias("m"))
    return moves.select("vec_id", F.size("m").cast("bigint").alias("n"), total(F.transform("m", F.abs)).alias("moved"))


def cell_votes(blocks: DataFrame, colours: int) -> DataFrame:
    """(label, score, n): of each cell's neighbours, left counts 2, above 2, above left 1 for their colour; the best
    colour's score."""
    rows = blocks.select("label", F.transform("b", lambda x: F.pmod(F.shiftright(x, 7), F.lit(colours))).alias("k"))
    moves = [(0, -1, 2), (-1, 0, 2), (-1, -1, 1)]
    k = F.col("k")

    def score(r: int, c: int) -> Column:
        near = [(k[(r + dr) * N + c + dc], w) for dr, dc, w in moves if r + dr >= 0 and c + dc >= 0]
        if not near:
            return F.lit(0)
        each = [sum((F.when(k2 == of, w).otherwise(0) for k2, w in near[1:]), F.when(near[0][0] == of, near[0][1]).otherwise(0)) for of, _ in near]
        return F.greatest(*each) if len(each) > 1 else each[0]

    scores = F.array(*(score(r, c) for r in range(N) for c in range(N)))
    return rows.select("label", F.explode(scores).alias("score")).groupBy("label", "score").agg(F.count("*").alias("n"))

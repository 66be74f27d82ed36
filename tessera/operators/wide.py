"""Wider forms of block operators: any pair of kernels, small networks, colour contexts, recentred codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .blocks import N, node_sums, total


def recentred(value: Column, reference: Column, size: int) -> Column:
    """0 for ``reference``, then by distance from it, above before below, the rest in order; values are below ``size``."""
    upper = reference * 2 > size
    x, r = F.when(upper, F.lit(size - 1) - value).otherwise(value), F.when(upper, F.lit(size - 1) - reference).otherwise(reference)
    return F.when(x > r * 2, x).when(x >= r, (x - r) * 2).otherwise((r - x) * 2 - 1).cast("bigint")


def both_sides(b: Column, side: int, down: list[list[float]], across: list[list[float]], kind: str) -> Column:
    """D b At of a square block of ``side``, by rows: D ``down`` its columns, A ``across`` its rows."""
    constant = lambda m: F.array(*(F.array(*(F.lit(x).cast(kind) for x in row)) for row in m))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0).cast(kind), lambda s, v: s + v)
    places = F.array(*map(F.lit, range(side)))
    rows = lambda given: F.transform(places, lambda r: F.slice(given, r * side + 1, side))
    columns = lambda given: let(given, lambda g: F.transform(places, lambda c: F.transform(g, lambda row: F.get(row, c))))
    times_rows = lambda given, m: F.transform(given, lambda row: F.transform(constant(m), lambda of: dot(row, of)))
    return F.flatten(columns(times_rows(columns(times_rows(rows(b), across)), down)))


#: Places of a block's cell and the eight around it, edges repeated, by rows.
NEAR = [[min(max(r + dr, 0), N - 1) * N + min(max(c + dc, 0), N - 1) for dr in (-1, 0, 1) for dc in (-1, 0, 1)] for r in range(N) for c in range(N)]


def scored_by_network(blocks: DataFrame, convolution: list[list[int]], head: list[list[int]]) -> DataFrame:
    """``blocks`` with ``score``: 3 x 3 convolutions with edges repeated, rectified, summed over quarters, and a dense head."""
    near = F.array(*(F.array(*map(F.lit, places)) for places in NEAR))

    def pooled(b: Column, taps: list[int]) -> Column:
        weights = F.array(*(F.lit(w).cast("bigint") for w in taps))
        cells = F.transform(near, lambda places: F.greatest(total(F.zip_with(places, weights, lambda i, w: F.get(b, i) * w)), F.lit(0)))
        return let(cells, lambda given: F.transform(node_sums(given, N // 2), lambda node: F.shiftright(node["s"], 4)))

    def score(b: Column) -> Column:
        scores = [total(F.zip_with(pooled(b, taps), F.array(*map(F.lit, w)), lambda x, y: x * y)) for taps, w in zip(convolution, head, strict=True)]
        return sum(scores[1:], scores[0])

    return blocks.withColumn("score", let(F.col("b"), score))


def colour_contexts(rows: DataFrame, by: str, colours: str, n: int) -> DataFrame:
    """(by, context, place) of each inner cell: votes of left (2), above (2) and above left (1), the best one's plus twice the
    others'; the place of its own colour in order of votes, ties to the lower, one past the last if it has none."""
    inner = F.array(*(F.lit(r * N + c) for r in range(1, N) for c in range(1, N)))

    def cell(k: Column, i: Column) -> Column:
        vote = lambda of: sum((F.when(F.get(k, i - back) == of, w).otherwise(0) for back, w in ((N, 2), (N + 1, 1))), F.when(F.get(k, i - 1) == of, 2).otherwise(0))
        votes = F.array_sort(F.filter(F.array(*(F.struct((-vote(of)).alias("v"), F.lit(of).alias("colour")) for of in range(n))), lambda x: x["v"] < 0))

        def of_order(o: Column) -> Column:
            own = F.array_position(F.transform(o, lambda x: x["colour"]), F.get(k, i).cast("int")).cast("int")
            return F.struct((F.aggregate(o, F.lit(0), lambda s, x: s - x["v"] * 2) + o[0]["v"]).alias("context"), F.when(own == 0, n + 1).otherwise(own).alias("place"))

        return let(votes, of_order)

    cells = let(F.col(colours), lambda k: F.transform(inner, lambda i: cell(k, i)))
    return rows.select(by, F.explode(cells).alias("x")).select(by, "x.context", "x.place")

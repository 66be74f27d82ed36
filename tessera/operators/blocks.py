"""Operators on 8 x 8 integer blocks held as arrays: pairs, transforms, quantisation, stencils, roll-ups.

Each works within the row, so no cell is ever shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import let
from ..functions.fixed import clamp, div, round_shift

N = 8
#: Diagonal scan: along r + c; even diagonals by ascending row, odd ones by descending row.
SCAN = sorted(range(64), key=lambda i: (i // N + i % N, (i // N) * (1 if (i // N + i % N) % 2 == 0 else -1)))


def total(a: Column, kind: str = "bigint") -> Column:
    return F.aggregate(a, F.lit(0).cast(kind), lambda s, x: s + x)


def neighbours(blocks: DataFrame, group: int) -> DataFrame:
    """(vec_id, label, other_id, b, other): each block with the next of its label among ``group`` consecutive ids."""
    order = Window.partitionBy("label", div(F.col("vec_id"), group)).orderBy("vec_id")
    pairs = blocks.withColumn("next", F.lead(F.struct("vec_id", "b")).over(order)).filter("next IS NOT NULL")
    return pairs.select("vec_id", "label", F.col("next.vec_id").alias("other_id"), "b", F.col("next.b").alias("other"))


def block_errors(pairs: DataFrame) -> DataFrame:
    """(vec_id, other_id, sad, sse, variance) of pairs of blocks."""
    d = pairs.select("vec_id", "other_id", F.zip_with("b", "other", lambda x, y: x - y).alias("d"))
    d = d.select("vec_id", "other_id", total(F.transform("d", F.abs)).alias("sad"), total(F.transform("d", lambda x: x * x)).alias("sse"), total(F.col("d")).alias("s"))
    return d.select("vec_id", "other_id", "sad", "sse", (F.col("sse") - F.shiftright(F.col("s") * F.col("s"), 6)).alias("variance"))


def transformed(blocks: DataFrame, matrix: list[list[float]] | list[list[int]], kind: str, rows_too: bool = True, out: str = "t") -> DataFrame:
    """Adds ``out`` = M b Mt (or b Mt, each row alone) as a flat array."""
    m = F.array(*(F.array(*(F.lit(x).cast(kind) for x in row)) for row in matrix))
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q), kind)
    places = F.array(*map(F.lit, range(N)))
    product = lambda rows: F.transform(rows, lambda row: F.transform(m, lambda of: dot(row, of)))
    turned = lambda rows: let(rows, lambda given: F.transform(places, lambda i: F.transform(given, lambda row: F.get(row, i))))
    rows = let(F.col("b"), lambda b: F.transform(places, lambda r: F.transform(F.slice(b, r * N + 1, N), lambda x: x.cast(kind))))
    lines = product(rows)
    return blocks.withColumn(out, F.flatten(turned(product(turned(lines))) if rows_too else lines))


HADAMARD = [[-1 if (i & j).bit_count() % 2 else 1 for j in range(N)] for i in range(N)]
DCT = [[math.sqrt((1 if k == 0 else 2) / N) * math.cos((2 * i + 1) * k * math.pi / (2 * N)) for i in range(N)] for k in range(N)]


def quantised(x: Column, i: Column, zbin: tuple[int, int], rounding: tuple[int, int], quant: tuple[int, int], shift: tuple[int, int]) -> Column:
    """Dead-zone quantiser; the first of each pair is for place 0."""
    of = lambda pair: F.when(i == 0, F.lit(pair[0])).otherwise(F.lit(pair[1])).cast("bigint")
    t = clamp(F.abs(x) + of(rounding), -32768, 32767) * 32
    q = F.shiftright((F.shiftright(t * of(quant), 16) + t) * of(shift), 21)
    return F.when(F.abs(x) < of(zbin), F.lit(0)).otherwise(F.when(x < 0, -q).otherwise(q)).cast("bigint")


def last_nonzero(levels: Column, order: list[int] = range(64)) -> Column:
    """Place after the last non-zero level in the given order; 0 if all are zero."""
    return F.greatest(F.lit(0), *(F.when(levels[i] != 0, F.lit(n + 1)).otherwise(F.lit(0)) for n, i in enumerate(order))).cast("bigint")


def shifted(b: str, dr: int, dc: int, clamped: bool) -> Column:
    """The block moved by (dr, dc): what lies outside is the nearest cell, or 0."""
    near = lambda x: min(max(x, 0), N - 1)
    inside = lambda r, c: clamped or (0 <= r < N and 0 <= c < N)
    places = F.array(*(F.lit(near(r + dr) * N + near(c + dc) if inside(r + dr, c + dc) else None).cast("int") for r in range(N) for c in range(N)))
    return let(F.col(b), lambda given: F.transform(places, lambda i: F.coalesce(F.get(given, i), F.lit(0).cast("bigint"))))


def added(arrays: list[Column]) -> Column:
    out = arrays[0]
    for a in arrays[1:]:
        out = F.zip_with(out, a, lambda x, y: x + y)
    return out


def times(a: Column, factor: int) -> Column:
    return F.transform(a, lambda x: x * factor)


def box_sums(blocks: DataFrame, reach: int = 2) -> DataFrame:
    """Replaces ``b`` by sums over (2 reach + 1)² cells, those outside 0; one direction after the other."""
    steps = range(-reach, reach + 1)
    rows = blocks.withColumn("b", added([shifted("b", 0, d, False) for d in steps]))
    return rows.withColumn("b", added([shifted("b", d, 0, False) for d in steps]))


def separable_filter(blocks: DataFrame, taps: list[int], bits: int) -> DataFrame:
    """Replaces ``b`` by its filtered form, edges repeated, rounded after each direction."""
    reach = len(taps) // 2
    for dr, dc in ((0, 1), (1, 0)):
        moved = [times(shifted("b", dr * d, dc * d, True), t) for d, t in zip(range(-reach, reach + 1), taps, strict=True)]
        blocks = blocks.withColumn("b", F.transform(added(moved), lambda x: round_shift(x, bits)))
    return blocks


INTERIOR = [r * N + c for r in range(1, N - 1) for c in range(1, N - 1)]


def gradients(b: Column) -> Column:
    """Array of structs (dx, dy) of central differences at the inner cells."""
    return F.array(*(F.struct((b[i + 1] - b[i - 1]).alias("dx"), (b[i + N] - b[i - N]).alias("dy")) for i in INTERIOR))


def gradient_histogram(blocks: DataFrame) -> DataFrame:
    """(label, bin, total): magnitudes by slope in 8 bins; a vertical slope counts half in the first and last bin."""
    g = blocks.select("label", F.explode(gradients(F.col("b"))).alias("g")).select("label", "g.dx", "g.dy", (F.abs("g.dx") + F.abs("g.dy")).alias("m"))
    flat = F.array(F.struct(F.lit(0).cast("bigint").alias("bin"), div(F.col("m"), 2).alias("w")), F.struct(F.lit(7).cast("bigint").alias("bin"), div(F.col("m"), 2).alias("w")))
    slope = F.array(F.struct(clamp(div(F.col("dy") * 4, F.col("dx")) + 4, 0, 7).alias("bin"), F.col("m").alias("w")))
    parts = g.select("label", F.explode(F.when(F.col("dx") == 0, flat).otherwise(slope)).alias("x"))
    return parts.groupBy("label", F.col("x.bin").alias("bin")).agg(F.sum("x.w").alias("total"))


def line_of(direction: int, r: int, c: int) -> int:
    """Line that a cell lies on. Directions turn in 8 steps: while the first four go along the columns, a line moves from
    row to row by 1, 1/2, 0, -1/2 rows a column; the others likewise from column to column by -1, -1/2, 0, 1/2 a row."""
    (along, across), halves = ((c, r), 2 - direction) if direction < 4 else ((r, c), direction - 6)
    return across + (abs(halves) * along // 2) * (1 if halves > 0 else -1)


def direction_costs(b: Column) -> Column:
    """Array of 8: sum over a direction's lines of (sum of cells)² * 840 / cells."""

    def cost(direction: int) -> Column:
        groups: dict[int, list[int]] = {}
        for i in range(64):
            groups.setdefault(line_of(direction, i // N, i % N), []).append(i)
        sums = [(sum((b[i] for i in g[1:]), b[g[0]]), 840 // len(g)) for g in groups.values()]
        terms = [s * s * F.lit(w) for s, w in sums]
        return sum(terms[1:], terms[0])

    return F.array(*map(cost, range(8)))


def dominant_direction(blocks: DataFrame) -> DataFrame:
    """(vec_id, direction, gap): direction of greatest cost, ties to the lowest; its lead over the one across, >> 10."""
    costs = blocks.select("vec_id", direction_costs(F.col("b")).alias("k"))
    best = costs.withColumn("direction", F.array_position("k", F.array_max("k")).cast("int") - 1)
    return best.select("vec_id", "direction", F.shiftright(F.array_max("k") - F.col("k")[(F.col("direction") + 4) % 8], 10).alias("gap"))


def node_sums(b: Column, side: int) -> Column:
    """Array of structs (node, s, ss) of the squares of ``side`` cells; nodes are numbered by rows."""
    nodes = []
    for node in range((N // side) ** 2):
        r0, c0 = node // (N // side) * side, node % (N // side) * side
        x = [b[(r0 + r) * N + c0 + c] for r in range(side) for c in range(side)]
        nodes.append(F.struct(F.lit(node).alias("node"), sum(x[1:], x[0]).alias("s"), sum((y * y for y in x[1:]), x[0] * x[0]).alias("ss")))
    return F.array(*nodes)


def variance_rollup(blocks: DataFrame) -> DataFrame:
    """(vec_id, side, node, variance) at sides 2, 4 and 8, in 1/256."""

    def level(side: int) -> Column:
        return F.transform(node_sums(F.col("b"), side), lambda x: F.struct(F.lit(side).alias("side"), x["node"].alias("node"), _variance(x, side).alias("variance")))

    return blocks.select("vec_id", F.explode(F.concat(*map(level, (2, 4, 8)))).alias("x")).select("vec_id", "x.side", "x.node", "x.variance")


def _variance(x: Column, side: int) -> Column:
    bits = 2 * (side.bit_length() - 1)
    return F.shiftright((x["ss"] - F.shiftright(x["s"] * x["s"], bits)) * 256, bits)


def split_costs(blocks: DataFrame, signal: int) -> DataFrame:
    """(vec_id, cost, split_8, n_split_4): bottom-up choice between a square whole and its four quarters plus ``signal``."""
    whole = lambda side: F.transform(node_sums(F.col("b"), side), lambda x: x["ss"] - F.shiftright(x["s"] * x["s"], 2 * (side.bit_length() - 1)))
    df = blocks.select("vec_id", whole(2).alias("c2"), whole(4).alias("c4"), whole(8)[0].alias("c8"))
    quarters = [[(2 * R + r) * 4 + 2 * C + c for r in range(2) for c in range(2)] for R in range(2) for C in range(2)]
    split = F.array(*(sum((F.col("c2")[i] for i in q), F.lit(signal).cast("bigint")) for q in quarters))
    df = df.withColumn("s4", split).withColumn("b4", F.zip_with("c4", "s4", lambda a, s: F.least(a, s))).withColumn("s8", total(F.col("b4")) + signal)
    n_split = F.size(F.filter(F.zip_with("c4", "s4", lambda a, s: s < a), lambda x: x)).cast("bigint")
    return df.select("vec_id", F.least("c8", "s8").alias("cost"), (F.col("s8") < F.col("c8")).alias("split_8"), n_split.alias("n_split_4"))

"""Filters, transforms and predictions on 8 x 8 blocks, and resampled series; each within the row, no cell is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.fixed import clamp, div, round_shift
from .blocks import N, added, shifted, times, total

#: Taps by strength of the filter along an edge, of 16.
EDGE_TAPS = [[0, 16, 0], [4, 8, 4], [5, 6, 5], [2, 4, 4, 4, 2]]
#: Steps (row, column) to the two cells on one side, by direction.
DIRECTION_STEPS = [((-1, 1), (-2, 2)), ((0, 1), (-1, 2)), ((0, 1), (0, 2)), ((0, 1), (1, 2)), ((1, 1), (2, 2)), ((1, 0), (2, 1)), ((1, 0), (2, 0)), ((1, 0), (2, -1))]


def symmetric_filter(b: str, blocks: DataFrame, side: list[int], bits: int, first_bits: int, low: int, high: int) -> DataFrame:
    """Replaces ``b`` by its filtered form: taps ``side`` on both sides of what is left of 2^bits, across and then down.

    Rounded by ``first_bits`` and clamped between the passes, by the rest after them; edges are repeated.
    """
    centre = (1 << bits) - 2 * sum(side)
    taps = dict(zip(range(-len(side), 0), side, strict=True)) | {0: centre} | dict(zip(range(len(side), 0, -1), side, strict=True))
    for (dr, dc), shift in (((0, 1), first_bits), ((1, 0), 2 * bits - first_bits)):
        moved = [times(shifted(b, dr * d, dc * d, True), t) for d, t in sorted(taps.items()) if t]
        blocks = blocks.withColumn(b, F.transform(added(moved), lambda x: round_shift(x, shift)))
        blocks = blocks.withColumn(b, F.transform(b, lambda x: clamp(x, low << (bits - first_bits), high << (bits - first_bits)) if shift == first_bits else clamp(x, low, high)))
    return blocks


def directional_filter(blocks: DataFrame, direction: int, strength: int, damping: int) -> DataFrame:
    """Replaces ``b``: each cell moves toward its neighbours along a direction, by differences that fade out beyond ``strength``."""
    shift = max(0, damping - (strength.bit_length() - 1))
    x, parts = F.col("b"), []

    def pull(near: Column, own: Column) -> Column:
        size = F.abs(near - own)
        return F.signum(near - own).cast("bigint") * F.least(size, F.greatest(F.lit(0), F.lit(strength) - F.shiftright(size, shift)))

    for (dr, dc), tap in zip(DIRECTION_STEPS[direction], (4, 2), strict=True):
        for sign in (1, -1):
            parts.append(times(F.zip_with(_moved_or_same("b", sign * dr, sign * dc), x, pull), tap))
    change = F.transform(added(parts), lambda s: F.shiftright(s + 8 - (s < 0).cast("int"), 4))
    return blocks.withColumn("b", F.zip_with("b", change, lambda v, c: v + c))


def _moved_or_same(b: str, dr: int, dc: int) -> Column:
    """The block moved by (dr, dc); a cell whose neighbour lies outside is its own."""
    inside = lambda r, c: 0 <= r < N and 0 <= c < N
    places = F.array(*(F.lit((r + dr) * N + c + dc if inside(r + dr, c + dc) else r * N + c) for r in range(N) for c in range(N)))
    return let(F.col(b), lambda given: F.transform(places, lambda i: F.get(given, i)))


def filtered_edge(edge: Column, strength: int) -> Column:
    """An edge's samples, all but the first filtered; the ends are repeated."""
    taps = EDGE_TAPS[strength]
    reach = len(taps) // 2
    at = lambda e, i: F.get(e, F.least(F.greatest(i, F.lit(0)), F.size(e) - 1))
    mean = lambda e, i: F.shiftright(sum((at(e, i + d - reach) * t for d, t in enumerate(taps[1:], 1)), at(e, i - reach) * taps[0]) + 8, 4)
    return let(edge, lambda e: F.transform(e, lambda x, i: F.when(i == 0, x).otherwise(mean(e, i))))


def doubled_edge(edge: Column, low: int, high: int) -> Column:
    """An edge at twice the rate: before each sample the one halfway to it, by four taps, the ends repeated."""
    at = lambda e, i: F.get(e, F.least(F.greatest(i, F.lit(0)), F.size(e) - 1))
    half = lambda e, i: clamp(F.shiftright(at(e, i - 1) * 9 + at(e, i) * 9 - at(e, i - 2) - at(e, i + 1) + 8, 4), low, high)
    return let(edge, lambda e: F.flatten(F.transform(e, lambda x, i: F.array(half(e, i), x))))


def resampled(series: Column, source: int, target: int) -> Column:
    """A series of any length at target / source times its rate, between neighbours in 1/256; positions start together."""
    place = lambda i: div(i * (source * 256), target)
    at = lambda s, i: F.get(s, F.least(i, F.size(s) - 1).cast("int"))
    sample = lambda s, p: F.shiftright(at(s, F.shiftright(p, 8)) * (F.lit(256) - p.bitwiseAND(255)) + at(s, F.shiftright(p, 8) + 1) * p.bitwiseAND(255) + 128, 8)
    n = lambda s: div(F.size(s) * target + (source - 1), source)
    return let(series, lambda s: F.transform(F.sequence(F.lit(0).cast("bigint"), n(s).cast("bigint") - 1), lambda i: sample(s, place(i).cast("bigint"))))


def walsh_hadamard_4x4(x: list[Column], factor: int = 4) -> list[Column]:
    """The lossless 4 x 4 transform of 16 cells (by rows) by lifting, down and then across."""

    def lifted(p: Column, q: Column, r: Column, s: Column) -> list[Column]:
        low, high = p + q, s - r
        half = F.shiftright(low - high, 1)
        q, r = half - q, half - r
        return [low - r, r, high + q, q]

    down = [lifted(*(x[4 * k + c] for k in range(4))) for c in range(4)]  # down[c]: what column c gives, kept as row c
    across = [lifted(*(down[k][c] for k in range(4))) for c in range(4)]
    return [across[c][k] * factor for k in range(4) for c in range(4)]


def quarters(b: Column) -> Column:
    """The four 4 x 4 quarters of a block, each by rows."""
    return F.array(*(F.array(*(b[(R + r) * N + C + c] for r in range(4) for c in range(4))) for R in (0, 4) for C in (0, 4)))


def directional_prediction(above: Column, dx: int) -> Column:
    """A block continued from the samples above it (8 or more) along a slope of ``dx`` / 64 columns a row; the last repeats."""
    cells = []
    for r in range(N):
        x = (r + 1) * dx
        share = (x & 63) >> 1
        for c in range(N):
            i = (x >> 6) + c
            cells.append((i, share))
    at = lambda e, i: F.get(e, F.least(F.lit(i), F.size(e) - 1))
    return let(above, lambda e: F.array(*(round_shift(at(e, i) * (32 - s) + at(e, i + 1) * s, 5) for i, s in cells)))


def chroma_from_luma(luma: Column, chroma: Column, alphas: range) -> Column:
    """Struct (sse, alpha): the share of the luma's detail (in 1/8), added to the chroma's mean, of least squared error."""
    mean = lambda b: F.shiftright(total(b) + 32, 6)
    detail = let(luma, lambda b: let(mean(b), lambda m: F.transform(b, lambda x: x - m)))

    def best(d: Column, b: Column, m: Column) -> Column:
        error = lambda a: total(F.zip_with(d, b, lambda x, y: (y - m - round_shift(x * a, 3)) * (y - m - round_shift(x * a, 3))))
        return F.array_min(F.transform(F.array(*map(F.lit, alphas)), lambda a: F.struct(error(a).alias("sse"), F.abs(a).alias("size"), a.alias("alpha"))))

    return let(detail, lambda d: let(chroma, lambda b: let(mean(b), lambda m: best(d, b, m))))


def palette_of(b: Column, n: Column) -> Column:
    """``n`` colours spread evenly over a block's range."""
    low, high = F.array_min(b), F.array_max(b)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: low + div((high - low) * (i.cast("bigint") * 2 + 1), n * 2))


def palette_size(b: Column, sizes: range, rate: int) -> Column:
    """Struct (cost, n): squared error of nearest colours plus ``rate`` a colour, least, ties to fewer colours."""
    error = lambda given, p: total(F.transform(given, lambda x: F.array_min(F.transform(p, lambda c: (x - c) * (x - c)))))
    cost = lambda given, n: let(palette_of(given, n), lambda p: error(given, p)) + n * rate
    return let(b, lambda given: F.array_min(F.transform(F.array(*map(F.lit, sizes)), lambda n: F.struct(cost(given, n).alias("cost"), n.alias("n")))))


def projected(b: Column) -> Column:
    """Sums of a block's columns, >> 1."""
    return F.array(*(F.shiftright(sum((b[r * N + c] for r in range(1, N)), b[c]), 1) for c in range(N)))


def vector_variance(a: Column, b: Column, bits: int) -> Column:
    """Variance times the length of the difference of two arrays of 2^bits numbers."""
    d = F.zip_with(a, b, lambda x, y: x - y)
    return let(d, lambda d: total(F.transform(d, lambda x: x * x)) - F.shiftright(total(d) * total(d), bits))

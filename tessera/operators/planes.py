"""Planes: cells of blocks that lie beside each other, and filters that reach across the blocks' borders.

Blocks (frame, r, c, b: 8 x 8 cells by rows), each place once, become tiles of many blocks by one shuffle. A tile then
sends each tile beside it the strip that it needs: what is shuffled again is in proportion to the tiles' borders, not to
their cells. Work within a tile is NumPy's, some tiles at a time. Cells that no block holds count as ``fill``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a block's side, and of a tile's; cells of tiles that are worked on at a time.
N, SIDE, CELLS = 8, 64, 1 << 18
KEY = ["frame", "tr", "tc"]
STRIPS = "frame bigint, tr bigint, tc bigint, dr int, dc int, s binary"

Work = Callable[[np.ndarray], np.ndarray]


def tiles_of(blocks: DataFrame, side: int = SIDE) -> DataFrame:
    """(frame, tr, tc, slots, v): each tile's blocks, in order of their slots, numbered by rows."""
    a = side // N
    place = F.struct(((F.pmod("r", F.lit(a)) * a) + F.pmod("c", F.lit(a))).cast("int").alias("slot"), "b")
    at = [F.col("frame").cast("bigint").alias("frame"), F.floor(F.col("r") / a).alias("tr"), F.floor(F.col("c") / a).alias("tc")]
    held = blocks.select(*at, place.alias("x")).groupBy(*KEY).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return held.select(*KEY, F.col("x")["slot"].alias("slots"), F.flatten(F.col("x")["b"]).alias("v"))


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    yield from (flat[start:end] for start, end in zip([0, *ends], ends, strict=False))


def tile_cells(batch: pa.RecordBatch, side: int, fill: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, square of cells) of each row."""
    a = side // N
    for slots, v in zip(_lists(batch.column("slots")), _lists(batch.column("v")), strict=True):
        cells = np.full((a * a, N, N), fill, np.int64)
        cells[slots] = v.reshape(-1, N, N)
        yield slots, cells.reshape(a, a, N, N).swapaxes(1, 2).reshape(side, side)


def _part(d: int, side: int, before: int, after: int) -> slice:
    """What a tile sends to the one that lies d further."""
    return {1: slice(side - before, side), 0: slice(0, side), -1: slice(0, after)}[d]


def with_halo(tiles: DataFrame, side: int, before: int, after: int, fill: int = 0) -> DataFrame:
    """``tiles`` with the strips (dr, dc, s) that tiles in direction (-dr, -dc) send: ``before`` cells on their far side, ``after`` on the near."""
    if max(before, after) > side:
        raise ValueError("a filter reaches further than the next tile")

    def sent(batches):
        for batch in batches:
            rows = []
            keys = zip(*(batch.column(n).to_pylist() for n in KEY), strict=True)
            for (frame, tr, tc), (_, cells) in zip(keys, tile_cells(batch, side, fill), strict=True):
                for dr in (-1, 0, 1):
                    for dc in (-1, 0, 1):
                        strip = cells[_part(dr, side, before, after), _part(dc, side, before, after)]
                        if (dr or dc) and strip.size:
                            rows.append((frame, tr + dr, tc + dc, dr, dc, strip.astype("<i8").tobytes()))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], [*KEY, "dr", "dc", "s"])

    strips = tiles.mapInArrow(sent, STRIPS).groupBy(*KEY).agg(F.collect_list(F.struct("dr", "dc", "s")).alias("strips"))
    return tiles.join(strips, KEY, "left")


def _stack(batch: pa.RecordBatch, side: int, before: int, after: int, fill: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(slots of each tile, tiles with what lies around them)."""
    whole = side + before + after
    out = np.full((batch.num_rows, whole, whole), fill, np.int64)
    place = {1: slice(0, before), 0: slice(before, before + side), -1: slice(before + side, whole)}
    slots = []
    for i, ((of, cells), strips) in enumerate(zip(tile_cells(batch, side, fill), batch.column("strips").to_pylist(), strict=True)):
        slots.append(of)
        out[i, place[0], place[0]] = cells
        for x in strips or []:
            to = out[i, place[x["dr"]], place[x["dc"]]]
            to[...] = np.frombuffer(x["s"], "<i8").reshape(to.shape)
    return slots, out


def stacks(batches: Iterator[pa.RecordBatch], side: int, before: int, after: int, fill: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]]:
    """(rows, slots, cells) of some tiles at a time."""
    few = max(1, CELLS // (side + before + after) ** 2)
    for batch in batches:
        for i in range(0, batch.num_rows, few):
            some = batch.slice(i, few)
            yield some, *_stack(some, side, before, after, fill)


def stencil(blocks: DataFrame, before: int, after: int, work: Work, kind: str = "bigint", side: int = SIDE, fill: int = 0) -> DataFrame:
    """(frame, r, c, b) after ``work`` on the whole planes: from tiles with the cells around them to tiles; ``fill``: where no cell is."""
    a, dtype = side // N, {"bigint": np.int64, "double": np.float64}[kind]

    def run(batches):
        for rows, slots, cells in stacks(batches, side, before, after, fill):
            done = work(cells).astype(dtype).reshape(-1, a, N, a, N).swapaxes(2, 3).reshape(len(cells), a * a, N * N)
            n = [len(x) for x in slots]
            frame, tr, tc = (np.repeat(rows.column(name).to_numpy(), n) for name in KEY)
            slot, b = np.concatenate(slots), np.concatenate([x[of] for x, of in zip(done, slots, strict=True)])
            offsets = pa.array(np.arange(len(b) + 1, dtype=np.int32) * N * N)
            yield pa.RecordBatch.from_arrays([pa.array(frame), pa.array(tr * a + slot // a), pa.array(tc * a + slot % a), pa.ListArray.from_arrays(offsets, pa.array(b.ravel()))], ["frame", "r", "c", "b"])

    haloed = with_halo(tiles_of(blocks, side), side, before, after, fill)
    return haloed.mapInArrow(run, f"frame bigint, r bigint, c bigint, b array<{kind}>")


# ---- filters ----


def _along(cells: np.ndarray, taps: list[int], axis: int) -> np.ndarray:
    """Sum of moved cells times taps; shorter by the taps but one."""
    n = cells.shape[axis] - len(taps) + 1
    take = lambda i: cells[(slice(None),) * axis + (slice(i, i + n),)]
    return sum(take(i) * t for i, t in enumerate(taps) if t)


def box_sums(blocks: DataFrame, reach: int, side: int = SIDE) -> DataFrame:
    """Sums over (2 reach + 1)² cells."""
    taps = [1] * (2 * reach + 1)
    return stencil(blocks, reach, reach, lambda x: _along(_along(x, taps, 2), taps, 1), side=side)


def separable(blocks: DataFrame, taps: list[int], bits: int, side: int = SIDE) -> DataFrame:
    """Filtered along rows, then along columns, rounded after each by a shift."""
    reach, half = len(taps) // 2, (1 << bits) >> 1
    return stencil(blocks, reach, reach, lambda x: (_along((_along(x, taps, 2) + half) >> bits, taps, 1) + half) >> bits, side=side)


def self_guided(blocks: DataFrame, strength: int, side: int = SIDE) -> DataFrame:
    """The self-guided filter of reach 1 on cells of 0 to 255: a cell's mean or itself, by the variance of what is near it.

    Each place has a weight from its 3 x 3 cells' variance (none where they are equal) and the mean that takes the rest;
    both are then averaged over 3 x 3 places, corners 3 and others 4 of 32. Results have 4 bits more than the cells.
    """
    near, corners = [1, 1, 1], [1, 0, 1]

    def work(x: np.ndarray) -> np.ndarray:
        sums = _along(_along(x, near, 2), near, 1)
        squares = _along(_along(x * x, near, 2), near, 1)
        spread = np.maximum(9 * squares - sums * sums, 0)
        z = np.minimum((spread * strength + (1 << 19)) >> 20, 255)
        weight = np.where(z >= 255, 256, np.maximum(1, ((z << 8) + z // 2) // (z + 1)))
        mean = ((256 - weight) * sums * NINTH + (1 << 11)) >> 12
        spreadout = lambda y: 4 * _along(_along(y, near, 2), near, 1) - _along(_along(y, corners, 2), corners, 1)
        return (spreadout(weight) * x[:, 2:-2, 2:-2] + spreadout(mean) + (1 << 8)) >> 9

    return stencil(blocks, 2, 2, work, side=side)


#: 1/9 in 12 bits.
NINTH = (4096 + 4) // 9


def _edge_filtered(p: list[np.ndarray], q: list[np.ndarray], limit: int, edge_limit: int, high: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Three cells on each side of an edge (p0 and q0 beside it, of four that are given) after smoothing.

    Nothing where the cells differ too much for a mere edge between blocks, or one side is missing; a smooth
    average where both sides are flat; else the step is lessened, of the two next cells only where neither side varies.
    """
    apart = lambda a, b: np.abs(a - b)
    mask = (p[0] >= 0) & (q[0] >= 0) & (apart(p[0], q[0]) * 2 + apart(p[1], q[1]) // 2 <= edge_limit)
    for x in (p, q):
        for i in range(3):
            mask = mask & (apart(x[i], x[i + 1]) <= limit)
    flat = np.logical_and.reduce([apart(x[0], x[i]) <= 1 for x in (p, q) for i in (1, 2, 3)])
    varies = (apart(p[1], p[0]) > high) | (apart(q[1], q[0]) > high)
    signed = lambda x: np.clip(x, -128, 127)
    s = [x - 128 for x in (p[1], p[0], q[0], q[1])]
    step = signed(np.where(varies, signed(s[0] - s[3]), 0) + 3 * (s[2] - s[1]))
    up, down = signed(step + 4) >> 3, signed(step + 3) >> 3
    next_ones = np.where(varies, 0, (up + 1) >> 1)
    lessened = [[signed(s[1] + down) + 128, signed(s[0] + next_ones) + 128, p[2]], [signed(s[2] - up) + 128, signed(s[3] - next_ones) + 128, q[2]]]
    line = [*p[3::-1], *q]  # p3 ... p0 q0 ... q3
    smooth = [sum(line[min(max(i + d, 0), 7)] for d in range(-3, 4)) + line[i] for i in range(1, 7)]
    smooth = [(x + 4) >> 3 for x in smooth]
    done = [[np.where(mask, np.where(flat, a, b), old) for a, b, old in zip(of, few, x, strict=False)] for of, few, x in ((smooth[2::-1], lessened[0], p), (smooth[3:], lessened[1], q))]
    return done[0], done[1]


def deblocked(blocks: DataFrame, limit: int, edge_limit: int, high: int, side: int = SIDE) -> DataFrame:
    """Cells of 0 to 255 with the edges between blocks smoothed: all upright edges, then all level ones of what that gave."""

    def along(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        edges = np.arange(N, x.shape[2] - N + 1, N)
        near_p, near_q = _edge_filtered([x[:, :, edges - 1 - i] for i in range(4)], [x[:, :, edges + i] for i in range(4)], limit, edge_limit, high)
        for i in range(3):
            x[:, :, edges - 1 - i], x[:, :, edges + i] = near_p[i], near_q[i]
        return x

    work = lambda x: along(along(x).swapaxes(1, 2)).swapaxes(1, 2)[:, N:-N, N:-N]
    return stencil(blocks, N, N, work, side=side, fill=-1)


def cosines(n: int) -> np.ndarray:
    """The orthonormal DCT of n values, as a matrix."""
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.sqrt(np.where(k == 0, 1, 2) / n) * np.cos((2 * i + 1) * k * np.pi / (2 * n))


def overlap_add(blocks: DataFrame, noise: float, side: int = SIDE, window: int = N) -> DataFrame:
    """Denoised cells: windows at half their size from each other are transformed, shrunk, transformed back and summed up.

    A window's cells are weighted by a half sine along each direction, before and after, so that the weights of the
    windows over a cell add up to one. A coefficient of power p keeps (p - noise) / p of itself, at least 0. A tile works
    on all windows that touch it, those across its borders too, so that each cell's sum is complete within its tile.
    """
    half, dct = window // 2, cosines(window)
    sine = np.sin((np.arange(window) + 0.5) * np.pi / window)
    weights = sine[:, None] * sine[None, :]

    def work(x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        for i in range(0, x.shape[1] - half, half):
            cut = x[:, i : i + window, :]
            for j in range(0, x.shape[2] - half, half):
                t = dct @ (cut[:, :, j : j + window] * weights) @ dct.T
                p = t * t
                kept = np.where(p > noise, 1 - noise / np.where(p > noise, p, 1), 0)
                out[:, i : i + window, j : j + window] += dct.T @ (t * kept) @ dct * weights
        return out[:, half:-half, half:-half]

    return stencil(blocks, half, half, work, "double", side)

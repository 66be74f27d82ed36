"""Copies within planes: hashes of all overlapping squares, level by level, and the first earlier place of a square's content.

A level's hash at a place is made from four of the level below, at offsets of half its size; a tile has all of
its places by one exchange of strips. Of the places with one hash the first is kept, by task before it is shuffled, so that a
content which fills a plane is one row. What a hash finds is compared cell by cell; squares whose hash agrees but whose
cells don't are matched by content.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .planes import KEY, N, SIDE, stacks, tiles_of, with_halo

#: Stands for a cell that no block holds.
NO_CELL = -(1 << 62)
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def pyramid(cells: np.ndarray, size: int) -> np.ndarray:
    """Hash of the square of ``size`` (a power of two) at each place of some tiles, from the levels below."""
    level = _mixed(cells.astype(np.uint64))
    step = 1
    while step < size:
        n, m = level.shape[1] - step, level.shape[2] - step
        four = (level[:, :n, :m], level[:, :n, step:], level[:, step:, :m], level[:, step:, step:])
        level = _mixed(_mixed(_mixed(_mixed(four[0]) + four[1]) + four[2]) + four[3])
        step *= 2
    return level


def _squares(cells: np.ndarray, size: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(cells, (size, size), axis=(1, 2))


def _places(tiles: DataFrame, size: int, side: int, bits: int, content: bool, aligned: bool) -> DataFrame:
    """(frame, y, x, hash[, content]) of all squares, or of those at multiples of their size, that lie in their plane and aren't of one value."""
    step = size if aligned else 1

    def run(batches):
        for rows, _, cells in stacks(batches, side, 0, size - 1, NO_CELL):
            squares = _squares(cells, size)
            low, high = squares.min(axis=(3, 4)), squares.max(axis=(3, 4))
            there = (low != NO_CELL) & (low < high)
            if step > 1:
                on = np.arange(side) % step == 0
                there &= on[None, :, None] & on[None, None, :]
            tile, y, x = np.nonzero(there)
            frame, tr, tc = (rows.column(n).to_numpy()[tile] for n in KEY)
            columns = {"frame": frame, "y": tr * side + y, "x": tc * side + x, "hash": (pyramid(cells, size)[tile, y, x] >> np.uint64(64 - bits)).astype(np.int64)}
            batch = pa.RecordBatch.from_pydict(columns)
            yield batch.append_column("content", pa.array([s.astype("<i8").tobytes() for s in squares[tile, y, x]], pa.binary())) if content else batch

    return tiles.mapInArrow(run, "frame bigint, y bigint, x bigint, hash bigint" + ", content binary" * content)


def _contents(tiles: DataFrame, wanted: DataFrame, size: int, side: int) -> DataFrame:
    """(frame, y, x, content) of the squares at the places ``wanted`` (frame, y, x): asked of the tiles where they lie."""
    at = [F.col("frame"), F.floor(F.col("y") / side).alias("tr"), F.floor(F.col("x") / side).alias("tc")]
    asked = wanted.select(*at, F.struct((F.col("y") % side).cast("int").alias("y"), (F.col("x") % side).cast("int").alias("x")).alias("at"))
    asked = asked.groupBy(*KEY).agg(F.collect_set("at").alias("at")).select(*KEY, F.col("at")["y"].alias("ys"), F.col("at")["x"].alias("xs"))

    def run(batches):
        for rows, _, cells in stacks(batches, side, 0, size - 1, NO_CELL):
            squares, ys, xs = _squares(cells, size), rows.column("ys"), rows.column("xs")
            n = ys.value_lengths().to_numpy()
            tile, y, x = np.repeat(np.arange(len(n)), n), ys.flatten().to_numpy(), xs.flatten().to_numpy()
            frame, tr, tc = (rows.column(name).to_numpy()[tile] for name in KEY)
            content = pa.array([s.astype("<i8").tobytes() for s in squares[tile, y, x]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(frame), pa.array(tr * side + y), pa.array(tc * side + x), content], ["frame", "y", "x", "content"])

    return tiles.join(asked, KEY).mapInArrow(run, "frame bigint, y bigint, x bigint, content binary")


def earlier_copies(blocks: DataFrame, size: int, side: int = SIDE, bits: int = 64) -> DataFrame:
    """(frame, y, x, from_y, from_x): each aligned square with an earlier equal one in its plane, at any place: the first by rows.

    Squares of one value are left out, as are those that reach beyond the plane. bits: of the hash that are used.
    """
    if size & (size - 1) or size > side or side % size or side % N:
        raise ValueError("size must be a power of two that divides a tile's side")
    tiles = with_halo(tiles_of(blocks, side), side, 0, size - 1, NO_CELL)
    place = F.struct("y", "x")
    first = _places(tiles, size, side, bits, False, False).groupBy("frame", "hash").agg(F.min(place).alias("first"))
    asked = _places(tiles, size, side, bits, True, True)
    found = asked.join(first, ["frame", "hash"]).filter(F.col("first") < place)
    # compared cell by cell: the place found is asked for its content where it lies
    wanted = found.select("frame", F.col("first.y").alias("y"), F.col("first.x").alias("x"))
    there = _contents(tiles, wanted, size, side).select("frame", place.alias("first"), F.col("content").alias("other"))
    checked = found.join(there, ["frame", "first"]).withColumn("same", F.col("content") == F.col("other"))
    # a hash that agrees by chance: by content, among the places with this hash
    doubtful = checked.filter("NOT same").select("frame", "hash", "y", "x", "content")
    of_hash = _places(tiles, size, side, bits, False, False).join(doubtful.select("frame", "hash").distinct(), ["frame", "hash"], "left_semi")
    by_content = _contents(tiles, of_hash, size, side).groupBy("frame", "content").agg(F.min(place).alias("first"))
    again = doubtful.join(by_content, ["frame", "content"]).filter(F.col("first") < place)
    both = checked.filter("same").select("frame", "y", "x", "first").unionByName(again.select("frame", "y", "x", "first"))
    return both.select("frame", "y", "x", F.col("first.y").alias("from_y"), F.col("first.x").alias("from_x"))

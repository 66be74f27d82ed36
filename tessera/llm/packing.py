"""Operator 8, best-fit packing with certified bin counts.

Documents become pieces of at most ``CAPACITY`` tokens (only longer ones are cut). The task that encodes them packs
them where they lie, a partition of about ``PART_BYTES`` at a time, by best-fit decreasing, and compares the bins with
a lower bound from dual feasible functions. A partition that reaches its bound is certified and done, but for its
least filled bin, which it owes to rounding its bound up. Partitions with gaps keep their full bins. The documents of
all other bins go to a common pool, which is dealt anew into fewer partitions that mix them, and packed and certified
again; a round that would need more bins is not taken. Rounds end when nothing has a gap, when the bound of the whole
corpus is reached, once all that is left lay in a single partition, or after ``ROUNDS``.

Ids are written once and stay: rounds move keys and lengths, and only the pool's pieces are joined with their new
places. Only the histogram of lengths (``CAPACITY`` rows) and counts reach the driver.

Edge cases: a null or empty text is the end id alone; rows with the same or a null doc_id are documents of their
own; a document of exactly the capacity is one piece; a very long text fills partitions of its own; an empty table
gives an empty result; other columns are not carried. A task holds one document's ids and a partition of about
``PART_BYTES``; in later rounds the lengths of one partition.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_BATCH, giving_back, stored
from .tokens import encoder, text_slices

#: Fixed values of the contract: tokens in a sequence; the id that ends each document.
CAPACITY, END_ID = 2048, 0
#: Pieces in a partition at most, bytes of ids in one that is packed where it lies, about; rounds of exchange at most.
PART_PIECES, PART_BYTES, ROUNDS = 50_000, 24 << 20, 4
#: Bits of a partition's number within its task, of a piece's or bin's within its partition, of both together.
WINDOW_BITS, ITEM_BITS, PLACE_BITS = 12, 24, 58
#: Words whose ids a packing worker keeps, in each of two generations: fewer than it could, as it holds pieces too.
KEPT_WORDS = 150_000

PACKED = "key long, length long, part long, bin long, offset long, final boolean"
PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("key", pa.int64()), ("part", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("final", pa.bool_()), ("ids", pa.binary()), ("moving", pa.binary())]
)
PIECES_DDL = f"doc_id long, piece int, start long, {PACKED.replace('key long, length long', 'length long, key long')}, ids binary, moving binary"


def lower_bound(lengths: Counter | dict[int, int], capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: the best of several dual feasible functions over a histogram of lengths.

    Total length; for every cut c up to half the capacity, items longer than capacity - c count as whole bins and
    items shorter than c not at all; and for k = 1..20 the rounding of (k + 1) x / capacity to multiples of 1 / k.
    """
    sizes = np.array(sorted(lengths), np.int64)
    if not len(sizes):
        return 0
    n = np.array([lengths[s] for s in sizes.tolist()], np.int64)
    best = -(-int((sizes * n).sum()) // capacity)
    totals, counts = np.concatenate([[0], np.cumsum(sizes * n)]), np.concatenate([[0], np.cumsum(n)])
    cuts = np.unique(np.concatenate([sizes[sizes <= capacity // 2], capacity - sizes[2 * sizes > capacity]]))
    cuts = cuts[(cuts >= 1) & (2 * cuts <= capacity)]
    low, high = np.searchsorted(sizes, cuts, "left"), np.searchsorted(sizes, capacity - cuts, "right")
    scaled = (totals[high] - totals[low]) + capacity * (counts[-1] - counts[high])
    best = max(best, -(-int(scaled.max(initial=0)) // capacity))
    for k in range(1, 21):
        whole, part = divmod(sizes * (k + 1), capacity)
        values = np.where(part == 0, sizes * k, whole * capacity)  # of k * capacity
        best = max(best, -(-int((values * n).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset, bins) of best-fit decreasing; open bins are stacks by the room they have left."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0  # rooms: bit r is set if a bin with room r is open
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - room
        if room > n:
            open_bins[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, made


def certified(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, final) of each of a partition's pieces; final: its bin needs no exchange."""
    bins, offsets, made = best_fit(lengths, capacity)
    filled = np.bincount(bins, lengths, minlength=made).astype(np.int64)
    final = filled == capacity
    if made == lower_bound(Counter(lengths.tolist()), capacity):
        final |= np.arange(made) != filled.argmin()
    return bins, offsets, final[bins]


def packed_where_they_lie(documents: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, part_pieces: int = PART_PIECES, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents' pieces, each with its place in its own partition; ids stand in ``moving`` if it isn't final."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, KEPT_WORDS)
        end, width = np.asarray([end_id], own.dtype).tobytes(), own.dtype.itemsize
        part, size, held = TaskContext.get().partitionId() << WINDOW_BITS, 0, []

        def out() -> Iterator[pa.RecordBatch]:
            doc_ids, pieces, starts, lengths, ids = zip(*held, strict=True)
            n, lengths = len(ids), np.asarray(lengths, np.int64)
            bins, offsets, final = certified(lengths, capacity)
            stay = ([x if f else None for x, f in zip(ids, some, strict=True)] for some in (final, ~final))
            columns = [doc_ids, pieces, starts, lengths, np.arange(n) + (part << ITEM_BITS), np.full(n, part), bins, offsets, final, *stay]
            rows = max(1, n * (4 << 20) // size)
            for a in range(0, n, rows):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + rows], t) for c, t in zip(columns, PIECES.types, strict=True)], schema=PIECES)

        for batch in batches:
            of = batch.column("doc_id").to_pylist()
            for a, b, texts in text_slices(batch.column("text"), TEXT_BATCH):
                for doc_id, ids in zip(of[a:b], own.encode(texts), strict=True):
                    ids += end
                    n = len(ids) // width
                    for i, start in enumerate(range(0, n, capacity)):
                        held.append((doc_id, i, start, min(capacity, n - start), ids[start * width : (start + capacity) * width]))
                        size += len(held[-1][-1])
                        if len(held) >= part_pieces or size >= part_bytes:
                            yield from out()
                            part, size, held = part + 1, 0, []
                            if part >> WINDOW_BITS != TaskContext.get().partitionId():
                                raise ValueError(f"a task has over {1 << WINDOW_BITS} partitions of pieces; read the documents in smaller splits")
        if held:
            yield from out()

    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(giving_back(pack), PIECES_DDL)


def _packed(rows: DataFrame, parts: int, seed: int, capacity: int) -> DataFrame:
    """Pieces (key, length) dealt into ``parts`` partitions and packed."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        bins, offsets, final = certified(table.column("length").to_numpy(), capacity)
        return table.select(["key", "length", "part"]).append_column("bin", pa.array(bins)).append_column("offset", pa.array(offsets)).append_column("final", pa.array(final))

    dealt = rows.select("key", "length", F.pmod(F.xxhash64(F.col("key"), F.lit(seed)), F.lit(parts)).cast("bigint").alias("part"))
    return stored(dealt.groupBy("part").applyInArrow(pack, PACKED), f"packed-{seed}")


def _bins():
    """Bins of some rows: each has one piece at offset 0."""
    return F.count_if(F.col("offset") == 0).alias("bins")


def exchanged(first: DataFrame, capacity: int, part_pieces: int, rounds: int) -> list[DataFrame]:
    """The rounds of exchange after ``first`` that are taken: each packs what the one before has not final."""
    histogram = {r["length"]: r["n"] for r in first.groupBy("length").agg(F.count("*").alias("n")).collect()}
    goal, done, taken, now = lower_bound(histogram, capacity), 0, [], first
    parts = first.filter("offset = 0 AND bin = 0").count()
    for turn in range(1, rounds + 1):
        by = {r["final"]: r for r in now.groupBy("final").agg(_bins(), F.count("*").alias("n")).collect()}
        pool, pool_bins = (by[False]["n"], by[False]["bins"]) if False in by else (0, 0)
        done += by[True]["bins"] if True in by else 0
        if not pool or done + pool_bins <= goal or parts == 1:
            break
        parts = max(1, min(math.ceil(pool / part_pieces), parts - 1))
        now = _packed(now.filter(~F.col("final")), parts, turn, capacity)
        if now.agg(_bins()).first()["bins"] > pool_bins:
            break
        taken.append(now)
    return taken


def _sequence(turn: int):
    return (F.lit(turn << PLACE_BITS) + F.shiftleft(F.col("part"), ITEM_BITS) + F.col("bin")).alias("sequence_id")


def _places(rounds: list[DataFrame], first_turn: int) -> DataFrame:
    """(key, sequence_id, offset): where each piece of some rounds stays, the last of them whole."""
    last = len(rounds) - 1
    return reduce(DataFrame.unionByName, [(rows if i == last else rows.filter("final")).select("key", _sequence(first_turn + i), "offset") for i, rows in enumerate(rounds)])


def assign(lengths: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """(key, sequence_id, offset) for (key, length) rows, each length from 1 to ``capacity``."""
    first = _packed(lengths, max(1, math.ceil(lengths.count() / part_pieces)), 0, capacity)
    return _places([first, *exchanged(first, capacity, part_pieces, rounds)], 0)


def pack(documents: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, part_pieces: int = PART_PIECES, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian, unsigned), sequence_id, offset for every piece."""
    pieces = stored(packed_where_they_lie(documents, capacity, end_id, vocabulary, part_pieces, part_bytes), "pieces", TEXT_BATCH)
    names = ("doc_id", "piece", "start", "length")
    rounds = exchanged(pieces.select("key", "length", "part", "bin", "offset", "final"), capacity, part_pieces, ROUNDS)
    if not rounds:
        return pieces.select(*names, F.coalesce("ids", "moving").alias("ids"), _sequence(0), "offset")
    stay = pieces.filter("final").select(*names, "ids", _sequence(0), "offset")
    move = pieces.filter("NOT final").select(*names, F.col("moving").alias("ids"), "key")
    return stay.unionByName(move.join(_places(rounds, 1).hint("merge"), "key").drop("key"))

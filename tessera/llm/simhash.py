"""Operator 7, SimHash near-dedup by anchor-point covering.

Fingerprints of 64 bits are linked where they differ in ``THRESHOLD`` bits or fewer. The anchors are the words of a
covering code: two perfect Golay codes of 23 bits (covering radius 3 each), side by side, and zero in the 18 bits
left. Every 64-bit word lies in the cell of one anchor, the nearest one in both blocks. Two linked fingerprints have
a point between them that is at most 1 bit from the one and 2 from the other, and that point has a cell; so each
fingerprint is replicated to every anchor whose cell it can reach by changing its share of the threshold, 2 bits.
(All of these lie within covering radius plus threshold; the other anchors in that ball need no visit.) Cells are then
compared one by one.

Equal fingerprints are one row throughout. Cells of more than ``HOT_CELL`` rows are split by the 18 bits left: a row then
goes to every value of them that it reaches with what its way to the anchor has left of its 2 bits, and the same
argument holds for the finer cells. Within a cell with many fingerprints only the links of spanning forests are given,
so that a large group of near copies costs no more rows than a few times its members. The list of hot cells is
broadcast while it has ``HOT_LIST`` rows at most; beyond that, where nearly all cells are full, all cells are split
and there is no list.

Words are runs of anything but ASCII white space, A-Z in lower case; shingles of three words, repeats included, are
hashed with XXH64 (seed 42); a bit of the fingerprint is 1 if it is set in over half of the hashes.

Edge cases: a null, empty or blank text has fingerprint 0, linked like any other; fewer words than three are one
shingle; rows with the same doc_id are rows of their own; a null doc_id names no component: it gets the least
doc_id that is not null, or null; an empty table gives an empty result; other columns are not carried, but by
``drop_near_duplicates``, by which one of the rows with equal doc_id and text stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_BATCH, free_name, giving_back, stored
from .components import components

#: Fixed values of the contract: bits that linked fingerprints may differ in; words in a shingle; seed of XXH64.
THRESHOLD, SHINGLE, SEED = 3, 3, 42
#: Fixed value: generator polynomial of the binary Golay code.
GOLAY, BITS, PARITY = 0b110001110101, 23, 11
#: Bits of a fingerprint's own that it may change on the way to an anchor's cell.
SHARE = 2
#: Bits that lie in neither block.
FREE = 64 - 2 * BITS
#: Cells of more rows are linked by a spanning forest; rows that a task compares at once, about; rows of a cell that is split.
DENSE, ROWS_AT_ONCE, HOT_CELL = 48, 1 << 20, 1 << 16
#: Hot cells, and rows dropped, up to which a list of them (some 50 bytes each in memory) is broadcast.
HOT_LIST, DROPPED_LIST = 1 << 16, 1 << 18
#: Fingerprints that are compared one with the rest; more are first dealt by each of ``BANDS`` parts of their bits, one of
#: which any two linked ones share.
PLAIN_FOREST, BANDS = 1024, 4


def fingerprint(text: str | None) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, k = ends - sizes, min(SHINGLE, len(words))
    n = len(words) - k + 1
    counts = np.zeros(64, np.int64)
    spans = zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(documents: DataFrame, carried: str = "") -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long; with the column ``carried`` (string) too, if one is named."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield batch.drop_columns(["text"]).append_column("fp", pa.array(fps.view(np.int64)))

    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *([F.col(carried).alias("carried")] if carried else []))
    return rows.mapInArrow(giving_back(each), "doc_id long, carried string, fp long" if carried else "doc_id long, fp long")


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of single bits; for each syndrome (start, end) of its rows in the other two arrays; for each way to a
    cell from a word with that syndrome: what to change in the word to get the cell's anchor, and bits of its own."""
    bits = np.zeros(BITS, np.int64)
    for i in range(BITS):
        rest = 1 << i
        for j in range(BITS - 1, PARITY - 1, -1):
            if rest >> j & 1:
                rest ^= GOLAY << (j - PARITY)
        bits[i] = rest
    few = [0] + [1 << i for i in range(BITS)] + [1 << i | 1 << j for i in range(BITS) for j in range(i)]
    three = [x | 1 << k for x in few[1 + BITS :] for k in range(x.bit_length(), BITS)]
    leaders = np.zeros(1 << PARITY, np.int64)
    for pattern in few + three:
        leaders[syndromes(np.array([pattern]), bits)[0]] = pattern
    patterns = np.array(few)
    own = syndromes(patterns, bits)
    ranges, changes, moved = np.zeros((1 << PARITY, 2), np.int64), [], []
    flips = np.bitwise_count(patterns).astype(np.int64)
    for s in range(1 << PARITY):
        change = patterns ^ leaders[s ^ own]
        order = np.lexsort((flips, change))
        change, least = change[order], flips[order]
        first = np.append(True, change[1:] != change[:-1])
        ranges[s] = (ranges[s - 1][1] if s else 0), (ranges[s - 1][1] if s else 0) + first.sum()
        changes.append(change[first])
        moved.append(least[first])
    return bits, ranges, np.concatenate(changes), np.concatenate(moved)


def syndromes(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for i in range(BITS):
        out ^= np.where(words >> i & 1, bits[i], 0)
    return out


def _ways(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the word, anchor's information bits, bits changed) for all cells of one block in reach."""
    bits, ranges, changes, moved = golay()
    start, end = ranges[syndromes(words, bits)].T
    n = end - start
    index = np.repeat(np.arange(len(words)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
    return index, (words[index] ^ changes[at]) >> PARITY, moved[at]


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor, bits changed) for every anchor that a fingerprint (unsigned) goes to."""
    mask = np.uint64((1 << BITS) - 1)
    first, second = (fps & mask).astype(np.int64), ((fps >> np.uint64(BITS)) & mask).astype(np.int64)
    i1, a1, m1 = _ways(first)
    i2, a2, m2 = _ways(second)
    n2 = np.bincount(i2, minlength=len(fps))
    start2 = np.cumsum(n2) - n2
    index = np.repeat(np.arange(len(i1)), n2[i1])
    at = np.arange(len(index)) - np.repeat(np.cumsum(n2[i1]) - n2[i1], n2[i1]) + start2[i1[index]]
    moved = m1[index] + m2[at]
    near = moved <= SHARE
    index, at = index[near], at[near]
    return i1[index], a1[index] << (BITS - PARITY) | a2[at], moved[near]


def _replicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("anchor", pa.int32()), ("fp", pa.int64()), ("moved", pa.int8())])
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for i in range(0, len(fps), 2000):
            part = fps[i : i + 2000]
            index, anchor, moved = anchors_of(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(part[index]), pa.array(moved.astype(np.int8))], schema=schema)


def forest(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links (as indices) that connect whatever is connected among distinct fingerprints.

    A few are compared one with the rest until all are linked. More go by parts of their bits: threshold + 1 parts can't
    all differ in linked ones, so the forests among those that share one part, for each part, connect them.
    """
    if len(fps) <= PLAIN_FOREST:
        return _forest(fps, threshold)
    if threshold >= BANDS:
        raise ValueError(f"fingerprints are told apart by {BANDS} parts, which is too few for {threshold} bits")
    width, a, b = 64 // BANDS, [], []
    for k in range(BANDS):
        band = fps >> np.uint64(k * width) & np.uint64((1 << width) - 1)
        order = np.argsort(band, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(band[order]) != 0))
        ends = np.append(starts[1:], len(order))
        for start, end in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            group = order[start:end]
            i, j = _forest(fps[group], threshold)
            a.append(group[i])
            b.append(group[j])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _forest(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Every one is compared with what isn't linked yet, those that are linked first."""
    left, a, b = np.arange(len(fps)), [], []
    waiting: list[int] = []
    while len(left):
        if not waiting:
            waiting, left = [int(left[0])], left[1:]
        at = waiting.pop()
        near = np.bitwise_count(fps[left] ^ fps[at]) <= threshold
        found = left[near]
        if len(found):
            a.append(np.full(len(found), at))
            b.append(found)
            waiting += found.tolist()
            left = left[~near]
    empty = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def cell_links(anchor: np.ndarray, fps: np.ndarray, moved: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links (as indices) between rows of the same anchor; rows are sorted by anchor, whole cells only."""
    starts = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(anchor)))
    a, b = [], []
    for start, n in zip(starts[sizes > DENSE].tolist(), sizes[sizes > DENSE].tolist(), strict=True):
        i, j = forest(fps[start : start + n], threshold)
        a.append(i + start)
        b.append(j + start)
    small = sizes <= DENSE
    end = np.repeat((starts + sizes)[small], sizes[small])
    at = np.flatnonzero(np.repeat(small, sizes))
    for k in range(1, DENSE):
        keep = at + k < end
        at, end = at[keep], end[keep]
        if not len(at):
            break
        apart = np.bitwise_count(fps[at] ^ fps[at + k])
        # a pair is met in several cells; it is given only where one of the two has changed as little as it may
        near = (apart <= threshold) & (np.minimum(moved[at], moved[at + k]) <= np.maximum(apart.astype(np.int64) - SHARE, 0))
        a.append(at[near])
        b.append(at[near] + k)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def _free_bits() -> tuple[np.ndarray, np.ndarray]:
    """Changes of the bits that lie in neither block, by bits changed, up to ``SHARE``; how many change at most 0, 1, ... bits."""
    ones = [1 << i for i in range(FREE)]
    by_bits = [[0], ones, [x | y for i, x in enumerate(ones) for y in ones[:i]]][: SHARE + 1]
    return np.array([x for some in by_bits for x in some], np.int64), np.cumsum([len(some) for some in by_bits])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, fp, moved, hot) to the cells (anchor, free) that they reach; free is 0 in cells that are not split."""
    schema = pa.schema([("anchor", pa.int32()), ("free", pa.int32()), ("fp", pa.int64()), ("moved", pa.int8())])
    changes, upto = _free_bits()
    for batch in batches:
        for a in range(0, batch.num_rows, 20_000):
            anchor, fps, moved = (batch.column(c).slice(a, 20_000).to_numpy(zero_copy_only=False) for c in ("anchor", "fp", "moved"))
            hot = batch.column("hot").slice(a, 20_000).to_numpy(zero_copy_only=False)
            n = np.where(hot, upto[SHARE - moved], 1)
            index = np.repeat(np.arange(len(n)), n)
            change = changes[np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n)]
            own = (fps.view(np.uint64) >> np.uint64(2 * BITS)).astype(np.int64)
            free = np.where(hot[index], own[index] ^ change, 0)
            flips = moved[index] + np.bitwise_count(change)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[index]), pa.array(free.astype(np.int32)), pa.array(fps[index]), pa.array(flips.astype(np.int8))], schema=schema)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell to links of fingerprints; holds some batches and the cell that they end in, joined once."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def out(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        cell, fps, moved = rows
        i, j = cell_links(cell, fps.view(np.uint64), moved.astype(np.int64))
        pairs = np.unique(np.stack([np.minimum(fps[i], fps[j]), np.maximum(fps[i], fps[j])], axis=1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    for batch in batches:
        anchor, free, fps, moved = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "free", "fp", "moved"))
        cell = anchor.astype(np.int64) << FREE | free
        cut = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
        if n + cut >= ROWS_AT_ONCE and (cut or (held and held[-1][0][-1] != cell[0])):
            yield out(tuple(map(np.concatenate, zip(*held, (cell[:cut], fps[:cut], moved[:cut]), strict=True))))
            held, n = [], 0
            cell, fps, moved = cell[cut:], fps[cut:], moved[cut:]
        if len(cell):
            held.append((cell, fps, moved))
            n += len(cell)
    if held:
        yield out(tuple(map(np.concatenate, zip(*held, strict=True))))


def links(distinct: DataFrame, hot_cell: int = HOT_CELL, hot_list: int = HOT_LIST) -> DataFrame:
    """(a, b): links between the distinct fingerprints of ``distinct`` (fp) that connect all that is connected."""
    rows = distinct.select("fp").mapInArrow(giving_back(_replicated), "anchor int, fp long, moved byte")
    hot = stored(rows.groupBy("anchor").count().filter(F.col("count") > hot_cell).select("anchor", F.lit(True).alias("hot")), "hot-cells")
    if hot.limit(hot_list + 1).count() <= hot_list:
        rows = rows.join(F.broadcast(hot), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    else:
        rows = rows.withColumn("hot", F.lit(True))
    cells = rows.mapInArrow(giving_back(_split), "anchor int, free int, fp long, moved byte").repartition("anchor", "free").sortWithinPartitions("anchor", "free")
    return cells.mapInArrow(giving_back(_compared), "a long, b long")


def _roots(distinct: DataFrame) -> DataFrame:
    """``distinct`` (fp, ...) with root, one fingerprint of each one's component."""
    roots = stored(components(links(distinct)), "fingerprint-roots").withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the least doc_id that can be reached by links."""
    fps = stored(fingerprints(documents), "fingerprints", TEXT_BATCH)
    of_fp = _roots(stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints"))
    least = of_fp.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = stored(of_fp.join(least, "root").select("fp", "component_id"), "fingerprint-components")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(documents: DataFrame, dropped_list: int = DROPPED_LIST) -> DataFrame:
    """The columns of ``documents``, one row of each group: that with the least doc_id, then the least digest.

    A row is known by its number in a stored copy of the table, so that each row is kept or dropped for itself; of rows with
    one doc_id the one with the least digest of doc_id and text stays, then of the other columns, so that it doesn't depend
    on how rows are dealt. Rows without a doc_id give way to each other only: of a group, one of these stays too.

    Texts stay where they lie while the rows to drop fit a list of ``dropped_list`` numbers, which is broadcast; more are
    dropped by one join on the number.
    """
    row, key = free_name(documents, "row_number"), free_name(documents, "row_digest")
    c = F.col
    numbered = stored(documents.withColumn(row, F.monotonically_increasing_id()), "numbered")
    others = [c(f"`{x}`") for x in documents.columns if x not in ("doc_id", "text")]
    digest = F.md5(F.concat_ws(":", F.coalesce(c("doc_id").cast("string"), F.lit("")), F.coalesce(c("text").cast("string"), F.lit(""))))
    rest = F.md5(F.to_json(F.struct(*others))) if others else F.lit("")
    keyed = numbered.withColumn(key, F.concat_ws(":", digest, rest, F.lpad(c(row).cast("string"), 20, "0")))
    fps = stored(fingerprints(keyed, key), "fingerprints", TEXT_BATCH)
    named = F.when(c("doc_id").isNotNull(), F.struct("doc_id", "carried"))
    unnamed = F.when(c("doc_id").isNull(), c("carried"))
    of_fp = _roots(stored(fps.groupBy("fp").agg(F.min(named).alias("named"), F.min(unnamed).alias("unnamed")), "distinct-fingerprints"))
    kept = of_fp.groupBy("root").agg(F.min("named").alias("named"), F.min("unnamed").alias("unnamed"))
    kept = kept.select(F.explode(F.array("named.carried", "unnamed")).alias("carried")).filter("carried IS NOT NULL")
    number = lambda df: df.select(F.substring_index("carried", ":", -1).cast("bigint").alias(row))
    dropped = stored(number(fps).join(number(kept).hint("merge"), row, "left_anti"), "dropped-rows")
    few = dropped.limit(dropped_list + 1).count() <= dropped_list
    return numbered.join(F.broadcast(dropped) if few else dropped.hint("merge"), row, "left_anti").drop(row)

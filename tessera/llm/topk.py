"""Operator 4, exact top-k search by inner product in three phases with a uniform threshold.

Components become floor(256 * x). Vectors that are then equal form one class, which keeps its k + 1 smallest ids, so
thousands of copies cost as much as one. The components are cut into ``LISTS`` segments; a query's score is the sum
of its partial scores over the segments, each of which is a list of its own. Blocks of classes hold their part of all lists.

1. Each block's part of a list gives each query's k + 1 best partial scores. What is so seen is scored in full; the
   (k + 1)-th best score t of all blocks is a safe cutoff, for no class of the answer scores less.
2. The cutoff goes to all lists. A class that scores t in all has t / LISTS at least in one of them, so each list
   gives all entries from that threshold on. The known parts of a class' score, and the threshold for each part
   that no list gave, bound it from above; the fully known scores of a block raise the cutoff there.
3. Classes whose bound reaches the cutoff get their missing partial scores, and the best are taken.

Blocks of classes stay where they are: a task makes them of the rows that it reads, and blocks of queries are broadcast to
them, as many at a time as have ``CHUNK_BLOCKS`` blocks and ``CHUNK_BYTES`` bytes at most; the phases are run for
these, then for the next ones. Entries meet in the task whose block they are of, ``SLICE`` queries at a time, and are
neither stored nor shuffled: a task holds one block of classes, a few of queries and their k + 1 best scores, however many
entries there are. Vectors are shuffled once, to find equal ones; queries also to get their cutoffs and answers. Nothing but
counts and a chunk's queries, which are broadcast, reaches the driver.

Edge cases: vectors that are null, or hold nulls, NaN or infinities, and rows without an id take no part, neither as
query nor as candidate; vectors are compared only with those of the same length; equal scores go by smaller id; of
repeated ids each row is a candidate and each query row gets its own answer, leaving out one row with its own id; an
empty table gives an empty result; other columns are not carried. Components so large that scores may need more than 64
bits raise a ValueError before anything is compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, discard, giving_back, stored, stored_at

#: Segments that a vector is cut into; bits of a block's size in classes; the same for queries.
LISTS, BLOCK_BITS, QUERY_BITS = 2, 11, 10
#: Blocks of queries, and bytes of their components, that are broadcast at a time at most.
CHUNK_BLOCKS, CHUNK_BYTES = 64, 32 << 20
#: Components that a worker holds of vectors at most, but for one vector; queries of a pair of blocks that are worked on at
#: a time; bytes of pairs of blocks that a Python worker gets at a time.
HELD, SLICE, PAIR_BATCH = 1 << 21, 128, 4 << 20
SCALE = 256


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): integer vectors of the rows that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(whole, F.lit(False)))
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x)).alias("v"))


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of a batch's vectors, and all their components."""
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def _first_ids(keep: int):
    """Map-side: the ``keep`` smallest ids of each vector of a task's rows."""

    def combine(batches):
        held: dict[bytes, list[int]] = {}
        size = 0
        for batch in batches:
            lengths, flat = _vectors(batch.column("v"))
            ends = np.cumsum(lengths)
            for vec_id, start, end in zip(batch.column("vec_id").to_pylist(), ends - lengths, ends, strict=True):
                ids = held.setdefault(flat[start:end].tobytes(), [])
                size += int(end - start) + 1 if not ids else 0
                ids.append(vec_id)
                if len(ids) > 4 * keep:
                    ids[:] = sorted(ids)[:keep]
                if size > HELD:
                    yield out(held)
                    held, size = {}, 0
        if held:
            yield out(held)

    def out(held):
        flat = np.frombuffer(b"".join(held), np.int64)
        ends = np.cumsum([0, *(len(x) // 8 for x in held)])
        vectors = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([vectors, pa.array([sorted(x)[:keep] for x in held.values()], pa.list_(pa.int64()))], ["v", "ids"])

    return combine


def classes_of(rows: DataFrame, keep: int, bits: int, name: str) -> DataFrame:
    """(gid, v, dim, ids): each distinct vector with its ``keep`` smallest ids, in as many files as there are blocks at most."""
    partial = rows.mapInArrow(giving_back(_first_ids(keep)), "v array<bigint>, ids array<bigint>")
    merged = partial.groupBy("v").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))
    merged = stored(merged.select("v", F.size("v").alias("dim"), "ids"), f"{name}-classes")
    blocks = max(1, math.ceil(merged.count() / (1 << bits)))
    return stored(merged.coalesce(blocks).withColumn("gid", F.monotonically_increasing_id()), f"{name}-numbered")


def _in_blocks(rows: DataFrame, bits: int, names: tuple[str, str, str]) -> DataFrame:
    """(dim, and by ``names``: ids, values, components): rows (id, value, v) in blocks of one length, as the tasks read them.

    A block has 2^bits vectors at most, and no more than ``HELD`` components. Its components are as narrow as it allows.
    """

    def block(dim: int, ids: np.ndarray, values: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        fits = [t for t in (np.int16, np.int32) if np.iinfo(t).min <= v.min(initial=0) and v.max(initial=0) <= np.iinfo(t).max]
        of = [pa.array([dim], pa.int32()), *(pa.array([x], pa.list_(pa.int64())) for x in (ids, values)), pa.array([v.astype(fits[0] if fits else np.int64).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(of, ["dim", *names])

    def gather(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            lengths, flat = _vectors(batch.column(2))
            ids, values = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for dim in map(int, np.unique(lengths)):
                mine = lengths == dim
                new = ids[mine], values[mine], flat[np.repeat(mine, lengths)].reshape(int(mine.sum()), dim)
                new = tuple(map(np.concatenate, zip(held[dim], new, strict=True))) if dim in held else new
                size = max(1, min(1 << bits, HELD // max(1, dim)))
                whole = len(new[0]) // size * size
                for i in range(0, whole, size):
                    yield block(dim, *(x[i : i + size] for x in new))
                held[dim] = tuple(x[whole:].copy() for x in new)
                if not len(held[dim][0]):
                    del held[dim]
            if sum(x[2].size + len(x[0]) for x in held.values()) > HELD:
                for dim, rest in held.items():
                    yield block(dim, *rest)
                held = {}
        for dim, rest in held.items():
            yield block(dim, *rest)

    ids, values, flat = names
    return rows.mapInArrow(giving_back(gather), f"dim int, {ids} array<bigint>, {values} array<bigint>, {flat} binary")


def _matrix(flat: bytes, n: int, dim: int) -> np.ndarray:
    """A block's components."""
    width = len(flat) // max(1, n * dim)
    return np.frombuffer(flat, {2: np.int16, 4: np.int32}.get(width, np.int64)).reshape(n, dim)


#: Integers that these types hold exactly, and all sums of them that stay below.
EXACT = {np.float32: 2**24, np.float64: 2**53}


def _exact_type(q: np.ndarray, c: np.ndarray) -> type:
    """The fastest type in which all inner products of rows of q and of c are exact; they fit in 64 bits (``_check_size``)."""
    largest = [max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (q, c)]
    most = largest[0] * largest[1] * q.shape[1]
    return next((t for t, bound in EXACT.items() if max(most, *largest) < bound), np.int64)


def _at_least(parts: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Where a query's partial scores are no less than its integer ``least``; exact in any type of parts."""
    bound = EXACT.get(parts.dtype.type)
    return parts >= (least if bound is None else np.clip(least, -bound, bound).astype(parts.dtype))[:, None]


def _partial_scores(row: dict, lists: int) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """Exact partial scores of a pair of blocks in each list, a few queries at a time: (which queries, a matrix a list)."""
    dim = row["dim"]
    q, c = _matrix(row["qflat"], len(row["qgids"]), dim), _matrix(row["flat"], len(row["gids"]), dim)
    kind = _exact_type(q, c)
    q, c = q.astype(kind), np.ascontiguousarray(c.T.astype(kind))
    cuts = [s * dim // lists for s in range(lists + 1)]
    for i in range(0, len(q), SLICE):
        some = slice(i, min(i + SLICE, len(q)))
        yield some, [q[some, start:end] @ c[start:end] for start, end in pairwise(cuts)]


def _check_size(classes: DataFrame, lists: int) -> None:
    """Raises if a score, or one times ``lists``, may need more than 62 bits."""
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    most = classes.agg(F.max(largest * largest * F.col("dim")).alias("most")).first()["most"] or 0
    if most * lists >= 2**62:
        raise ValueError("components are so large that their inner products may need more than 64 bits")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """A dict of each row of some batches, arrays as NumPy's."""
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            yield {n: one.column(n)[0].values.to_numpy(zero_copy_only=False) if pa.types.is_list(one.schema.field(n).type) else one.column(n)[0].as_py() for n in one.schema.names}


def _lowest(lists: int) -> int:
    """A cutoff below all scores, ``lists`` times which fits in 64 bits, as all sums of both do."""
    return -(2**62 // lists)


def _best_seen(keep: int, lists: int) -> Callable:
    """Phase 1 in a task: of what its blocks' parts of the lists show of each query, the ``keep`` best full scores."""
    lowest = _lowest(lists)

    def best(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for row in _rows(batches):
            qgids, k = row["qgids"], min(keep, len(row["gids"]))
            _, scores = held.setdefault(int(qgids[0]), (qgids.copy(), np.full((len(qgids), keep), lowest, np.int64)))
            for some, parts in _partial_scores(row, lists):
                seen = np.concatenate([np.argpartition(x, x.shape[1] - k, axis=1)[:, -k:] for x in parts], axis=1)
                seen.sort(axis=1)
                score = sum(np.take_along_axis(x, seen, 1).astype(np.int64) for x in parts)
                score[:, 1:][seen[:, 1:] == seen[:, :-1]] = lowest  # seen in several lists, counts once
                score = np.concatenate([scores[some], score], axis=1)
                scores[some] = np.partition(score, score.shape[1] - keep, axis=1)[:, -keep:]
        for qgids, scores in held.values():
            known = scores > lowest
            yield pa.RecordBatch.from_pydict({"qgid": np.repeat(qgids, known.sum(axis=1)), "score": scores[known]})

    return best


def _place(q: np.ndarray) -> np.ndarray:
    """The number of each entry among those of its query, from 0; entries of a query lie together, queries ascend."""
    return np.arange(len(q)) - np.searchsorted(q, q)


def _found(keep: int, lists: int) -> Callable:
    """Phases 2 and 3 for each pair of blocks: each query's best classes that reach its cutoff."""

    def pair(row: dict) -> Iterator[pa.RecordBatch]:
        for some, parts in _partial_scores(row, lists):
            cutoffs = row["cutoffs"][some]
            given = [_at_least(x, -(-cutoffs // lists)) for x in parts]
            q, c = np.nonzero(reduce(np.logical_or, given))
            part = [x[q, c].astype(np.int64) for x in parts]
            given = [x[q, c] for x in given]
            seen = sum(x.astype(np.int64) for x in given)
            known = sum(np.where(x, y, 0) for x, y in zip(given, part, strict=True))

            full = np.flatnonzero(seen == lists)
            full = full[np.lexsort((-known[full], q[full]))]
            nth = full[_place(q[full]) == keep - 1]
            raised = cutoffs.copy()
            raised[q[nth]] = np.maximum(raised[q[nth]], known[nth])

            reach = np.flatnonzero(lists * known + (lists - seen) * cutoffs[q] >= lists * raised[q])
            score = known[reach] + sum(np.where(x[reach], 0, y[reach]) for x, y in zip(given, part, strict=True))
            best = score >= raised[q[reach]]
            q, c, score = q[reach[best]], c[reach[best]], score[best]
            order = np.lexsort((row["least"][c], -score, q))
            order = order[_place(q[order]) < keep]
            if len(order):
                yield pa.RecordBatch.from_pydict({"qgid": row["qgids"][some][q[order]], "gid": row["gids"][c[order]], "score": score[order]})

    return lambda batches: (out for row in _rows(batches) for out in pair(row))


def _chunks(asked: DataFrame, chunk_blocks: int, chunk_bytes: int) -> list[DataFrame]:
    """The queries in chunks whose blocks may be broadcast."""
    block = [F.shiftright("qgid", QUERY_BITS), F.col("dim")]
    blocks = asked.groupBy(block[0].alias("qb"), "dim").agg(F.sum(8 * (F.col("dim").cast("bigint") + 2)).alias("bytes"))
    chunk = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n))
    n, total = 1, blocks.count()
    while n < 4 * total:
        most = blocks.groupBy(chunk(n, "qb", "dim").alias("chunk")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).agg(F.max("n").alias("n"), F.max("bytes").alias("bytes")).first()
        if most["n"] <= chunk_blocks and most["bytes"] <= chunk_bytes:
            break
        n *= 2
    return [asked.filter(chunk(n, *block) == i) for i in range(n)] if total else []


def _answers(classes: DataFrame, asked: DataFrame, keep: int, lists: int) -> DataFrame:
    """(qgid, gid, score): of each query of a chunk, its ``keep`` best classes at least."""
    blocks = _in_blocks(classes.select("gid", F.element_at("ids", 1).alias("least"), "v"), BLOCK_BITS, ("gids", "least", "flat"))

    def pairs(cutoffs: DataFrame) -> DataFrame:
        return blocks.join(F.broadcast(_in_blocks(cutoffs.select("qgid", "cutoff", "v"), QUERY_BITS, ("qgids", "cutoffs", "qflat"))), "dim")

    lowest, spark = F.lit(_lowest(lists)), classes.sparkSession
    best = pairs(asked.withColumn("cutoff", lowest)).mapInArrow(giving_back(_best_seen(keep, lists)), "qgid long, score long")
    with arrow_batches(spark, PAIR_BATCH):
        best, path = stored_at(best, "topk-seen")
    of_query = Window.partitionBy("qgid").orderBy(F.desc("score"))
    cutoff = best.withColumn("n", F.row_number().over(of_query)).filter(F.col("n") == keep).select("qgid", F.col("score").alias("cutoff"))
    cutoffs = asked.join(cutoff, "qgid", "left").withColumn("cutoff", F.coalesce("cutoff", lowest))
    found = stored(pairs(cutoffs).mapInArrow(giving_back(_found(keep, lists)), "qgid long, gid long, score long"), "topk-found", PAIR_BATCH)
    discard(spark, path)
    return found


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE, lists: int = LISTS, chunk_blocks: int = CHUNK_BLOCKS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows of every row for which ``is_query`` (of vec_id) holds."""
    keep = k + 1
    rows = quantised(vectors, scale)
    queries = rows.filter(is_query)
    classes = classes_of(rows, keep, BLOCK_BITS, "topk")
    _check_size(classes, lists)
    asked = classes_of(queries, 1, QUERY_BITS, "topk-asked").drop("ids").withColumnsRenamed({"gid": "qgid"})
    found = [_answers(classes, chunk, keep, lists) for chunk in _chunks(asked, chunk_blocks, chunk_bytes)]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    members = reduce(DataFrame.unionByName, found).join(classes.select("gid", "ids"), "gid").select("qgid", "score", F.explode("ids").alias("vec_id"))
    by_score = Window.partitionBy("qgid").orderBy(F.desc("score"), "vec_id")
    members = members.withColumn("n", F.row_number().over(by_score)).filter(F.col("n") <= keep)
    answers = members.groupBy("qgid").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("r")).join(asked.select("qgid", "v"), "qgid")
    own = F.array_position(F.transform("r", lambda x: x["vec_id"]), F.col("vec_id"))
    answer = queries.join(answers, "v").withColumn("own", own.cast("int"))
    others = F.when(F.col("own") > 0, F.filter("r", lambda x: x["n"] != F.col("own"))).otherwise(F.col("r"))
    return answer.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id"), F.col("x.score"))

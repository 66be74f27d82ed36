"""Operator 5, token files of directly addressable codes.

An id is split into chunks of 8 bits. Level 0 holds the lowest chunk of every id; a bitmap tells which ids go on in
level 1, which holds their next chunks without gaps, and so forth. A rank directory holds the ones before every
block of 512 bits, so that token i is found by one look-up a level: its chunk in level l + 1 stands at the number of
ones before it in level l. No block is decoded for that (``token_at``).

Documents are encoded where they lie and dealt into shards by ranges of doc_id; a shard writes its documents in
ascending doc_id as segments of whole documents, about ``SEGMENT_TOKENS`` ids each, with every document's id, first
token and length beside them. Files are Parquet tables of segments in the shared folder.

Edge cases: a null or empty text has the end id alone; rows with a null doc_id come first; rows with the same doc_id
follow each other, ordered by their ids, in one shard, which is sorted with spills but not split; a very long text makes a segment of its own; an empty table gives empty
files and an empty result; other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored
from .tokens import encoder, text_slices

#: Fixed value of the contract: the id that ends each document.
END_ID = 2
#: Documents in a shard, about; ids in a segment, about.
SHARD_DOCS, SEGMENT_TOKENS = 8192, 1 << 18
#: Shards at most; beyond that they hold more documents. Bounds what the driver holds of the quantiles (16 bytes each), the
#: totals that are broadcast (12 bytes a shard), and the sketch of 100 entries a shard that one task merges (some 100 MB).
MOST_SHARDS = 20_000
CHUNK_BITS, RANK_BITS = 8, 512

LEVEL = pa.struct([("chunks", pa.binary()), ("bitmap", pa.binary()), ("ranks", pa.binary())])
DOC = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
SEGMENT = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("levels", pa.list_(LEVEL)), ("docs", pa.list_(DOC))])
SEGMENT_DDL = (
    "shard int, segment int, first long, n_tokens long, levels array<struct<chunks:binary,bitmap:binary,ranks:binary>>, docs array<struct<doc_id:long,start:long,n_tokens:long>>"
)


def dac_levels(ids: np.ndarray) -> list[dict[str, bytes]]:
    """The levels of an array of unsigned ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK_BITS
        goes_on = more > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        ones = np.add.reduceat(goes_on, np.arange(0, len(goes_on), RANK_BITS), dtype=np.int64) if len(goes_on) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(ones) else ones
        levels.append({"chunks": rest.astype(np.uint8).tobytes(), "bitmap": bitmap.tobytes(), "ranks": ranks.astype("<u4").tobytes()})
        if not goes_on.any():
            return levels
        rest = more[goes_on]


def dac_ids(levels: list[dict[str, bytes]]) -> np.ndarray:
    """All ids of a segment, as unsigned 32-bit integers."""
    out = None
    for level in reversed(levels):
        chunks = np.frombuffer(level["chunks"], np.uint8).astype(np.uint32)
        if out is not None:
            goes_on = np.unpackbits(np.frombuffer(level["bitmap"], np.uint8), count=len(chunks), bitorder="little").astype(bool)
            chunks[goes_on] |= out << CHUNK_BITS
        out = chunks
    return out


def token_at(levels: list[dict[str, bytes]], i: int) -> int:
    """Token ``i`` of a segment: a byte, a bit and a rank from each level, nothing else."""
    found = 0
    for depth, level in enumerate(levels):
        found |= level["chunks"][i] << (CHUNK_BITS * depth)
        bitmap = level["bitmap"]
        if not bitmap[i >> 3] >> (i & 7) & 1:
            break
        block = i // RANK_BITS
        before = int.from_bytes(bitmap[block * RANK_BITS // 8 : (i >> 3) + 1], "little") & ((1 << (i - block * RANK_BITS)) - 1)
        i = int.from_bytes(level["ranks"][4 * block : 4 * block + 4], "little") + before.bit_count()
    return found


def _encode(bounds: list[int], vocabulary: str | None, end_id: int):
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        end, width = np.asarray([end_id], own.dtype).tobytes(), own.dtype.itemsize
        for batch in batches:
            doc_ids = batch.column("doc_id")
            keys = doc_ids.fill_null(-(2**63)).to_numpy()
            shards = np.searchsorted(np.asarray(bounds, np.int64), keys, side="left").astype(np.int32)
            for a, b, texts in text_slices(batch.column("text")):
                ids = [x + end for x in own.encode(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(shards[a:b]), doc_ids.slice(a, b - a), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return encode


def _segments(segment_tokens: int):
    """Sorted documents of one or more shards to segments."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, first, size, held, docs = None, 0, 0, 0, [], []

        def out() -> pa.RecordBatch:
            ids = np.concatenate(held)
            return pa.RecordBatch.from_pylist([{"shard": shard, "segment": number, "first": first, "n_tokens": size, "levels": dac_levels(ids), "docs": docs}], SEGMENT)

        for batch in batches:
            for of, doc_id, n, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n_tokens", "ids")), strict=True):
                if held and (of != shard or size >= segment_tokens):
                    yield out()
                    number, first, size, held, docs = number + 1, first + size, 0, [], []
                if of != shard:
                    shard, number, first = of, 0, 0
                docs.append({"doc_id": doc_id, "start": first + size, "n_tokens": n})
                held.append(np.frombuffer(ids, f"<u{len(ids) // n}"))
                size += n
        if held:
            yield out()

    return segments


def write_tokens(documents: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, shard_docs: int = SHARD_DOCS, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Token files of ``documents`` (doc_id, text): one row a segment, as of ``SEGMENT``; written before it returns.

    Shards are ranges of doc_id between approximate quantiles, the only figures that reach the driver. A shard is sorted
    with spills and written segment by segment, so its size doesn't bear on memory.
    """
    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    shards = min(MOST_SHARDS, max(1, math.ceil(rows.select("doc_id").count() / shard_docs)))
    quantiles = rows.select(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], 100 * shards).alias("q")).first()["q"] if shards > 1 else []
    bounds = sorted(set(quantiles or []))
    coded = rows.mapInArrow(_encode(bounds, vocabulary, end_id), "shard int, doc_id long, n_tokens long, ids binary")
    dealt = coded.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "doc_id", "ids")
    return stored(dealt.mapInArrow(_segments(segment_tokens), SEGMENT_DDL), "tokens")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit) from token files."""
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("shard", "first", "levels", "docs")}
                whole, first = dac_ids(row["levels"]).astype("<u4").tobytes(), row["first"]
                part = [{"shard": row["shard"], **d, "ids": whole[4 * (d["start"] - first) : 4 * (d["start"] - first + d["n_tokens"])]} for d in row["docs"]]
                yield pa.RecordBatch.from_pylist(part, schema)

    sizes = stored(files.groupBy("shard").agg(F.sum("n_tokens").alias("n")), "token-shards")
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    docs = files.select("shard", "first", "levels", "docs").mapInArrow(read, "shard int, doc_id long, start long, n_tokens long, ids binary")
    return docs.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids")

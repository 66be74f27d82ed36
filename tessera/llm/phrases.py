"""Operator 13, phrase collocations: candidates from a sketch, exact counts by automata, then thresholds.

1. Every task counts the hashes of all phrases of its shards into a table of ``CELLS`` cells, which stop at the least
   count asked for. Summed over tasks, a cell is an upper bound of the counts of its phrases, so phrases of cells
   below the least count are none. One bit a cell says so; these bits (16 MB, whatever the input) go out to all tasks.
2. Every task takes, shard by shard, the phrases that the bits let through with all their parts, compiles them into an Aho-Corasick automaton
   and scans the shard with it. Phrases and text have a delimiter before and after each word, so that a match begins
   and ends at words, and a mark between pieces, so that none crosses them. Overlapping matches all count. Matches are
   summed by shard, by task and then over all.
3. Phrases that reach the least count are the candidates; their cuts, scores and longer phrases are joins and groupings.

The bound is one-sided: a phrase in a full cell is counted, found to be too rare and left out, so that the result is the
same whatever the size of the sketch, and where a corpus fills it the scan counts every phrase. A shard holds
``SHARD_BYTES`` of text of one language and longer texts are cut between pieces; an automaton holds ``MOST_PATTERNS``
phrases at most, and a shard with more is scanned by several. Nothing that grows with the input is broadcast or collected.

Edge cases: a null text is empty; a null lang is ``und``, together with those that are ``und``; texts without words add
nothing; repeated rows count each; equal scores go by count, then phrase; an empty table gives an empty result; other
columns are not read. A piece is held whole, however long.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Cells of the sketch, and of one of the segments in which it is shuffled.
CELLS, SEGMENT = 1 << 27, 1 << 20
SHARD_BYTES, MOST_PATTERNS = 8 << 20, 200_000
#: Fixed value: the contract's borders of pieces. Any of them can mark a border afterwards, as no word holds one.
BORDERS = b".,;:!?\n\x0b\x0c\r"
MARK = b"."
FOLDED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + BORDERS, b"abcdefghijklmnopqrstuvwxyz " + MARK * len(BORDERS))
MIX = np.uint64(0x9E3779B97F4A7C15)


def shards(batches: Iterator[pa.RecordBatch], most: int = SHARD_BYTES) -> Iterator[tuple[str, pa.Array]]:
    """(lang, words) of the batches' texts (lang, text), some megabytes at a time; a mark stands between pieces and texts."""
    for batch in batches:
        held: dict[str, list[bytes]] = {}
        size = 0
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            folded = (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(FOLDED)
            while folded:
                cut = len(folded) if len(folded) <= most else folded.rfind(MARK, 0, most) + 1 or folded.find(MARK) + 1 or len(folded)
                held.setdefault(lang, []).append(folded[:cut])
                size, folded = size + cut, folded[cut:]
                if size >= most:
                    yield from _split(held)
                    held, size = {}, 0
        yield from _split(held)


def _split(held: dict[str, list[bytes]]) -> Iterator[tuple[str, pa.Array]]:
    for lang, texts in held.items():
        text = MARK.join(texts).replace(MARK, b" " + MARK + b" ").strip()
        if text:
            yield lang, pc.ascii_split_whitespace(pa.array([text], pa.large_binary()).cast(pa.large_string())).flatten()


class Windows:
    """The phrases of a shard of words, as codes of its vocabulary and places."""

    def __init__(self, lang: str, words: pa.Array, longest: int):
        coded = words.dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        self.codes, self.longest = coded.indices.to_numpy().astype(np.int64), longest
        mark = MARK.decode()
        self.word = self.codes != (self.words.index(mark) if mark in self.words else -1)
        seed = xxhash.xxh64_intdigest(lang)
        self.hash_of = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))

    def phrases(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of words, where each phrase of so many begins, its hash)."""
        hashes = self.hash_of[self.codes]
        for k in range(1, self.longest + 1):
            inside = self.word if k == 1 else inside[:-1] & self.word[k - 1 :]
            running = hashes if k == 1 else (running[:-1] ^ (running[:-1] >> np.uint64(29))) * MIX + hashes[k - 1 :]
            starts = np.flatnonzero(inside)
            found = running[starts]
            yield k, starts, found ^ (found >> np.uint64(32))

    def distinct(self, k: int, starts: np.ndarray) -> list[str]:
        """The different phrases of k words that begin at some places."""
        n = max(2, len(self.words))
        if n**k >= 1 << 62:  # too many for one number each
            return list(dict.fromkeys(" ".join(self.words[c] for c in self.codes[i : i + k].tolist()) for i in starts.tolist()))
        key = np.zeros(len(starts), np.int64)
        for i in range(k):
            key = key * n + self.codes[starts + i]
        key, columns = np.unique(key), []
        for _ in range(k):
            key, code = np.divmod(key, n)
            columns.append(map(self.words.__getitem__, code.tolist()))
        return list(map(" ".join, zip(*columns[::-1], strict=True)))


def _counted(longest: int, least: int, cells: int, shard_bytes: int):
    """Map-side sketch: a task's cells, in packed segments."""

    def counted(batches):
        table = np.zeros(cells, np.uint8)
        for lang, words in shards(batches, shard_bytes):
            for _, _, hashes in Windows(lang, words, longest).phrases():
                at, n = np.unique((hashes & np.uint64(cells - 1)).astype(np.int64), return_counts=True)
                table[at] = np.minimum(table[at] + np.minimum(n, least), least)
        segment = min(SEGMENT, cells)
        for i in range(cells // segment):
            part = table[i * segment : (i + 1) * segment]
            if part.any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([i], pa.int32()), "cells": pa.array([zlib.compress(part, 1)], pa.binary())})

    return counted


def _reaching(least: int, cells: int):
    """Reduce-side sketch: for each segment, one bit a cell, set if the sum over all tasks reaches the least count."""

    def reaching(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(batch.column("segment").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(packed), np.uint8)
                sums[i] = np.minimum(sums[i] + part, least) if i in sums else part
        for i, part in sums.items():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([i], pa.int32()), "bits": pa.array([np.packbits(part >= least).tobytes()], pa.binary())})

    return reaching


def sketch(texts: DataFrame, longest: int, least: int, cells: int = CELLS, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """A bit for each cell (packed): whether the phrases of this hash may occur ``least`` times, all together."""
    segment = min(SEGMENT, cells)
    parts = texts.mapInArrow(_counted(longest, least, cells, shard_bytes), "segment int, cells binary").repartition(cells // segment, "segment")
    bits = np.zeros(cells // 8, np.uint8)
    for row in parts.mapInArrow(_reaching(least, cells), "segment int, bits binary").toLocalIterator():
        bits[row["segment"] * segment // 8 : (row["segment"] + 1) * segment // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def matches(patterns: list[str], words: pa.Array, most: int = MOST_PATTERNS) -> np.ndarray:
    """How often each pattern occurs among the words, overlapping ones included."""
    whole = pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words)
    text, counts = f" {pc.binary_join(whole, pa.scalar(' ', words.type))[0].as_py()} ", [np.zeros(0, np.int64)]
    for i in range(0, len(patterns), most):
        some = patterns[i : i + most]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for at, pattern in enumerate(some):
            automaton.add_word(f" {pattern} ", at)
        automaton.make_automaton()
        counts.append(np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64), minlength=len(some)))
    return np.concatenate(counts)


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, cells: int = CELLS, shard_bytes: int = SHARD_BYTES, patterns: int = MOST_PATTERNS) -> DataFrame:
    """(lang, phrase, k, f): exact counts of all phrases of k = 1 to ``longest`` words that occur ``least`` times; k = 0: all words."""
    if not 1 <= least <= 255 or cells & (cells - 1) or cells < 8:
        raise ValueError("least must be from 1 to 255, cells a power of two")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    spread = docs.sparkSession.sparkContext.broadcast(sketch(texts, longest, least, cells, shard_bytes))

    def scanned(batches):
        bits = spread.value
        for lang, words in shards(batches, shard_bytes):
            windows = Windows(lang, words, longest)
            shorter, found, size = np.ones(len(words), bool), [""], [0]
            for k, starts, hashes in windows.phrases():
                if k > 1:  # a phrase is no more frequent than its first words and its last
                    both = shorter[starts] & shorter[starts + 1]
                    starts, hashes = starts[both], hashes[both]
                cell = (hashes & np.uint64(cells - 1)).astype(np.int64)
                passed = starts[(bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1]
                shorter = np.zeros(len(words), bool)
                shorter[passed] = True
                found += windows.distinct(k, passed)
                size += [k] * (len(found) - len(size))
            counts = np.append(int(windows.word.sum()), matches(found[1:], words, patterns))
            for i in range(0, len(found), 50_000):
                columns = [pa.array([lang] * len(found[i : i + 50_000]), pa.string()), pa.array(found[i : i + 50_000], pa.string()), pa.array(size[i : i + 50_000], pa.int32()), pa.array(counts[i : i + 50_000])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "k", "f"])

    found = texts.mapInArrow(scanned, "lang string, phrase string, k int, f bigint")
    return found.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("k") == 0))


def _words(first: Column | int, n: Column | int) -> Column:
    """Some words of ``phrase``."""
    return F.array_join(F.slice(F.split("phrase", " "), first, n), " ")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, cells: int = CELLS, shard_bytes: int = SHARD_BYTES, patterns: int = MOST_PATTERNS) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of 2 to ``longest`` words that are no mere part of a longer one.

    a: how often the phrase occurs; l and r: how often its two parts do, at the cut that gives the least score,
    floor(10^6 a² / (l r)); n: words of its language. A phrase within a longer one that occurs ``percent`` of its times
    at least is left out.
    """
    counts = stored(phrase_counts(docs, longest, least, cells, shard_bytes, patterns), "phrases")
    candidates, parts = counts.filter("k >= 2"), counts.filter("k >= 1").select("lang", "phrase", "f")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "cut", _words(F.lit(1), F.col("cut")).alias("first"), _words(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    of = lambda part, f: parts.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    wide = lambda a, b: f"(CAST({a} AS DECIMAL(15,0)) * CAST({b} AS DECIMAL(15,0)))"
    score = F.expr(f"CAST(1000000 * {wide('a', 'a')} AS DECIMAL(38,0)) div {wide('l', 'r')}")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.*")
    place = F.explode(F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"))
    longer = candidates.filter("k > 2").select("lang", F.col("f"), place.alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(f"longer IS NULL OR 100 * longer < {percent} * a")
    totals = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    return kept.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def best_collocations(found: DataFrame, first: int = 2000) -> DataFrame:
    """``found`` with rank: each lang's ``first`` ones by score, then count, then phrase."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Operator 12, byte-level BPE: encoding by a segment tree over the ranks of adjacent pairs, and decoding.

A text is cut into pieces as the vocabulary's pre-tokenizer does, and a piece into bytes. The leaves of a piece's tree
hold, for each symbol, the rank of its pair with the symbol after it and its place; an inner node holds the least of
its two. So the root is the leftmost pair of the lowest rank: it is merged, and the leaves of the merged symbol, of the one
before it and of the one swallowed are set anew, each by as many steps as the tree is high, until no pair is left that
merges. The cost of a piece of n bytes is n log n, however long it is. Short pieces of one size are worked on together, as
rows of a matrix with a tree in each.

Each worker keeps the ids of pieces that it has met, in two generations, because pieces recur. Letters, numbers and
spaces are what the library's pre-tokenizer takes for such, learnt from it character by character, so that its version of
Unicode counts. Nothing is broadcast or collected; a task holds a slice of its rows' texts, and the tree of one piece.

Edge cases: a null text is empty; an empty text has no ids and decodes to an empty text; an added token's string within
a text is that token, as in the library; each of repeated rows gets its own result; rows without a doc_id are encoded like
any other; an empty table gives an empty result; other columns are not carried, so that their names don't matter. Ids
that aren't of the vocabulary raise a ValueError. A piece without a border (a run of letters of some megabytes) takes
some 200 bytes of memory a byte.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import text_slices

#: Pieces in each of the two generations that a worker keeps at most, and characters of a piece that is kept.
KEPT_PIECES, KEPT_CHARS = 400_000, 64
#: Characters below this one are named in the pattern; those above are replaced by one of their kind before matching.
NAMED = 0x3100
#: One character of each kind, below ``NAMED``: letters, numbers, spaces, others.
LIKE = {"L": "é", "N": "²", "S": " ", "O": "#"}
#: Bytes of texts that are encoded at a time; bytes of a piece up to which trees grow together, and how many at most.
SLICE_BYTES, TOGETHER, ROWS = 2 << 20, 64, 1 << 14
NONE = 1 << 62


def default_vocabulary() -> str:
    """Path of the contract's vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Kinds(dict):
    """Code point to the character that stands for it in matching, learnt from the library when first met."""

    def __init__(self, cuts):
        self.cuts = cuts

    def kind(self, c: str) -> str:
        return next((kind for kind, of in (("L", "a"), ("N", "1"), ("O", "!")) if len(self.cuts(of + c)) == 1), "S")

    def __missing__(self, code: int) -> int | str:
        self[code] = code if code < NAMED else LIKE[self.kind(chr(code))]
        return self[code]


class Codec:
    """Encodes and decodes with one vocabulary file of the tokenizers library; ids are little-endian 32-bit bytes."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = path or default_vocabulary()
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        model, before = given["model"], given["pre_tokenizer"]
        simple = not model.get("dropout") and not model.get("ignore_merges") and given["normalizer"] is None
        if model["type"] != "BPE" or not simple or before != before | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in given["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take white space or words")
        ids = model["vocab"]
        letters = byte_letters()
        self.of_byte = np.array([ids[c] for c in letters])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {ids[a] << 32 | ids[b]: rank << 32 for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.made = [ids[a + b] for a, b in pairs]
        self.pairs = np.array(sorted(self.ranks), np.int64)
        self.pair_ranks = np.array([self.ranks[pair] for pair in self.pairs.tolist()], np.int64)
        self.added = {t["content"]: t["id"] for t in given["added_tokens"]}
        self.is_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")
        bytes_of = {c: b for b, c in enumerate(letters)}
        both = ids | self.added
        self.table: list[bytes | None] = [None] * (max(both.values()) + 1)
        for token, i in both.items():
            self.table[i] = bytes(map(bytes_of.__getitem__, token)) if bytes_of.keys() >= set(token) else token.encode()
        self.stand_ins = Kinds(Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str)
        self.pieces = self._pattern()
        self.beyond = re.compile(f"[{chr(NAMED)}-\U0010ffff]")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pattern(self) -> re.Pattern:
        """What a piece is: a run of one kind, with a space before it or not; a contraction's end; white space."""
        named = {kind: "" for kind in "LNSO"}
        for code in range(NAMED):
            named[self.stand_ins.kind(chr(code))] += chr(code)
        letter, number, space = (re.escape(named[kind]) for kind in "LNS")
        return re.compile(rf" ?[{letter}]+| ?[{number}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{letter}{number}{space}]+|[{space}]+(?![^{space}])|[{space}]+")

    def cut(self, text: str) -> list[str]:
        """The pieces of a text, added tokens among them; together they are the text."""
        at, pieces = 0, []
        for m in self.is_added.finditer(text):
            pieces += [*self._plain(text[at : m.start()]), m[0]]
            at = m.end()
        return pieces + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if not self.beyond.search(text):
            return self.pieces.findall(text)
        like = text.translate(self.stand_ins)
        return [text[m.start() : m.end()] for m in self.pieces.finditer(like)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        cut = [self.cut(text or "") for text in texts]
        met = set().union(*cut)
        new = met - self.known.keys()
        if len(self.known) + len(new) > KEPT_PIECES:
            self.older, self.known, new = self.known, {}, met
        old = new & self.older.keys()
        self.known.update(zip(old, map(self.older.__getitem__, old), strict=True))
        self.known.update(self._learnt(list(new - old)))
        ids = [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]
        for piece in [piece for piece in new if len(piece) > KEPT_CHARS]:
            del self.known[piece]
        return ids

    def _learnt(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Pieces and their ids: those of a size together, long ones alone."""
        sizes: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            if piece in self.added:
                yield piece, np.array([self.added[piece]], "<u4").tobytes()
            else:
                coded = piece.encode()
                sizes.setdefault(1 << (len(coded) - 1).bit_length(), []).append((piece, coded))
        for size, of_size in sizes.items():
            if size > TOGETHER:
                for piece, coded in of_size:
                    yield piece, np.array(merged(self.of_byte[np.frombuffer(coded, np.uint8)].tolist(), self.ranks, self.made), "<u4").tobytes()
                continue
            for i in range(0, len(of_size), ROWS):
                some = of_size[i : i + ROWS]
                n = np.fromiter((len(coded) for _, coded in some), np.int64, len(some))
                inside = np.arange(size) < n[:, None]
                symbols = np.full((len(some), size + 1), -1, np.int64)
                symbols[:, :-1][inside] = self.of_byte[np.frombuffer(b"".join(coded for _, coded in some), np.uint8)]
                merged_together(symbols, n, self.pairs, self.pair_ranks, np.array(self.made))
                left = symbols >= 0
                ends = (4 * np.cumsum(left.sum(axis=1))).tolist()
                whole, start = symbols[left].astype("<u4").tobytes(), 0
                for (piece, _), end in zip(some, ends, strict=True):
                    yield piece, whole[start:end]
                    start = end

    def decode(self, ids: bytes) -> str:
        """The text of some ids; bytes that aren't UTF-8 become replacement characters."""
        try:
            return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        except (IndexError, TypeError):
            raise ValueError("an id is not of the vocabulary") from None


def merged(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """``symbols`` after all merges, always the leftmost of the lowest rank next. ranks: pair to its rank << 32."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(symbols[i] << 32 | symbols[i + 1], NONE) | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n))
    while (root := tree[1]) < NONE:
        at = root & 0xFFFFFFFF
        gone = after[at]
        symbols[at], symbols[gone] = made[root >> 32], -1
        right = after[at] = after[gone]
        before[right] = at
        left = before[at]
        for place in (gone, at, left):
            if place < 0:
                continue
            if place == gone or after[place] == n:
                leaf = NONE
            else:
                leaf = get(symbols[place] << 32 | symbols[after[place]], NONE) | place
            i = size + place
            tree[i] = leaf
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                least = a if a < b else b
                if tree[i] == least:
                    break
                tree[i] = least
    return [s for s in symbols if s >= 0]


def merged_together(symbols: np.ndarray, n: np.ndarray, pairs: np.ndarray, pair_ranks: np.ndarray, made: np.ndarray) -> None:
    """As ``merged``, in place, for the rows of a matrix: each of n symbols, then -1, as in its last column. One tree a row.

    All rows whose root still has a pair merge it in the same step. pairs: sorted, with their ranks << 32.
    """
    rows, size = len(symbols), symbols.shape[1] - 1
    heap = np.full((rows, 2 * size), NONE, np.int64)
    places = np.arange(size)

    def leaf(a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        pair = a << 32 | b
        at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
        return np.where((pairs[at] == pair) & (a >= 0) & (b >= 0), pair_ranks[at] | place, NONE)

    heap[:, size:] = leaf(symbols[:, :-1], symbols[:, 1:], places)
    level = size
    while level > 1:
        level //= 2
        heap[:, level : 2 * level] = np.minimum(heap[:, 2 * level : 4 * level : 2], heap[:, 2 * level + 1 : 4 * level : 2])
    # a place after the last symbol is ``size``, and so is one before the first: its symbol is -1 and nothing is kept there
    after = np.minimum(np.broadcast_to(places + 1, (rows, size)), size)
    after = np.where(after < n[:, None], after, size)
    before = np.broadcast_to(np.append(places - 1, size), (rows, size + 1)).copy()
    before[:, 0] = size
    after = np.concatenate([after, np.full((rows, 1), size)], axis=1)
    row = np.flatnonzero(heap[:, 1] < NONE)
    while len(row):
        root = heap[row, 1]
        at = root & 0xFFFFFFFF
        gone = after[row, at]
        right, left = after[row, gone], before[row, at]
        symbols[row, at], symbols[row, gone] = made[root >> 32], -1
        after[row, at], before[row, right] = right, at
        heap[row, size + gone] = NONE
        heap[row, size + at] = leaf(symbols[row, at], symbols[row, right], at)
        some = left < size
        heap[row[some], size + left[some]] = leaf(symbols[row[some], left[some]], symbols[row[some], at[some]], left[some])
        twice, node = np.concatenate([row, row, row]), size + np.concatenate([gone, at, np.where(some, left, at)])
        while node[0] > 1:
            node >>= 1
            heap[twice, node] = np.minimum(heap[twice, 2 * node], heap[twice, 2 * node + 1])
        row = row[heap[row, 1] < NONE]


@cache
def codec(path: str | None = None) -> Codec:
    """This worker's codec for a vocabulary file; ``path`` None: the contract's, found on the worker."""
    return Codec(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens: long, ids: binary, unsigned little-endian 32-bit integers) of each row of ``docs`` (doc_id, text)."""

    def encoded(batches):
        of = codec(path)
        for batch in batches:
            for start, end, texts in text_slices(batch.column("text"), SLICE_BYTES):
                ids = of.encode(texts.to_pylist())
                columns = [batch.column("doc_id").slice(start, end - start), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encoded, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, text): what ``encode`` returns with the text of each row's ids; null ids: an empty text."""

    def decoded(batches):
        of = codec(path)
        for batch in batches:
            for start, end, ids in text_slices(batch.column("ids")):
                texts = pa.array([of.decode(x or b"") for x in ids.to_pylist()], pa.string())
                yield batch.slice(start, end - start).append_column("text", texts)

    kinds = dict(encoded.dtypes)
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(decoded, f"doc_id {kinds['doc_id']}, n_tokens {kinds['n_tokens']}, ids binary, text string")

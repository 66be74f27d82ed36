"""Token ids of whole texts, with the tokenizers library, for the operators that write or pack them.

A text's ids are the ids of its runs between white space, one after the other, for tokenizers that drop white space
and never look across it (``word_bpe_49k.json``). Arrow finds the distinct runs of a batch and parts plain ones into a
word, in lower case, and the marks after it, whose ids follow each other. Words recur, so each worker keeps the ids of
those it has met; new words are encoded together and told apart by word ends, runs that aren't plain by marker runs
between them. NumPy puts the ids of all runs in order.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words in each of the two generations that a worker keeps at most (some 200 bytes each). When the younger is full it
#: becomes the older one, and words that are met again move to the new.
KEPT_WORDS = 400_000
#: Runs encoded in one call of the library.
RUNS_A_TEXT, TEXTS_A_CALL = 1000, 16
#: Letters that the tokenizer's normaliser lower-cases one by one (Latin, but for those that change their
#: length); marks after a word, of which a plain run has this many at most.
WORD = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+$"
MARKS, MOST_MARKS = ".,!?;:", 2
#: Fixed value: what ends the last token of each word and mark.
WORD_END = "</w>"
#: Fixed value: a run of one control character, which encodes as ids that no other run begins with.
MARKER = "\x00"


def default_vocabulary() -> str:
    """Path of the contract's vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def gathered(pool: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of ``pool`` (of ``sizes``, end to end) in the order of ``index``, and where each then ends."""
    starts, n = np.cumsum(sizes) - sizes, sizes[index]
    ends = np.cumsum(n)
    places = np.repeat(starts[index] - (ends - n), n)
    places += np.arange(len(places))
    return pool[places], ends


def parted(runs: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(word, marks) of each run: a plain run's word in lower case and its marks; any other run whole, and no marks."""
    word = pc.ascii_rtrim(runs, MARKS)
    n = pc.subtract(pc.binary_length(runs), pc.binary_length(word))
    plain = pc.and_(pc.match_substring_regex(word, WORD), pc.less_equal(n, MOST_MARKS))
    n = pc.if_else(plain, n, 0)
    marks = pc.choose(n, "", *(pc.utf8_slice_codeunits(runs, start=-k) for k in range(1, MOST_MARKS + 1)))
    return pc.if_else(plain, pc.utf8_lower(word), runs), marks


class Encoder:
    """Ids of texts as little-endian bytes: unsigned, of 16 bits if the vocabulary allows it, else of 32."""

    def __init__(self, path: str | None = None, kept: int = KEPT_WORDS):
        self.kept = kept
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_vocabulary())
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        self.ends = np.fromiter(((self.tokenizer.id_to_token(i) or "").endswith(WORD_END) for i in range(size)), bool, size)
        (self.marker,) = self.tokenizer.encode(MARKER, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        """Encodes words and runs that aren't plain."""
        plain, marked, word = [], [], re.compile(WORD)
        for run in words:
            if word.match(run):
                plain.append(run)
            elif MARKER in run:
                self.words[run] = self._alone(run)
            else:
                marked.append(run)
        for part, ids in self._joined(plain, " "):
            self._keep(part, ids, np.flatnonzero(self.ends[ids]) + 1, 0)
        for part, ids in self._joined(marked, f" {MARKER} "):
            self._keep(part, ids, np.append(np.flatnonzero(ids == self.marker), len(ids)), 1)

    def _alone(self, run: str) -> bytes:
        return np.asarray(self.tokenizer.encode(run, add_special_tokens=False).ids, self.dtype).tobytes()

    def _joined(self, runs: list[str], by: str) -> Iterator[tuple[list[str], np.ndarray]]:
        """Some runs and the ids of their text, again and again."""
        parts = [runs[i : i + RUNS_A_TEXT] for i in range(0, len(runs), RUNS_A_TEXT)]
        for i in range(0, len(parts), TEXTS_A_CALL):
            some = parts[i : i + TEXTS_A_CALL]
            for part, encoding in zip(some, self.tokenizer.encode_batch_fast([by.join(p) for p in some], add_special_tokens=False), strict=True):
                yield part, np.asarray(encoding.ids, self.dtype)

    def _keep(self, runs: list[str], ids: np.ndarray, ends: np.ndarray, between: int) -> None:
        """Cuts the ids of some runs apart: each ends at its place in ``ends``, the next begins ``between`` later."""
        width, whole, start = self.dtype.itemsize, ids.tobytes(), 0
        for run, end in zip(runs, (ends * self.dtype.itemsize).tolist(), strict=True):
            self.words[run] = whole[start:end]
            start = end + between * width

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """The ids of each text; a null text has none."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        coded = split.flatten().dictionary_encode()
        words, marks = (x.dictionary_encode() for x in parted(coded.dictionary))
        ids = self._ids(words.dictionary.to_numpy(zero_copy_only=False).tolist()) + list(map(self._alone, marks.dictionary.to_pylist()))
        width, pool = self.dtype.itemsize, np.frombuffer(b"".join(ids), self.dtype)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        pairs = np.stack([words.indices.to_numpy(), marks.indices.to_numpy() + len(words.dictionary)], axis=1).ravel()
        pool, ends = gathered(pool, sizes, pairs)
        pool, ends = gathered(pool, np.diff(ends[1::2], prepend=0), coded.indices.to_numpy())
        whole, runs = pool.tobytes(), np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))
        bounds = (np.append(0, ends)[runs] * width).tolist()
        for start, end in zip(bounds, bounds[1:], strict=False):
            yield whole[start:end]

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each of some distinct words."""
        found = list(map(self.words.get, words))
        new = [w for w, ids in zip(words, found, strict=True) if ids is None]
        if not new:
            return found
        if len(self.words) + len(new) > self.kept:
            self.older, self.words, new = self.words, {}, words
        known = [w for w in new if w in self.older]
        self.words.update(zip(known, map(self.older.__getitem__, known), strict=True))
        if len(known) < len(new):
            self._learn([w for w in new if w not in self.words] if known else new)
        return list(map(self.words.__getitem__, words))


_encoders: dict[tuple[str | None, int], Encoder] = {}


def encoder(path: str | None = None, kept: int = KEPT_WORDS) -> Encoder:
    """This worker's encoder for a vocabulary file, which keeps twice ``kept`` words; ``path`` None: the contract's, found on the worker."""
    if (path, kept) not in _encoders:
        _encoders[path, kept] = Encoder(path, kept)
    return _encoders[path, kept]


def text_slices(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int, pa.Array]]:
    """(start, end, texts) of a batch's column of texts, each slice of about ``most`` bytes."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < len(column):
        before = int(sizes[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield start, end, column.slice(start, end - start)
        pa.default_memory_pool().release_unused()  # workers are used again: what a slice needed stays theirs otherwise
        start = end


def wide(ids: bytes, n: int) -> bytes:
    """``n`` ids as little-endian unsigned 32-bit integers, whatever their width in ``ids``."""
    return ids if len(ids) == 4 * n else np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()

"""BPE against the tokenizers library, and trees against merging step by step."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, queries
from tessera.llm.common import table

from ..conftest import SF

PARTS = [chr(i) for i in (*range(0x180), *range(0x2000, 0x2070), 0x558, 0x10940, 0x1F600, 0x4E00, 0x3000, 0xFEFF, 0x3100, 0x30FF, 0xAC00, 0x88F, 0x2FFFF)]
PARTS += ["'s", "'LL", "'ll", "  ", "\r\n", "<|endoftext|>", "<|end", "the", "ing", "Straße", "naïve", "    "] * 12


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def ids(coded):
    return np.frombuffer(coded, "<u4").tolist()


def test_texts_like_the_library(library):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(14))) for _ in range(6000)] + ["a" * n for n in range(1, 140)] + ["é" * 333, "あ" * 70, "", None, "<|endoftext|>"]
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    codec = bpe.Codec()
    assert [ids(x) for x in codec.encode(texts)] == want
    assert [codec.decode(x) for x in codec.encode(texts)] == [t or "" for t in texts]


def test_any_ids_decode_like_the_library(library):
    rng, codec = random.Random(6), bpe.codec()
    for _ in range(500):
        some = [rng.randrange(50257) for _ in range(rng.randrange(9))]
        assert codec.decode(np.array(some, "<u4").tobytes()) == library.decode(some, skip_special_tokens=False)
    with pytest.raises(ValueError, match="not of the vocabulary"):
        codec.decode(np.array([50257], "<u4").tobytes())


def test_kinds_are_the_library_s(library):
    codec = bpe.codec()
    for code in (*range(0x3300), *range(0x10000, 0x11000, 7), 0x1FBF0, 0x2EBF0):
        if not 0xD800 <= code < 0xE000:
            text = f"a{chr(code)}{chr(code)}1 {chr(code)}!{chr(code)}"
            assert len(codec.cut(text)) == len(library.pre_tokenizer.pre_tokenize_str(text)), hex(code)


def test_trees_take_the_leftmost_of_the_lowest_rank():
    rng = random.Random(7)
    for _ in range(300):
        alphabet = range(rng.randrange(2, 5))
        pairs = rng.sample([(a, b) for a in range(9) for b in range(9)], 20)
        ranks, made = {a << 32 | b: i << 32 for i, (a, b) in enumerate(pairs)}, [rng.randrange(9) for _ in pairs]
        given = [rng.choice(alphabet) for _ in range(rng.randrange(1, 17))]
        want = list(given)
        while True:
            found = min(((ranks[a << 32 | b] >> 32, i) for i, (a, b) in enumerate(zip(want, want[1:], strict=False)) if a << 32 | b in ranks), default=None)
            if found is None:
                break
            want[found[1] : found[1] + 2] = [made[found[0]]]
        assert bpe.merged(list(given), ranks, made) == want
        matrix = np.full((1, 17), -1, np.int64)
        matrix[0, : len(given)] = given
        keys = np.array(sorted(ranks), np.int64)
        bpe.merged_together(matrix, np.array([len(given)]), keys, np.array([ranks[k] for k in keys.tolist()]), np.array(made))
        assert matrix[matrix >= 0].tolist() == want


def test_generations_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 20)
    rng, codec = random.Random(8), bpe.Codec()
    for _ in range(40):
        texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "x" * 70, *map(str, range(60))], k=9)) for _ in range(3)]
        assert [ids(x) for x in codec.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert not any(len(piece) > bpe.KEPT_CHARS for piece in codec.known)


def test_op12(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    got = {r["doc_id"]: r for r in queries.op12_bpe(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for (doc_id, text), e in zip(texts.items(), library.encode_batch(list(texts.values()), add_special_tokens=False), strict=True):
        r = got[doc_id]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_edges(spark):
    rows = [(1, "one two"), (1, "one two"), (None, "x"), (2, None), (3, ""), (4, "word " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("own") for n in ("ids", "n_tokens")}).repartition(3)
    encoded = bpe.encode(df)
    assert encoded.columns == ["doc_id", "n_tokens", "ids"]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in bpe.decode(encoded).collect())
    assert got == sorted((i or 0, t or "") for i, t in rows)
    assert bpe.decode(bpe.encode(df.limit(0))).count() == 0

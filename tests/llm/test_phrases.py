"""Phrases against plain counting; the sketch's size, shards and automata change nothing; exact arithmetic; edge cases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import phrases

WORDS = ["the", "of", "new", "york", "city", "de", "la", "x", "é", "\x00a", "ab", "b"]


def counted(rows, longest=3):
    counts = defaultdict(Counter)
    for lang, text in rows:
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", folded):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][tuple(words[i : i + k])] += 1
    return counts


def expected(rows, least, percent, longest=3):
    out = set()
    for lang, f in counted(rows, longest).items():
        n = sum(c for w, c in f.items() if len(w) == 1)
        candidates = {w: a for w, a in f.items() if len(w) > 1 and a >= least}
        for w, a in candidates.items():
            if any(len(v) > len(w) and 100 * b >= percent * a and any(v[i : i + len(w)] == w for i in range(len(v))) for v, b in candidates.items()):
                continue
            score, k = min((10**6 * a * a // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
            out.add((lang, " ".join(w), a, f[w[:k]], f[w[k:]], n, score))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    texts = ["".join(str(rng.choice(WORDS)) + str(rng.choice([" ", " ", " ", "\t ", ".", "\n", " , "])) for _ in range(rng.integers(0, 90))) for _ in range(90)]
    given = [(str(rng.choice(["en", "de"])), t.title() if i % 3 else t) for i, t in enumerate(texts)]
    return [*given, (None, "new york city " * 30), ("und", "new york. " * 12), ("en", None), ("en", ""), (None, "... \n"), *[given[0]] * 12]


@pytest.mark.parametrize(("cells", "shard", "patterns", "longest"), [(1 << 20, 8 << 20, 1000, 3), (8, 50, 7, 3), (1 << 12, 300, 50, 4)])
def test_against_plain_counting(spark, rows, cells, shard, patterns, longest):
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({n: F.lit("own") for n in ("phrase", "f", "k", "score", "n")}).repartition(4)
    found = phrases.collocations(df, longest, 10, 50, cells, shard, patterns)
    assert {tuple(r) for r in found.collect()} == expected(rows, 10, 50, longest)


def test_overlapping_matches_count():
    import pyarrow as pa

    words = pa.array("a a a a . a a ab a".split(), pa.large_string())
    for most in (2, 99):
        assert phrases.matches(["a a", "a a a", "a", "ab", "b", "a b"], words, most).tolist() == [4, 2, 7, 1, 0, 0]
    assert not len(phrases.matches([], words))


def test_distinct_phrases_of_many_words():
    import pyarrow as pa

    windows = phrases.Windows("en", pa.array("c a b c a b c".split(), pa.large_string()), 3)
    few = windows.distinct(3, np.arange(5))
    assert sorted(few) == ["a b c", "b c a", "c a b"]
    windows.words += ["x"] * (1 << 21)  # codes that don't fit in one number
    assert sorted(windows.distinct(3, np.arange(5))) == sorted(few)


def test_long_texts_are_cut_between_pieces():
    import pyarrow as pa

    text = "one two three. four five, six " * 1000 + "a" * 5000 + " end"
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de", "en"], "text": [text, None, "x y"]})
    parts = list(phrases.shards(iter([batch]), 100))
    assert len(parts) > 100
    words = [w for lang, ws in parts if lang == "en" for w in ws.to_pylist()]
    assert [w for w in words if w != "."] == [*re.split(r"[ .,]+", text), "x", "y"]


def test_scores_beyond_64_bits(spark, monkeypatch):
    a, l, r = 3 * 10**11, 4 * 10**11 + 7, 5 * 10**11 + 3
    counts = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, l), ("en", "y", 1, r), ("en", "", 0, 10**13)], "lang string, phrase string, k int, f long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *_: counts)
    assert phrases.collocations(counts).first()["score"] == 10**6 * a * a // (l * r)


def test_ranks(spark):
    rows = [("en", p, a, 20, 20, 99, s) for p, a, s in (("b c", 10, 5), ("a c", 10, 5), ("z z", 11, 5), ("q q", 10, 6), ("é", 10, 5), ("z", 10, 5))] + [("de", "k k", 10, 20, 20, 9, 1)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long")
    got = [(r["lang"], r["rank"], r["phrase"]) for r in phrases.best_collocations(df, 5).orderBy("lang", "rank").collect()]
    assert got == [("de", 1, "k k"), ("en", 1, "q q"), ("en", 2, "z z"), ("en", 3, "a c"), ("en", 4, "b c"), ("en", 5, "z")]


def test_empty(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(none, cells=8).count() == phrases.best_collocations(phrases.collocations(none, cells=8)).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        phrases.phrase_counts(none, cells=12)

"""Operator 9, quality rules: a short-circuit cascade, in DataFrame functions only.

``fit_cascade`` times each rule on a bounded sample and counts how many rows the rule rejects there, then orders the
rules by rejections per second of cost. A cost is the time of a pass over the sample, repeated some times within the
tasks, after a warm-up and less that of a pass without a rule. ``cascade`` is one CASE in that order: a row that one
rule has rejected never reaches the next rule's features. The order changes only the cost; what is kept is the same
under any order, because a row is kept when no rule rejects it.

``quality_filter`` computes every feature within the cascade. ``score_quality`` returns counts of every row, so these
are computed for all (``quality_features``); its cascade computes what they don't hold (capitals; lines, of texts with
repeated ones) only for rows that get so far.

Edge cases: a null text has no words and is rejected by ``min_words``; an empty text likewise; other columns are
carried along untouched, whatever their names or nulls; repeated rows get one verdict each; an empty table gives
an empty result and the registry's order of rules.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, free_name, let, words_of

#: Fixed values of the base rules: fewest words; most percent of words that lie in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Fixed values of the further rules, as percentages or tenths so that all arithmetic is on integers.
MAX_SYMBOLS_PERCENT_OF_WORDS = 30
MAX_DUP_LINES_PERCENT = 50
MIN_WORD_TENTHS, MAX_WORD_TENTHS = 25, 150
MAX_UPPER_PERCENT = 60
#: Rows that the cascade is fitted on, about; seed of their choice; times that a pass goes over them; timed passes a rule.
SAMPLE_ROWS, SAMPLE_SEED, SAMPLE_REPEATS, PASSES = 500, 3, 4, 2

SYMBOLS, CAPITALS = "[#*$%&|<>]", "[A-Z]"


@dataclass(frozen=True)
class Rule:
    """``feature``: what the rule needs of a text and its words, a struct; ``rejects``: verdict from that struct."""

    name: str
    feature: Callable[[Column, Column], Column]
    rejects: Callable[[Column], Column]


def window_hashes(words: Column) -> Column:
    """One 64-bit hash for each window of three words, in order."""
    return F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])),
    ).otherwise(F.array().cast("array<bigint>"))


def covered_words(hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more; ``hashes`` as of ``window_hashes``.

    Sorts (hash, position) within the row: n log n on any text, however long.
    """
    repeated = lambda s: F.sort_array(
        F.transform(
            F.filter(
                s,
                lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < F.size(s) - 1) & (F.get(s, j + 1)["h"] == x["h"])),
            ),
            lambda x: x["i"],
        )
    )
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
    count = lambda positions: F.aggregate(
        positions,
        start,
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(let(pairs, lambda s: count(repeated(s))))


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{ASCII_SPACE}]"))


def dup_lines(text: Column) -> Column:
    return let(lines_of(text), lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"), F.size(x).cast("bigint").alias("n_lines")))


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def quality_features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) added.

    Columns of ``df`` with those names are replaced.
    """
    w, h, t = (free_name(df, x) for x in ("words", "hashes", "whole"))
    out = df.withColumn(t, F.coalesce(F.col(text), F.lit(""))).withColumn(w, words_of(F.col(t)))
    out = out.withColumns(
        {
            "n_words": F.size(w).cast("bigint"),
            "word_chars": F.length(F.array_join(w, "")).cast("bigint"),
            "n_symbols": matches(F.col(t), SYMBOLS),
            "n_dup_lines": dup_lines(F.col(t))["n_dup_lines"],
            h: window_hashes(F.col(w)),
        }
    )
    return out.withColumn("n_repeat_words", covered_words(F.col(h))).drop(w, h, t)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rules() -> list[Rule]:
    """The registry."""
    n = lambda w: F.size(w).cast("bigint")
    chars = lambda w: F.length(F.array_join(w, "")).cast("bigint")
    return [
        Rule("min_words", lambda t, w: F.struct(n(w).alias("n")), lambda f: f["n"] < MIN_WORDS),
        Rule("repeats", lambda t, w: F.struct(n(w).alias("n"), let(window_hashes(w), covered_words).alias("r")), lambda f: 100 * f["r"] > MAX_REPEAT_PERCENT * f["n"]),
        Rule("symbols", lambda t, w: F.struct(n(w).alias("n"), matches(t, SYMBOLS).alias("s")), lambda f: symbols_fail(f["s"], f["n"])),
        Rule("dup_lines", lambda t, w: dup_lines(t), lambda f: dup_lines_fail(f["n_dup_lines"], f["n_lines"])),
        Rule("word_length", lambda t, w: F.struct(n(w).alias("n"), chars(w).alias("c")), lambda f: word_length_fails(f["c"], f["n"])),
        Rule("upper_case", lambda t, w: F.struct(chars(w).alias("c"), matches(t, CAPITALS).alias("u")), lambda f: upper_fails(f["u"], f["c"])),
    ]


def scored_rules() -> list[Rule]:
    """The same rules for rows with the columns of ``quality_features``: only what these don't hold is computed."""
    c = F.col
    known = lambda *names: lambda t, w: F.struct(*names)
    lines = lambda t: F.when(c("n_dup_lines") > 0, F.size(lines_of(t)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return [
        Rule("min_words", known("n_words"), lambda f: f["n_words"] < MIN_WORDS),
        Rule("repeats", known("n_words", "n_repeat_words"), lambda f: 100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"]),
        Rule("symbols", known("n_symbols", "n_words"), lambda f: symbols_fail(f["n_symbols"], f["n_words"])),
        Rule("dup_lines", lambda t, w: F.struct("n_dup_lines", lines(t).alias("n_lines")), lambda f: dup_lines_fail(f["n_dup_lines"], f["n_lines"])),
        Rule("word_length", known("word_chars", "n_words"), lambda f: word_length_fails(f["word_chars"], f["n_words"])),
        Rule("upper_case", lambda t, w: F.struct("word_chars", matches(t, CAPITALS).alias("n_upper")), lambda f: upper_fails(f["n_upper"], f["word_chars"])),
    ]


def symbols_fail(symbols: Column, words: Column) -> Column:
    return 100 * symbols > MAX_SYMBOLS_PERCENT_OF_WORDS * words


def dup_lines_fail(dup: Column, lines: Column) -> Column:
    return 100 * dup > MAX_DUP_LINES_PERCENT * lines


def word_length_fails(chars: Column, words: Column) -> Column:
    return (10 * chars < MIN_WORD_TENTHS * words) | (10 * chars > MAX_WORD_TENTHS * words)


def upper_fails(upper: Column, chars: Column) -> Column:
    return 100 * upper > MAX_UPPER_PERCENT * chars


def fit_cascade(df: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS, given: list[Rule] | None = None, prepared: Callable[[DataFrame], DataFrame] | None = None) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, seconds) in the order to apply them: most rejections per second first.

    ``given``: the rules, the registry's if None; ``prepared`` adds the columns that they use to the sample. Looks at about ``sample_rows``
    random rows; only the order depends on them. Taking them by share, not by limit, keeps every task's contribution
    small: a limit would first gather as many rows from each partition.
    """
    share = min(1.0, sample_rows / max(df.count(), 1))
    t, w, again = (free_name(df, x) for x in ("whole", "words", "again"))
    sample = df.select(text).sample(share, seed=SAMPLE_SEED)
    sample = (prepared(sample) if prepared else sample).withColumn(t, F.coalesce(F.col(text), F.lit(""))).withColumn(w, words_of(F.col(t))).persist()
    repeated = sample.withColumn(again, F.explode(F.sequence(F.lit(1), F.lit(SAMPLE_REPEATS))))
    try:
        rows = sample.count()

        def timed(verdict: Column) -> tuple[float, float]:
            query, times = repeated.agg(F.sum(verdict.cast("int")).alias("n")), []
            for _ in range(1 + PASSES):  # the first is the warm-up
                began = time.perf_counter()
                n = query.first()["n"] or 0
                times.append(time.perf_counter() - began)
            return n / max(rows * SAMPLE_REPEATS, 1), min(times[1:])

        _, empty = timed(F.col(again) < 0)
        found = []
        for rule in rules() if given is None else given:
            rejected, seconds = timed(let(rule.feature(F.col(t), F.col(w)), rule.rejects))
            found.append((rule, rejected, max(seconds - empty, 0.0)))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: -x[1] / max(x[2], 1e-3)) if rows else found


def cascade(order: list[Rule], t: Column, w: Column) -> Column:
    """Whether no rule rejects: one CASE, in which a later rule's feature is computed only where all earlier rules passed."""
    kept = F.lit(True)
    for rule in reversed(order):
        kept = F.when(let(rule.feature(t, w), rule.rejects), F.lit(False)).otherwise(kept)
    return kept


def apply_cascade(df: DataFrame, order: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``df`` that no rule rejects, with the columns of ``df``."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.filter(let(words_of(t), lambda w: cascade(order, t, w)))


def quality_filter(df: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows that pass every rule, the rules ordered on a sample of ``df``."""
    return apply_cascade(df, [rule for rule, _, _ in fit_cascade(df, text, sample_rows)], text)


def score_cascade(df: DataFrame, order: list[Rule], text: str = "text") -> DataFrame:
    """``df``, with the columns of ``quality_features``, with ``base_failed`` and ``kept`` added."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn("base_failed", base_failed()).withColumn("kept", cascade(order, t, F.lit(None).cast("array<string>")))


def score_quality(df: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every row of ``df`` with its features, ``base_failed`` and ``kept``; no row is dropped."""
    prepared = lambda rows: quality_features(rows, text)
    order = [rule for rule, _, _ in fit_cascade(df, text, sample_rows, scored_rules(), prepared)]
    return score_cascade(prepared(df), order, text)

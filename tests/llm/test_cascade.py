"""The cascade computes a later rule's feature only for rows that earlier rules kept."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality

PROSE = " ".join(f"word{i % 97}x{i}" for i in range(80))
ROWS = [(1, "too short"), (2, None), (3, "again and again " * 40)]


def bomb(rule):
    return quality.Rule(rule.name, lambda t, w: F.struct(F.raise_error(F.lit("computed")).cast("bigint").alias("n")), lambda f: f["n"] > 0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


@pytest.mark.parametrize("scored", [False, True])
def test_rejected_rows_skip_later_rules(docs, scored):
    rules = quality.scored_rules() if scored else quality.rules()
    order = [*rules[:2], *map(bomb, rules[2:])]
    run = lambda df: quality.score_cascade(quality.quality_features(df), order) if scored else quality.apply_cascade(df, order)
    rows = run(docs).collect()
    assert [r["kept"] for r in rows] == [False] * 3 if scored else not rows
    with pytest.raises(Exception, match="computed"):
        run(docs.union(docs.select(F.lit(4).cast("bigint"), F.lit(PROSE)))).collect()


def test_both_registries_agree(docs):
    lines = "\n".join([PROSE[:300]] * 9)
    texts = [PROSE, PROSE.upper(), lines, PROSE + " #$%" * 30, "a b c d e f g h i j " * 3, " ".join("abcdefghij"[i % 10] + "x" * (i % 7) for i in range(90)), "w" * 900 + " " + PROSE]
    df = docs.sparkSession.createDataFrame(list(enumerate(texts, 10)), "doc_id long, text string").union(docs)
    scored = {r["doc_id"]: r["kept"] for r in quality.score_quality(df).collect()}
    kept = {r["doc_id"] for r in quality.quality_filter(df).collect()}
    assert kept == {k for k, v in scored.items() if v} and 10 in kept and not kept & {12, 13, 14, 16}


def test_order_goes_by_rejections_per_cost(docs):
    fitted = quality.fit_cascade(docs, sample_rows=10)
    rates = [share / max(seconds, 1e-3) for _, share, seconds in fitted]
    assert rates == sorted(rates, reverse=True)
    assert {rule.name: share for rule, share, _ in fitted}["min_words"] == pytest.approx(2 / 3)

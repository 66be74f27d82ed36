"""Weights that aren't integers keep their ratios."""

import pytest

from tessera.llm import mixing


def test_fractions_keep_their_ratios(spark):
    assert mixing.whole_weights({"a": 0.5, "b": 0.1, "c": 2}) == ({"a": 5, "b": 1, "c": 20}, 10)
    leaves = spark.createDataFrame([("a", "x", "s", 1000), ("b", "x", "s", 1000), ("c", "x", "s", 1000)], "domain string, lang string, source string, tokens long")
    got = {r["domain"]: r["budget"] for r in mixing.leaf_budgets(leaves, 700, {"domain": {"a": 0.5, "b": 0.25}}, max_epochs=1).collect()}
    assert got == {"a": 200, "b": 100, "c": 400}


@pytest.mark.parametrize("weights", [{"a": -1}, {"a": 1e-12}, {"a": 1e12}])
def test_weights_out_of_range_are_refused(weights):
    with pytest.raises(ValueError):
        mixing.whole_weights(weights)

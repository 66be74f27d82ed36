"""Queries that SQL can express, against DuckDB; and that all thirteen operators are registered."""

import pytest

from tessera.llm.queries import ORACLES, QUERIES

from ..conftest import SF
from ..oracle import assert_same


def test_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}
    assert set(ORACLES) < set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name], SF)

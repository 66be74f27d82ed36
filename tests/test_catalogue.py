"""Every query of the catalogue against its SQL."""

import pytest

from tessera.plans import ORACLES, QUERIES

from .conftest import SF
from .oracle import assert_same


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name], SF)

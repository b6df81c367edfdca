"""Every registered query against its SQL on the same tables."""

import pytest
from oracle import compare, connect

from lattix import queries as engine

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_oracle(spark, duck, name):
    compare(engine.QUERIES[name](spark, SF), duck, engine.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLES)))
def test_rows(spark, name):
    assert engine.QUERIES[name](spark, SF).count() >= 1


def test_every_oracle_has_a_query():
    assert set(engine.ORACLES) <= set(engine.QUERIES)

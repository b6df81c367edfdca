"""Corpus queries against their SQL."""

import pytest
from oracle import compare, connect

from lattix.llm import queries as corpus

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(corpus.ORACLES))
def test_oracle(spark, name):
    compare(corpus.QUERIES[name](spark, SF), connect(SF), corpus.ORACLES[name])

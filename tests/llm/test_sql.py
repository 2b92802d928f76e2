"""Queries of the subpackage that have SQL, against it on the smallest tables."""

import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import connect, differences


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    sf = "/root/testdata/sf0.001"
    assert (d := differences(QUERIES[name](spark, sf), connect(sf), ORACLE_SQL[name])) is None, d

"""Every query of the subpackage against its SQL."""

import pytest

import oracle
from platewise.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    oracle.compare(spark, queries.QUERIES, queries.SQL, name)

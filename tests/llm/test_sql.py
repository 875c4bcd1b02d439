from __future__ import annotations

import pytest
from compare import assert_same
from panelspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name], queries.ORACLE_SQL[name], spark, sf_dir)

from __future__ import annotations

import __spark_entry__ as entry
import pytest
from compare import assert_same

from panelspark import plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_against_sql(spark, sf_dir, name):
    assert_same(plans.QUERIES[name], plans.SQL[name], spark, sf_dir)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    df = plans.QUERIES[name](spark, sf_dir)
    assert df.count() >= 0 and df.columns


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["signal_date", "bucket", "n_returns", "mean_return", "lower_bound", "upper_bound"]
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())

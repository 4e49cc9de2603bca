"""Each registered query of the reference's operators against DuckDB over the test tables."""

import __spark_entry__
import pytest
from planwatch.plans import queries as plans

from conftest import SF_DIR


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, same, name):
    same(plans.QUERIES[name](spark, SF_DIR), plans.SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs_without_sql(spark, name):
    df = plans.QUERIES[name](spark, SF_DIR)
    assert df.columns
    df.limit(5).collect()


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["page_id", "reject_reason"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

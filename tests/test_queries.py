import pytest

from loomstone.catalog import QUERIES, SQL
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert assert_same(QUERIES[name](spark, SF), SQL[name], SF) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["q_prf_by_grid"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" in plan and "text" not in plan

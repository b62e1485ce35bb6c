import pytest

from voxelith.plans.queries import ORACLE_SQL, QUERIES

from .oracle import check


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    check(spark, sf, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 50
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every query that has SQL gives the SQL's rows; the others run and give a stable schema."""

import compare
import pytest

from veridex.plans import assessment, catalogue

QUERIES, SQL = catalogue.queries() | assessment.queries(), catalogue.oracle_sql() | assessment.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_of_the_sql(spark, small, name):
    assert compare.difference(spark, QUERIES[name], SQL[name], small) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns and df.count() >= 0


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

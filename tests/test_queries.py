import pytest

from barloom import queries as q

from .comparing import assert_same, database


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(q.queries()[name](spark, sf_dir).toPandas(), database(sf_dir).sql(q.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_query_runs(spark, sf_dir, name):
    """Queries without SQL have rows and the columns that are their keys are never null."""
    rows = q.queries()[name](spark, sf_dir).toPandas()
    keys = [c for c in ("run_id", "symbol", "bar_id", "trial_id", "session_id") if c in rows]
    assert len(rows) and keys and rows[keys].notna().all().all() and len(rows.columns) > len(keys)


def test_entry_has_rows(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

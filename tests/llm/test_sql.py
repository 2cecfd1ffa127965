import pytest

from barloom.llm import queries as q

from ..comparing import assert_same, database


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(q.queries()[name](spark, sf_dir).toPandas(), database(sf_dir).sql(q.oracle_sql()[name]).df())

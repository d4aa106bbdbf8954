"""Every registered query outside the optional operators: against SQL where there is any, else that it gives rows."""

import pytest

from larder.plans import catalog
from tests.conftest import SF
from tests.oracle import connection, same


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("query", catalog.ALL, ids=lambda q: q.name)
def test_query(spark, con, query):
    df = query.run(spark, SF)
    if query.sql:
        same(df, con, query.sql)
    else:
        assert df.count() > 0


def test_names_are_unique():
    assert len({q.name for q in catalog.ALL}) == len(catalog.ALL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans_push_down(spark):
    plan = catalog.queries()["allowed_intersection"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src0)" in plan

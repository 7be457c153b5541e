"""Every catalogue query against its DuckDB oracle on the smallest given tables, and
the driver contract of __spark_entry__."""

import pytest

from literal_rows import SMALL
from webcorpus.plans import catalog, verify

catalog.load_all()
NAMES = sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def con():
    return verify.duck_connection(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = catalog.QUERIES[name](spark, SMALL)
    if name not in catalog.ORACLES:
        assert df.count() >= 0
        return
    ok, msg = verify.compare(df, con, catalog.ORACLES[name])
    assert ok, msg


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    assert "title" in df.columns and "domain" in df.columns


def test_sql_views(spark):
    from webcorpus.plans.sql import register_views
    names = register_views(spark, SMALL, ["page_overview", "url_domain"])
    assert names == ["page_overview", "url_domain"]
    n = spark.sql("SELECT count(*) AS n FROM page_overview o JOIN url_domain d USING (page_id) "
                  "WHERE o.domain = d.domain").first()["n"]
    assert n == spark.table("page_overview").count()

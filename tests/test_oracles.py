"""Every registered query of the core against its SQL, over whole tables of the smallest size."""

import os

import pytest

from recallgrid.plans.catalog import QUERIES, SQL
from tests.oracle import duck, rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in SQL:
        assert rows(got) == rows(con.execute(SQL[name]).df())


def test_every_query_without_sql_is_known():
    assert sorted(set(QUERIES) - set(SQL)) == ["chunk_files", "chunk_html", "page_articles", "page_links", "page_metadata", "web_chunks"]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

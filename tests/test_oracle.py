"""Named queries against their SQL on the smallest tables. All of them take some minutes: SHELFLINE_ALL=1 runs them."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from shelfline.workload.oracle import ORACLE_SQL
from shelfline.workload.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "dim_date", "fact_basket_summary", "product_affinity", "top_products_by_category", "measure_totals", "recommend",
    "bronze_products", "catalog_flat", "pair_cumulative_series", "stream_sales", "stream_rejects",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL) and set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("SHELFLINE_ALL") else QUICK)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from check_oracle import TABLES, normal

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    ours = queries()[name](spark, FOLDER).toPandas()
    theirs = con.execute(oracle_sql()[name]).fetch_df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours.astype(object)) == normal(theirs.astype(object))


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1

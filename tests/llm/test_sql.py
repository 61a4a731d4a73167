"""Text queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from shelfline.llm.oracle import ORACLE_SQL
from shelfline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from check_oracle import TABLES, normal

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    ours = QUERIES[name](spark, FOLDER).toPandas()
    theirs = con.execute(ORACLE_SQL[name]).fetch_df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours.astype(object)) == normal(theirs.astype(object))


@pytest.mark.parametrize("name", ["op5_quality", "op10_language_id"])
def test_held_out_accuracy(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    table = "labels" if name == "op5_quality" else "documents"
    truth = spark.read.parquet(f"{FOLDER}/{table}.parquet").toPandas()
    both = got[got.held_out].merge(truth, on="doc_id")
    pair = ("predicted", "quality") if name == "op5_quality" else ("lang_pred", "lang")
    assert len(both) and (both[pair[0]] == both[pair[1]]).mean() >= 0.9

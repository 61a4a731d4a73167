"""Layers that come into force as a whole."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfline.jobs import full_load as job
from shelfline.sources.tables import GOLD_TABLES, Layer, read_table, write_table
from tests.shop import Shop


def numbers(spark, ns, name):
    return sorted(r[0] for r in read_table(spark, ns, name).collect())


def build(spark, layer, tables):
    with layer.rebuild() as ns:
        for name, values in tables.items():
            if values is None:
                raise OSError("lost")
            write_table(spark.createDataFrame([(v,) for v in values], "n int"), ns, name)


def test_views_move_when_the_layer_is_whole(spark):
    layer = Layer(spark, "lay_a")
    build(spark, layer, {"one": [1], "two": [2], "gone": [9]})
    assert layer.current() == 1 and numbers(spark, "lay_a", "one") == [1]
    with pytest.raises(OSError):
        build(spark, layer, {"one": [10], "two": None})
    assert layer.current() == 1 and numbers(spark, "lay_a", "one") == [1] and numbers(spark, "lay_a", "two") == [2]
    held = read_table(spark, "lay_a", "one")  # a reader that started before the switch
    build(spark, layer, {"one": [10], "two": [20], "three": []})
    assert numbers(spark, "lay_a", "one") == [10] and numbers(spark, "lay_a", "three") == []
    assert not spark.catalog.tableExists("lay_a.gone")
    assert [r[0] for r in held.collect()] == [1]
    assert layer.builds() == [1, 3]  # the failed build is gone, the one before is kept
    build(spark, layer, {"one": [11]})
    assert layer.builds() == [3, 4] and not spark.catalog.tableExists("lay_a.two")


def test_tables_from_before_become_views(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS lay_b")
    for name in ("one", "old"):
        write_table(spark.createDataFrame([(1,)], "n int"), "lay_b", name)
    build(spark, Layer(spark, "lay_b"), {"one": [2]})
    assert numbers(spark, "lay_b", "one") == [2] and not spark.catalog.tableExists("lay_b.old")


def test_a_gold_build_that_fails_leaves_every_view_on_the_old_rows(spark, monkeypatch):
    shop = Shop(spark)
    options = job.Options(min_pair_cnt=1, refreshed_at=F.lit("2024-01-01").cast("timestamp"))
    views = job.full_load(spark, "lay_bronze", "lay_silver", "lay_gold", shop.bronze, options, "lay_model")
    before = {name: read_table(spark, "lay_gold", name).count() for name in GOLD_TABLES}
    written = []

    def fail(df, ns, name, *rest, **more):
        if len(written) == 4:
            raise OSError("lost")
        written.append(name)
        write_table(df, ns, name, *rest, **more)

    with monkeypatch.context() as patch, pytest.raises(OSError):
        patch.setattr(job, "write_table", fail)
        job.build_gold(spark, "lay_silver", "lay_gold", job.Options(min_pair_cnt=1, store_ids=["Nowhere"]))
    assert {name: read_table(spark, "lay_gold", name).count() for name in GOLD_TABLES} == before
    assert before["fact_product_affinity"] == 4 and all(read_table(spark, "lay_model", name).count() >= 0 for name in views)

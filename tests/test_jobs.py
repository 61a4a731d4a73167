from __future__ import annotations

from pyspark.sql import functions as F

from shelfline.jobs.full_load import Options, build_gold, full_load
from shelfline.plans import semantic
from shelfline.sources.tables import GOLD_TABLES, SILVER_TABLES, read_table
from tests.shop import Shop


def snapshot(spark, ns, names, rows):
    return {name: rows(read_table(spark, ns, name)) for name in names}


def test_full_load_twice_gives_the_same_tables(spark, rows):
    shop = Shop(spark)
    options = Options(min_pair_cnt=1, refreshed_at=F.lit("2024-01-01").cast("timestamp"))
    runs = []
    for _ in range(2):
        views = full_load(spark, "j_bronze", "j_silver", "j_gold", shop.bronze, options)
        runs.append((snapshot(spark, "j_silver", SILVER_TABLES, rows), snapshot(spark, "j_gold", GOLD_TABLES, rows)))
    assert runs[0] == runs[1] and len(views) == 14
    silver, gold = runs[0]
    assert silver["kx_total_baskets"] == [(5,)] and len(silver["fact_basket_summary"]) == 7
    assert silver["dim_store"] == rows(shop.stores) and silver["dim_date"] == rows(shop.model.dim_date)
    assert len(gold["fact_product_affinity"]) == 4 and len(gold["product_affinity_topk_named"]) == 4
    assert spark.table("sales_promo_share_orders").count() == 1

    model = semantic.Model.from_tables(spark, "j_silver")
    assert semantic.evaluate(model, [], [semantic.orders()]).first()["orders"] == 7

    full_load(spark, "j_bronze", "j_silver", "j_gold", None, options, "j_model")
    spark.catalog.dropTempView("dim_store")
    assert spark.table("j_model.dim_store").count() == len(silver["dim_store"])
    assert not [v for v in spark.catalog.listTables("j_model") if v.name == "dim_store" and v.isTemporary]

    bucketed = Options(min_pair_cnt=1, refreshed_at=options.refreshed_at, order_buckets=4)
    full_load(spark, "j_bronze", "j_silver", "j_gold", None, bucketed)
    assert snapshot(spark, "j_gold", GOLD_TABLES, rows) == gold
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    star = semantic.star_view(semantic.Model.from_tables(spark, "j_silver"), ["promo_flag"])
    plan = star._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan

    build_gold(spark, "j_silver", "j_gold", Options(min_pair_cnt=1, store_ids=["Nowhere"]))
    assert read_table(spark, "j_gold", "fact_product_affinity").count() == 0
    assert read_table(spark, "j_gold", "product_affinity_topk_named").count() == 0

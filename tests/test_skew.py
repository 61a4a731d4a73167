"""Keys that hold a third of the rows are split, not handled by one task."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfline.plans import semantic, silver
from shelfline.session import stored

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture()
def small_partitions(spark):
    """Settings under which a small table behaves like a large one."""
    before = {key: spark.conf.get(key, None) for key in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0], rows


@pytest.fixture()
def lines(spark, tmp_path):
    """150,000 lines over many files; product p0 and order o0 hold a third each."""
    path = str(tmp_path / "lines")
    n = F.col("id")
    spark.range(0, 150_000, 1, 12).select(
        F.when(n % 3 == 0, "o0").otherwise(F.concat(F.lit("o"), F.pmod(F.xxhash64(n), F.lit(20_000)))).alias("order_id"),
        F.when(n % 3 == 1, "p0").otherwise(F.concat(F.lit("p"), F.pmod(F.xxhash64(n, F.lit(1)), F.lit(5_000)))).alias("product_id"),
        F.lit(1).alias("amount"),
        F.sha2(n.cast("string"), 256).alias("color"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_hot_product(spark, small_partitions, lines):
    products = spark.range(5_000).select(F.concat(F.lit("p"), "id").alias("product_id"), F.lit(2.0).alias("base_price"), F.lit("b").alias("brand"))
    cats = products.select("product_id", F.lit("c").alias("category"))
    plan, rows = final_plan(silver.fact_sales_item(lines, products, cats))
    assert "skew=true" in plan
    assert len(rows) == 150_000 and sum(r.line_value for r in rows) == 300_000.0


def test_hot_order(spark, small_partitions, lines):
    sales = lines.select("order_id", F.concat("product_id", "color").alias("product_id"), F.lit(1.0).alias("qty"), F.lit(2.0).alias("unit_price"), F.lit(2.0).alias("line_value"))
    heads = lines.select("order_id").distinct().select(
        "order_id", F.lit("2024-01-01").cast("date").alias("order_date"), F.lit("Online").alias("store_id"),
        F.lit("u").alias("user_id"), F.lit(True).alias("promo_flag"), F.lit("x").alias("promo_code"))
    heads = stored(heads, "heads")
    none = spark.createDataFrame([], "product_id string, product_name string, category string, brand string")
    model = semantic.Model(none, none, none, sales, heads)
    plan, rows = final_plan(semantic.star_view(model, ["store_id"]).select("order_id", "product_id", "store_id"))
    assert "skew=true" in plan and len(rows) == 150_000
    rolled, rows = final_plan(semantic.star_view(model, ["store_id"], rolled_up=True))
    assert "skew=true" not in rolled and sum(r.line_value for r in rows) == 300_000.0

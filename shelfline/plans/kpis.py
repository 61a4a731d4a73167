"""Key figures of the gold layer: order values, top products, regional split and promotion shares.

`summary` holds each order once (see `silver.fact_basket_summary`), so counting its order ids is the distinct count
and needs no shuffle of them. Orders are summed per store before the small store table is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.money import decimal_sum, exact_sum, ratio
from shelfline.operators.ranking import top_per_group

# fixed value: products listed per category
TOP_PRODUCTS = 10


def orders_enriched(summary: DataFrame, stores: DataFrame) -> DataFrame:
    """Orders with region and channel; an order without a known store keeps NULLs."""
    return summary.join(stores, "store_id", "left")


def _with_promo() -> Column:
    return F.count_if(F.coalesce("promo_flag", F.lit(False)))


def aov_overall(summary: DataFrame) -> DataFrame:
    """Mean basket value; orders without lines have no value and do not count."""
    return summary.agg(ratio(exact_sum("basket_value"), F.count("basket_value")).alias("aov"))


def aov_by_region_channel(summary: DataFrame, stores: DataFrame) -> DataFrame:
    """Orders, revenue and mean basket value by region and channel."""
    per_store = summary.groupBy("store_id").agg(
        F.count("order_id").alias("orders"),
        decimal_sum("basket_value").alias("revenue"),
        F.count("basket_value").alias("valued"),
    )
    by_place = orders_enriched(per_store, stores).groupBy("region", "channel")
    return by_place.agg(
        F.sum("orders").alias("orders"),
        exact_sum("revenue").alias("revenue"),
        ratio(exact_sum("revenue"), F.sum("valued")).alias("aov"),
    )


def brands_of_orders(sales: DataFrame) -> DataFrame:
    """Quantity and revenue per order and brand."""
    return sales.groupBy("order_id", "brand").agg(F.sum("qty").alias("qty"), decimal_sum("line_value").alias("revenue"))


def aov_by_brand(sales: DataFrame, per_order: DataFrame | None = None) -> DataFrame:
    """Mean, over the orders that hold a brand, of the value they hold of it. `per_order` are the brands of the orders,
    if at hand."""
    per_order = brands_of_orders(sales) if per_order is None else per_order
    return per_order.groupBy("brand").agg(ratio(exact_sum("revenue"), F.count("revenue")).alias("aov_brand"))


def product_sales(sales: DataFrame, dim_product: DataFrame) -> DataFrame:
    """Quantity and revenue per product with its attributes.

    Sales are summed per product before the attributes are joined. A product in two categories is listed in both.
    """
    sold = sales.groupBy("product_id").agg(F.sum("qty").alias("qty_sold"), exact_sum("line_value").alias("revenue"))
    attributes = dim_product.select("product_id", "product_name", "category", "brand")
    return sold.join(attributes, "product_id", "left").select(
        "product_id", "product_name", "category", "brand", "qty_sold", "revenue"
    )


def top_products(product_sales: DataFrame, n: int = TOP_PRODUCTS) -> DataFrame:
    """The best sellers of each category by revenue, then quantity, then name."""
    order = [F.desc("revenue"), F.desc("qty_sold"), F.asc("product_name"), F.asc("product_id")]
    return top_per_group(product_sales, ["category"], order, n, rank_col="rank_in_category")


def regional_split(
    sales: DataFrame, summary: DataFrame, stores: DataFrame, per_order: DataFrame | None = None
) -> DataFrame:
    """Orders, quantity and revenue by region, channel and brand.

    Lines are summed per order and brand before they meet the orders, so a very large order arrives as a few rows,
    and an order then counts once for each of its brands. `per_order` are the brands of the orders, if at hand.
    """
    per_order = brands_of_orders(sales) if per_order is None else per_order
    known = summary.select("order_id", "store_id", F.lit(1).alias("known"))
    per_store = (
        per_order.join(known, "order_id", "left")
        .groupBy("store_id", "brand")
        .agg(F.count("known").alias("orders"), F.sum("qty").alias("qty"), decimal_sum("revenue").alias("revenue"))
    )
    by_place = orders_enriched(per_store, stores).groupBy("region", "channel", "brand")
    return by_place.agg(F.sum("orders").alias("orders"), F.sum("qty").alias("qty"), exact_sum("revenue").alias("revenue"))


def promo_share_orders(summary: DataFrame) -> DataFrame:
    return summary.agg(ratio(_with_promo(), F.count("order_id")).alias("promo_share_orders"))


def promo_share_users(summary: DataFrame) -> DataFrame:
    """Share of users with at least one promoted order; orders without a user count as one user."""
    per_user = summary.groupBy("user_id").agg(F.max(F.coalesce("promo_flag", F.lit(False))).alias("ever"))
    return per_user.agg(ratio(F.count_if("ever"), F.count(F.lit(1))).alias("promo_share_users"))


def promo_share_by_channel(summary: DataFrame, stores: DataFrame) -> DataFrame:
    per_store = summary.groupBy("store_id").agg(
        _with_promo().alias("orders_with_promo"), F.count("order_id").alias("orders_total")
    )
    return (
        orders_enriched(per_store, stores)
        .groupBy("channel")
        .agg(F.sum("orders_with_promo").alias("orders_with_promo"), F.sum("orders_total").alias("orders_total"))
        .withColumn("promo_share_orders", ratio(F.col("orders_with_promo"), F.col("orders_total")))
    )

"""The star schema: product, store and date dimensions, item and basket facts, and the affinity support tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.dates import date_key, order_date
from shelfline.functions.money import exact_sum
from shelfline.operators.dedup import dedup

# fixed values: region of each location
REGIONS = {
    "Cologne": "NRW", "Berlin": "Berlin", "Munich": "Bavaria", "Hamburg": "Hamburg",
    "Metzingen": "Baden-Württemberg", "Online": "Online",
}
# fixed value: the location that is not a shop
ONLINE = "Online"


def clean_orders(orders: DataFrame, order: list[str] | None = None) -> DataFrame:
    return dedup(orders, ["order_id"], order)


def clean_items(items: DataFrame, order: list[str] | None = None) -> DataFrame:
    return dedup(items, ["order_id", "product_id"], order)


def clean_products(products: DataFrame, order: list[str] | None = None) -> DataFrame:
    return dedup(products, ["product_id"], order)


def region_of(location: Column) -> Column:
    """Region of a location, NULL for an unknown one."""
    entries = [F.lit(part) for entry in REGIONS.items() for part in entry]
    return F.create_map(*entries)[location]


def dim_product(products: DataFrame, cats: DataFrame) -> DataFrame:
    """Products with their category; a product in two categories has two rows."""
    named = products.select("product_id", F.col("name").alias("product_name"), "brand")
    return named.join(cats.select("product_id", "category"), "product_id", "left").select(
        "product_id",
        "product_name",
        "category",
        "brand",
        F.lit(True).alias("is_active"),
        F.lit(None).cast("timestamp").alias("effective_ts"),
    )


def dim_store(orders: DataFrame) -> DataFrame:
    """The locations that took orders, with region and channel."""
    stores = orders.where("location IS NOT NULL").select(F.col("location").alias("store_id")).distinct()
    return stores.select(
        "store_id",
        region_of(F.col("store_id")).alias("region"),
        F.when(F.col("store_id") == ONLINE, "online").otherwise("offline").alias("channel"),
    )


def dim_date(orders: DataFrame) -> DataFrame:
    """The days with orders, taken from the order ids; ids without a valid day are left out."""
    days = orders.select(order_date("order_id").alias("date")).where("date IS NOT NULL").distinct()
    return days.select(
        "date",
        date_key("date").alias("date_key"),
        F.year("date").alias("year"),
        F.quarter("date").alias("quarter"),
        F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"),
        F.date_format("date", "E").alias("day_of_week"),
    )


def fact_sales_item(items: DataFrame, products: DataFrame, cats: DataFrame) -> DataFrame:
    """Order lines with price, value, category and brand.

    The two product tables are joined with each other first, so the lines, by far the larger side, take part in one
    join only. The full join keeps the category of a product that has no product row.
    """
    priced = products.select("product_id", F.col("base_price").cast("double").alias("unit_price"), "brand")
    attributes = priced.join(cats.select("product_id", "category"), "product_id", "full")
    lines = items.select("order_id", "product_id", F.col("amount").cast("double").alias("qty"))
    return lines.join(attributes, "product_id", "left").select(
        "order_id",
        "product_id",
        "qty",
        "unit_price",
        (F.col("qty") * F.col("unit_price")).alias("line_value"),
        "category",
        "brand",
    )


def distinct_baskets(items: DataFrame) -> DataFrame:
    """Which products an order holds, once each."""
    return items.select("order_id", "product_id").distinct()


def one_category(cats: DataFrame) -> bool:
    """Whether no product has two categories: the lines of `fact_sales_item` then hold each product of an order once."""
    return cats.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def basket_totals(sales: DataFrame, single: bool = False) -> DataFrame:
    """Size, quantity and value per order in one pass.

    Lines are first summed per order and product, unless `single` says that they hold each product of an order once.
    That makes the size a plain count, and an order with very many lines is reduced on the map side.
    """
    if single:
        return sales.groupBy("order_id").agg(
            F.count("product_id").alias("basket_size"),
            F.sum("qty").alias("basket_qty"),
            exact_sum("line_value").alias("basket_value"),
        )
    per_product = sales.groupBy("order_id", "product_id").agg(
        F.sum("qty").alias("qty"), exact_sum("line_value").alias("line_value")
    )
    return per_product.groupBy("order_id").agg(
        F.count("product_id").alias("basket_size"),
        F.sum("qty").alias("basket_qty"),
        exact_sum("line_value").alias("basket_value"),
    )


def basket_heads(orders: DataFrame) -> DataFrame:
    """The basket summary without the totals, for figures that need none: no line is read."""
    return orders.select(
        "order_id",
        "user_id",
        order_date("order_id").alias("order_date"),
        F.col("location").cast("string").alias("store_id"),
        F.col("promo_flag").cast("boolean").alias("promo_flag"),
        F.col("promo_code").cast("string").alias("promo_code"),
    )


def fact_basket_summary(orders: DataFrame, sales: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """One row per order; an order without lines keeps NULL totals. `totals` are the basket totals, if at hand:
    else they are taken from the lines."""
    return basket_heads(orders).join(basket_totals(sales) if totals is None else totals, "order_id", "left")


def product_counts(baskets: DataFrame) -> DataFrame:
    """Baskets per product; `baskets` has each (order, product) once, so a count is the distinct count."""
    return baskets.groupBy("product_id").agg(F.count("order_id").alias("basket_cnt"))


def total_baskets(baskets: DataFrame) -> DataFrame:
    """Number of baskets, as a one-row table."""
    return baskets.agg(F.count_distinct("order_id").alias("n"))

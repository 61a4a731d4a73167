"""Live figures over the landed event tables: cards, one-minute series and pairs inside sold combinations.

`as_of` stands for the present and is a column: a literal, `current_timestamp()`, or the latest event time (`latest`).
All figures look back from it by `length`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.dates import interval, time_bin
from shelfline.functions.money import ratio_or_zero
from shelfline.functions.text import not_empty, pair_key
from shelfline.operators.pairs import BULKY, pair_counts
from shelfline.operators.ranking import top_n
from shelfline.operators.retention import last
from shelfline.operators.series import aligned_bin, cumulative, make_series
from shelfline.operators.sketches import bin_sketches
from shelfline.operators.top_pairs import top_pairs as top_pairs_of
from shelfline.session import stored

# fixed values: how far back the figures look, and their bin length
TRAILING = "1 hour"
STEP = "1 minute"


def latest(df: DataFrame, ts: str = "event_time") -> Column:
    """The latest time in a table as a literal: a job that returns one row, after which the time filters are plain
    constants that reach the scan."""
    micros = df.agg(F.unix_micros(F.max(ts)).alias("micros")).first()["micros"]
    return F.timestamp_micros(F.lit(micros).cast("bigint"))


def items_sold(items: DataFrame, orders: DataFrame, as_of: Column, length: str = TRAILING) -> DataFrame:
    """Units in the orders of the trailing window: the few recent orders meet the items before anything is summed.

    Items that carry their own day, as landed tables do, are cut to the days of the window first.
    """
    recent = last(orders, "event_time", as_of, length).select("order_id")
    if "event_date" in items.columns:
        items = items.where(F.col("event_date") >= (as_of - interval(length)).cast("date"))
    sold = items.select("order_id", "quantity").join(recent, "order_id")
    return sold.agg(F.coalesce(F.sum("quantity"), F.lit(0)).alias("items_sold"))


def revenue(orders: DataFrame, as_of: Column, length: str = TRAILING) -> DataFrame:
    """Revenue since the start of the trailing window."""
    recent = last(orders, "event_time", as_of, length, upper=False)
    return recent.agg(F.coalesce(F.sum("total_price"), F.lit(0.0)).alias("revenue"))


def _per_bin(orders: DataFrame, as_of: Column, length: str, step: str, *aggregates: Column) -> DataFrame:
    recent = last(orders, "event_time", as_of, length)
    binned = recent.withColumn("bin", time_bin("event_time", step))
    return binned.groupBy(F.col("bin").alias("event_time")).agg(*aggregates)


def orders_per_bin(orders: DataFrame, as_of: Column, length: str = TRAILING, step: str = STEP) -> DataFrame:
    return _per_bin(orders, as_of, length, step, F.count(F.lit(1)).alias("orders")).orderBy("event_time")


def aov_per_bin(orders: DataFrame, as_of: Column, length: str = TRAILING, step: str = STEP) -> DataFrame:
    """Revenue per order and bin."""
    value = ratio_or_zero(F.sum("total_price"), F.count(F.lit(1)))
    return _per_bin(orders, as_of, length, step, value.alias("aov")).orderBy("event_time")


def promo_usage(orders: DataFrame, as_of: Column, length: str = TRAILING, step: str = STEP) -> DataFrame:
    """Percent of the orders of a bin with a promotion code."""
    value = ratio_or_zero(100.0 * F.count_if(not_empty("promo_code")), F.count(F.lit(1)))
    return _per_bin(orders, as_of, length, step, value.alias("promo_usage_pct")).orderBy("event_time")


def combo_rate(orders: DataFrame, as_of: Column, length: str = TRAILING, step: str = STEP) -> DataFrame:
    """Orders, orders made from a combination, and their percentage, per bin."""
    total, combos = F.count(F.lit(1)), F.count_if(not_empty("combination_id"))
    return _per_bin(
        orders, as_of, length, step,
        total.alias("total_orders"), combos.alias("combo_orders"),
        ratio_or_zero(100.0 * combos, total).alias("combo_order_pct"),
    ).orderBy("event_time")


def _sold(orders: DataFrame, as_of: Column, length: str) -> DataFrame:
    recent = last(orders, "event_time", as_of, length).where(not_empty("combination_id"))
    return recent.select("combination_id", "event_time")


def sold_combos(orders: DataFrame, as_of: Column, length: str = TRAILING) -> DataFrame:
    """Combinations with an order in the trailing window."""
    return _sold(orders, as_of, length).select("combination_id").distinct()


def combo_products(combo_items: DataFrame) -> DataFrame:
    """The distinct products of each combination, in long form: a combination of any size spreads over many rows."""
    return combo_items.where(not_empty("product_id")).select("combination_id", "product_id").distinct()


def combo_sets(combo_items: DataFrame) -> DataFrame:
    """The product set of each combination as a sorted array; a combination is one message, so its set is small."""
    return combo_products(combo_items).groupBy("combination_id").agg(
        F.array_sort(F.collect_list("product_id")).alias("products")
    )


def _sold_products(combo_items: DataFrame, orders: DataFrame, as_of: Column, length: str) -> DataFrame:
    """The distinct products of the sold combinations, stored. The window on the orders cuts the items first."""
    items = combo_items.where(not_empty("product_id")).select("combination_id", "product_id")
    return stored(items.join(sold_combos(orders, as_of, length), "combination_id", "left_semi").distinct(), "sold")


def _pairs_of(products: DataFrame, bulky: int = BULKY) -> DataFrame:
    pairs = pair_counts(products, group="combination_id", bulky=bulky, settled=True)
    return pairs.select(
        F.col("item_a").alias("product_a"), F.col("item_b").alias("product_b"), F.col("pair_cnt").alias("pair_count")
    )


def _top(products: DataFrame, n: int) -> DataFrame:
    """The pairs in most combinations, with a readable key; rarer pairs are not counted."""
    top = top_pairs_of(products, n, group="combination_id", item="product_id")
    top = top.select(F.col("item_a").alias("product_a"), F.col("item_b").alias("product_b"), F.col("pair_cnt").alias("pair_count"))
    return top_n(top, "pair_count", n, ["product_a", "product_b"]).select(
        pair_key("product_a", "product_b").alias("pair_key"), "product_a", "product_b", "pair_count"
    )


def sold_pairs(
    combo_items: DataFrame, orders: DataFrame, as_of: Column, length: str = TRAILING, *, bulky: int = BULKY
) -> DataFrame:
    """Product pairs and the number of sold combinations that hold both. A combination counts once, however often it
    was sold."""
    return _pairs_of(_sold_products(combo_items, orders, as_of, length), bulky)


def top_sold_pairs(
    combo_items: DataFrame, orders: DataFrame, as_of: Column, length: str = TRAILING, n: int = 20
) -> DataFrame:
    """The pairs found in most sold combinations, with a readable key."""
    return _top(_sold_products(combo_items, orders, as_of, length), n)


def top_pairs(
    combo_items: DataFrame, orders: DataFrame, as_of: Column, length: str = TRAILING, n: int = 3
) -> DataFrame:
    """The pairs in most distinct sold combinations."""
    return top_sold_pairs(combo_items, orders, as_of, length, n).withColumnRenamed("pair_count", "combo_count")


def holding(products: DataFrame, pairs: DataFrame) -> DataFrame:
    """(combination_id, pair_key): which combinations hold both products of the given pairs; no other pair is formed."""
    sides = pairs.select("pair_key", F.explode(F.array("product_a", "product_b")).alias("product_id"))
    both = products.join(F.broadcast(sides), "product_id").groupBy("combination_id", "pair_key").agg(F.count(F.lit(1)).alias("sides"))
    return both.where(F.col("sides") == 2).drop("sides")


def pair_sketches(orders: DataFrame, combo_items: DataFrame, pairs: DataFrame, start: Column, step: str = STEP) -> DataFrame:
    """(pair_key, event_time, sketch): mergeable sketches of the combinations sold per pair and bin, bins from `start` on.

    `pairs` has pair_key, product_a, product_b and few rows.
    """
    sold = orders.where(not_empty("combination_id") & (F.col("event_time") >= start))
    binned = sold.select("combination_id", aligned_bin(F.col("event_time"), start, step).alias("event_time")).distinct()
    return bin_sketches(binned.join(holding(combo_products(combo_items), pairs), "combination_id"), ["pair_key"], "event_time", "combination_id")


def pair_series(
    orders: DataFrame,
    combo_items: DataFrame,
    as_of: Column,
    length: str = TRAILING,
    step: str = STEP,
    n: int = 3,
) -> DataFrame:
    """Running totals, per bin, of the distinct combinations sold of the top pairs.

    Bins start at the beginning of the trailing window and end before `as_of`. A combination sold in two bins counts
    in both. Only the products of the `n` top pairs are read from the combinations again: a combination holds a pair
    when it holds both of its products, so no other pair is formed.
    """
    start = as_of - interval(length)
    products = _sold_products(combo_items, orders, as_of, length)
    top = _top(products, n)
    sold = _sold(orders, as_of, length).where(F.col("event_time") < as_of)
    sold_bins = sold.select("combination_id", aligned_bin(F.col("event_time"), start, step).alias("event_time")).distinct()
    binned = (
        sold_bins.join(holding(products, top), "combination_id")
        .groupBy("pair_key", "event_time")
        .agg(F.count(F.lit(1)).alias("combinations"))
    )
    dense = make_series(binned, ["pair_key"], "event_time", "combinations", start, as_of, step)
    return cumulative(dense, ["pair_key"], "event_time", "combinations", "cum").select("event_time", "pair_key", "cum")

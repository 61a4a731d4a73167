"""Market-basket affinity: which products are bought together more often than chance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline import schemas
from shelfline.functions.money import ratio
from shelfline.operators.pairs import BULKY, pair_counts
from shelfline.operators.ranking import top_per_group
from shelfline.plans.silver import distinct_baskets, product_counts
from shelfline.session import stored
from shelfline.sources.tables import empty_like

# fixed values: pairs below this count are noise, and how many partners a product keeps
MIN_PAIR_CNT = 5
TOP_K = 10

PROMO_ONLY = "promo_only"
NON_PROMO_ONLY = "non_promo_only"


def filter_baskets(
    items: DataFrame,
    summary: DataFrame,
    start: str | None = None,
    end: str | None = None,
    store_ids: Sequence[str] = (),
    promo_context: str | None = None,
    *,
    settled: bool = False,
) -> DataFrame:
    """Baskets of the orders in a date range (both ends included), in given stores, with or without promotion.

    An empty store list and a missing bound switch that filter off. An order whose flag is NULL counts as without
    promotion. The filters act on the order table before the join. `settled` says that `items` has each product of an
    order once already.
    """
    if promo_context not in (None, PROMO_ONLY, NON_PROMO_ONLY):
        raise ValueError(f"unknown promo context: {promo_context}")
    baskets = items.select("order_id", "product_id") if settled else distinct_baskets(items)
    promoted = F.coalesce("promo_flag", F.lit(False))
    tests: list[Column] = []
    if start:
        tests.append(F.col("order_date") >= F.lit(start).cast("date"))
    if end:
        tests.append(F.col("order_date") <= F.lit(end).cast("date"))
    if store_ids:
        tests.append(F.col("store_id").isin(*store_ids))
    if promo_context:
        tests.append(promoted if promo_context == PROMO_ONLY else ~promoted)
    if not tests:
        return baskets
    orders = summary
    for test in tests:
        orders = orders.where(test)
    return baskets.join(orders.select("order_id"), "order_id", "left_semi")


def directed(pairs: DataFrame) -> DataFrame:
    """Both directions of each pair: one pass over the pairs, two rows for each."""
    one_way = F.struct(
        F.col("item_a").alias("lhs_item_id"), F.col("item_b").alias("rhs_item_id"),
        F.col("cnt_a").alias("lhs_cnt"), F.col("cnt_b").alias("rhs_cnt"),
    )
    other_way = F.struct(
        F.col("item_b").alias("lhs_item_id"), F.col("item_a").alias("rhs_item_id"),
        F.col("cnt_b").alias("lhs_cnt"), F.col("cnt_a").alias("rhs_cnt"),
    )
    both = pairs.select(F.explode(F.array(one_way, other_way)).alias("d"), "pair_cnt")
    return both.select("d.lhs_item_id", "d.rhs_item_id", "pair_cnt", "d.lhs_cnt", "d.rhs_cnt")


def affinity(
    baskets: DataFrame,
    min_pair_cnt: int = MIN_PAIR_CNT,
    refreshed_at: Column | None = None,
    *,
    bulky: int = BULKY,
    settled: bool = False,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Support, confidence and lift of every product pair with at least `min_pair_cnt` baskets, in both directions.

    Item counts and the number of baskets come from all baskets; only the pairs are pruned. No baskets give no rows.
    The distinct baskets are stored for the several passes over them, unless `settled` says that `baskets` is such a
    stored table already; `counts` may then give their table of (product_id, basket_cnt).
    """
    members = baskets.select("order_id", "product_id")
    if not settled:
        members = stored(distinct_baskets(members), "baskets")
    sizes = members.where("order_id IS NOT NULL").groupBy("order_id").agg(F.count("product_id").alias("size"))
    total, largest = sizes.agg(F.count(F.lit(1)), F.max("size")).first()
    if counts is None:
        counts = stored(product_counts(members), "counts")
    per_item = counts.select(F.col("product_id").alias("item"), F.col("basket_cnt").alias("cnt"))
    counted = pair_counts(
        members, min_pair_cnt, bulky=bulky, settled=True, counts=per_item, largest_size=largest or 0, with_counts=True
    )
    both = directed(counted).withColumn("total", F.lit(total))
    pair_cnt, lhs_cnt, rhs_cnt = (F.col(name).cast("double") for name in ("pair_cnt", "lhs_cnt", "rhs_cnt"))
    return both.select(
        "lhs_item_id",
        "rhs_item_id",
        "pair_cnt",
        "lhs_cnt",
        "rhs_cnt",
        ratio(lhs_cnt, F.col("total")).alias("support_lhs"),
        ratio(rhs_cnt, F.col("total")).alias("support_rhs"),
        ratio(pair_cnt, F.col("total")).alias("support_pair"),
        F.coalesce(ratio(pair_cnt, lhs_cnt), F.lit(0.0)).alias("confidence_lhs_to_rhs"),
        ratio(pair_cnt * F.col("total"), lhs_cnt * rhs_cnt).alias("lift"),
        (F.current_timestamp() if refreshed_at is None else refreshed_at).alias("refreshed_at"),
    )


def best_first() -> list[Column]:
    """Order of recommendations; the item id ends it, so that ties have one answer."""
    return [F.desc("lift"), F.desc("confidence_lhs_to_rhs"), F.desc("pair_cnt"), F.asc("rhs_item_id")]


def topk(affinity: DataFrame, k: int = TOP_K) -> DataFrame:
    """The `k` strongest partners of each product."""
    return top_per_group(affinity, ["lhs_item_id"], best_first(), k)


def named_topk(topk: DataFrame, dim_product: DataFrame) -> DataFrame:
    """Partners with product names."""
    names = dim_product.select("product_id", "product_name")
    lhs = names.select(F.col("product_id").alias("lhs_item_id"), F.col("product_name").alias("lhs_name"))
    rhs = names.select(F.col("product_id").alias("rhs_item_id"), F.col("product_name").alias("rhs_name"))
    return (
        topk.join(lhs, "lhs_item_id", "left")
        .join(rhs, "rhs_item_id", "left")
        .select(
            "lhs_item_id", "lhs_name", "rhs_item_id", "rhs_name",
            "pair_cnt", "support_pair", "confidence_lhs_to_rhs", "lift", "refreshed_at",
        )
    )


def empty_affinity(spark: SparkSession) -> DataFrame:
    return empty_like(spark, schemas.AFFINITY_DDL)


def empty_named_topk(spark: SparkSession) -> DataFrame:
    return empty_like(spark, schemas.AFFINITY_NAMED_DDL)

"""Everyday questions: stock, product attributes, orders of a month, what else is bought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.text import same_text, size_sort_key
from shelfline.operators.ranking import top_per_group
from shelfline.plans.affinity import MIN_PAIR_CNT, TOP_K, best_first, named_topk

# fixed values: the location asked about when none is named, and how many name matches are offered
DEFAULT_LOCATION = "Cologne"
MAX_MATCHES = 5


def resolve_product(products: DataFrame, name: str, limit: int = MAX_MATCHES) -> DataFrame:
    """Up to `limit` products whose name holds the text, without regard to case; exact names come first."""
    matches = products.where(F.lower("name").contains(F.lower(F.lit(name)))).select("product_id", "name")
    return matches.orderBy(F.desc(same_text("name", name)), "product_id").limit(limit)


def _named(products: DataFrame, name: str | None, product_id: str | None) -> Column:
    if product_id is not None:
        return F.col("product_id") == product_id
    if name is None:
        raise ValueError("give a product name or a product id")
    return same_text("name", name)


def stock(
    products: DataFrame,
    inventory: DataFrame,
    name: str | None = None,
    location: str = DEFAULT_LOCATION,
    *,
    product_id: str | None = None,
) -> DataFrame:
    """Stock over all sizes of the products of a name (or one id) at a location; 0 where none is kept."""
    wanted = products.where(_named(products, name, product_id)).select("product_id")
    kept = inventory.where(F.col("location") == location).select("product_id", "amount")
    return (
        wanted.join(kept, "product_id", "left")
        .groupBy("product_id")
        .agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("total_stock"))
    )


def stock_by_size(
    products: DataFrame,
    inventory: DataFrame,
    name: str | None = None,
    location: str = DEFAULT_LOCATION,
    *,
    product_id: str | None = None,
) -> DataFrame:
    """Stock per product and size in size order."""
    wanted = products.where(_named(products, name, product_id)).select("product_id")
    kept = inventory.where(F.col("location") == location).join(wanted, "product_id", "left_semi")
    sized = kept.groupBy("product_id", "size").agg(F.sum("amount").alias("amount"))
    return sized.orderBy("product_id", size_sort_key("size"))


def stock_by_material(
    products: DataFrame,
    cats: DataFrame,
    inventory: DataFrame,
    category: str,
    material: str,
    location: str = DEFAULT_LOCATION,
) -> DataFrame:
    """Stock per size of the products of a category and material at a location, in size order."""
    in_category = cats.where(F.col("category") == category).select("product_id")
    wanted = products.where(same_text("material", material)).join(in_category, "product_id", "left_semi")
    kept = inventory.where(F.col("location") == location).join(wanted.select("product_id"), "product_id", "left_semi")
    return kept.groupBy("size").agg(F.sum("amount").alias("amount")).orderBy(size_sort_key("size"))


def attributes(
    products: DataFrame,
    name: str | None = None,
    *,
    product_id: str | None = None,
    columns: tuple[str, ...] = ("color", "material"),
) -> DataFrame:
    """Chosen attributes of the products of a name, beside their id and name."""
    found = products.where(_named(products, name, product_id))
    return found.select("product_id", "name", *[c for c in columns if c not in ("product_id", "name")])


def orders_in_month(summary: DataFrame, month: int, min_size: int, year: int | None = None) -> DataFrame:
    """Number of orders of a month with more than `min_size` different products."""
    in_month = F.month("order_date") == month
    if year is not None:
        in_month = in_month & (F.year("order_date") == year)
    return summary.where(in_month & (F.col("basket_size") > min_size)).agg(F.count("order_id").alias("orders"))


def recommend(
    named: DataFrame,
    affinity: DataFrame,
    dim_product: DataFrame,
    anchors: DataFrame,
    k: int = TOP_K,
    min_pair_cnt: int = MIN_PAIR_CNT,
) -> DataFrame:
    """What is bought with the products in `anchors` (a column lhs_item_id), for any number of them at once.

    The ready-made top partners answer first. Products without any there fall back to the full affinity table,
    without pairs below `min_pair_cnt`.
    """
    wanted = anchors.select("lhs_item_id").distinct()
    ready = named.join(wanted, "lhs_item_id", "left_semi")
    uncovered = wanted.join(named.select("lhs_item_id"), "lhs_item_id", "left_anti")
    full = affinity.where(F.col("pair_cnt") >= min_pair_cnt).join(uncovered, "lhs_item_id", "left_semi")
    fallback = named_topk(top_per_group(full, ["lhs_item_id"], best_first(), k), dim_product)
    answer = ready.unionByName(fallback).select(
        "lhs_item_id", "rhs_item_id", "rhs_name", "lift",
        F.col("confidence_lhs_to_rhs").alias("confidence"), "pair_cnt",
    )
    return answer.orderBy(
        "lhs_item_id", F.desc("lift"), F.desc("confidence"), F.desc("pair_cnt"), "rhs_item_id"
    )

"""Bronze, silver and gold in order. A layer starts when the one before it is written.

Each table is written once and read back where a later one needs it, so nothing is computed twice and a lost executor
costs at most the work of the table at hand. A layer comes into force when all its tables are written; until then, and
if its build fails, readers have the one before.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.plans import affinity, kpis, silver
from shelfline.session import build_session, stored
from shelfline.sources.tables import (
    BRONZE_TABLES,
    Layer,
    read_table,
    register_model,
    write_table,
)


@dataclass(frozen=True)
class Options:
    """Settings of a load. `order_buckets` lays the three facts out by order, so that the joins between them need no
    shuffle. Leave it out where single orders are huge: a bucket is read by one task, while a shuffled join can split
    such an order."""

    fmt: str = "parquet"
    min_pair_cnt: int = affinity.MIN_PAIR_CNT
    top_k: int = affinity.TOP_K
    start: str | None = None
    end: str | None = None
    store_ids: Sequence[str] = ()
    promo_context: str | None = None
    refreshed_at: Column | None = None
    item_order: list[str] | None = field(default=None)
    order_buckets: int | None = None


def load_bronze(spark: SparkSession, tables: dict[str, DataFrame], bronze: str, fmt: str = "parquet") -> None:
    """Write the raw tables."""
    with Layer(spark, bronze).rebuild() as build:
        for name in BRONZE_TABLES:
            write_table(tables[name], build, name, fmt)


def build_silver(spark: SparkSession, bronze: str, ns: str, options: Options = Options()) -> None:
    with Layer(spark, ns).rebuild() as build:
        _silver_tables(spark, bronze, build, options)


def _silver_tables(spark: SparkSession, bronze: str, ns: str, options: Options) -> None:
    def raw(name: str) -> DataFrame:
        return read_table(spark, bronze, name)

    def write(df: DataFrame, name: str, by_order: bool = False) -> DataFrame:
        buckets = (options.order_buckets, "order_id") if by_order and options.order_buckets else None
        write_table(df, ns, name, options.fmt, buckets=buckets)
        return read_table(spark, ns, name)

    products = silver.clean_products(raw("products"))
    cats = raw("product_categories")
    write(silver.dim_product(products, cats), "dim_product")
    items = silver.clean_items(raw("order_items"), options.item_order)
    sales = write(silver.fact_sales_item(items, products, cats), "fact_sales_item", by_order=True)
    single = silver.one_category(cats)
    held = sales.select("order_id", "product_id") if single else silver.distinct_baskets(sales)
    baskets = write(held, "fact_basket_product", by_order=True)
    totals = stored(silver.basket_totals(sales, single), "totals")
    orders = silver.clean_orders(raw("orders"))
    summary = write(silver.fact_basket_summary(orders, sales, totals), "fact_basket_summary", by_order=True)
    # The kept orders now stand in the summary; both small dimensions come from there.
    kept = summary.select("order_id", F.col("store_id").alias("location"))
    write(silver.dim_store(kept), "dim_store")
    write(silver.dim_date(kept), "dim_date")
    write(silver.product_counts(baskets), "fact_product_counts")
    write(totals.agg(F.count("order_id").alias("n")), "kx_total_baskets")


def build_gold(spark: SparkSession, ns_silver: str, ns: str, options: Options = Options()) -> None:
    with Layer(spark, ns).rebuild() as build:
        _gold_tables(spark, ns_silver, build, options)


def _gold_tables(spark: SparkSession, ns_silver: str, ns: str, options: Options) -> None:
    def read(name: str) -> DataFrame:
        return read_table(spark, ns_silver, name)

    def write(df: DataFrame, name: str) -> DataFrame:
        write_table(df, ns, name, options.fmt)
        return read_table(spark, ns, name)

    products, stores = read("dim_product"), read("dim_store")
    sales, summary = read("fact_sales_item"), read("fact_basket_summary")

    baskets = read("fact_basket_product")
    filters = (options.start, options.end, options.store_ids, options.promo_context)
    if any(filters):
        scored = affinity.affinity(
            stored(affinity.filter_baskets(baskets, summary, *filters, settled=True), "baskets"),
            options.min_pair_cnt, options.refreshed_at, settled=True,
        )
    else:
        scored = affinity.affinity(
            baskets, options.min_pair_cnt, options.refreshed_at, settled=True, counts=read("fact_product_counts")
        )
    full = write(scored, "fact_product_affinity")
    top = write(affinity.topk(full, options.top_k), "fact_product_affinity_topk")
    write(affinity.named_topk(top, products), "product_affinity_topk_named")

    write(kpis.aov_overall(summary), "sales_aov_overall")
    write(kpis.aov_by_region_channel(summary, stores), "sales_aov_by_region_channel")
    per_order = stored(kpis.brands_of_orders(sales), "brands")
    write(kpis.aov_by_brand(sales, per_order), "sales_aov_by_brand")
    write(kpis.top_products(kpis.product_sales(sales, products)), "sales_top_products_by_category")
    write(kpis.regional_split(sales, summary, stores, per_order), "sales_regional_split")
    write(kpis.promo_share_orders(summary), "sales_promo_share_orders")
    write(kpis.promo_share_users(summary), "sales_promo_share_users")
    write(kpis.promo_share_by_channel(summary, stores), "sales_promo_share_by_channel")


def full_load(
    spark: SparkSession,
    bronze: str,
    silver_ns: str,
    gold: str,
    tables: dict[str, DataFrame] | None = None,
    options: Options = Options(),
    views: str | None = None,
) -> list[str]:
    """Run the layers in order and register the reporting views, in a namespace of their own if one is named. Without
    `tables` the bronze layer is taken as is."""
    if tables is not None:
        load_bronze(spark, tables, bronze, options.fmt)
    build_silver(spark, bronze, silver_ns, options)
    build_gold(spark, silver_ns, gold, options)
    return register_model(spark, silver_ns, gold, views)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("bronze", "silver", "gold"):
        parser.add_argument(f"--{name}", required=True, help=f"namespace of the {name} layer")
    parser.add_argument("--views", help="namespace of the reporting views; default: that of gold with _model")
    parser.add_argument("--format", default="parquet")
    parser.add_argument("--min-pair-cnt", type=int, default=affinity.MIN_PAIR_CNT, help="least baskets of a pair")
    parser.add_argument("--top-k", type=int, default=affinity.TOP_K, help="partners per product")
    parser.add_argument("--start", help="first order date")
    parser.add_argument("--end", help="last order date")
    parser.add_argument("--store", action="append", default=[], help="only this store; may be repeated")
    parser.add_argument("--promo-context", choices=[affinity.PROMO_ONLY, affinity.NON_PROMO_ONLY])
    parser.add_argument("--order-buckets", type=int)
    args = parser.parse_args()
    options = Options(
        args.format, args.min_pair_cnt, args.top_k, args.start, args.end, args.store, args.promo_context,
        order_buckets=args.order_buckets,
    )
    spark = build_session("full-load")
    full_load(spark, args.bronze, args.silver, args.gold, options=options, views=args.views or f"{args.gold}_model")


if __name__ == "__main__":
    main()

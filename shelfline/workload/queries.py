"""Named queries: each takes a session and the folder of the tables and returns a DataFrame."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline import schemas
from shelfline.functions import ids, money, text
from shelfline.functions.dates import interval
from shelfline.jobs.full_load import Options, full_load
from shelfline.operators.nested import array_pairs
from shelfline.operators.retention import last, prune
from shelfline.operators.sketches import window_estimates
from shelfline.plans import affinity as aff
from shelfline.plans import bronze, kpis, live, lookups, report, semantic, silver
from shelfline.session import freed, scratch_dir, stored, tune
from shelfline.sources import catalog, events, testbed
from shelfline.sources.tables import AFFINITY_GOLD, REPORT_GOLD, REPORT_SILVER, preview, read_table
from shelfline.streaming import ingest, totals, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Pairs of single products are rare in the test tables, so product-level queries keep pairs seen twice.
MIN_PAIRS = 2
REFRESHED = "2024-01-01 00:00:00"
WEEK, HOUR = "7 days", "1 hour"
MONTH, DAY = "30 days", "1 day"


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(tune(spark), sf)

    QUERIES[fn.__name__] = run
    return run


def rounded(df: DataFrame, digits: int = 6, **per_column: int) -> DataFrame:
    """Round the double columns, since sums of doubles depend on the order of the rows."""
    columns: list[Column] = []
    for f in df.schema.fields:
        column = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            column = F.round(column, per_column.get(f.name, digits)).alias(f.name)
        columns.append(column)
    return df.select(*columns)


def readable(df: DataFrame, *names: str) -> DataFrame:
    """Timestamps as text."""
    return df.withColumns({name: F.date_format(name, "yyyy-MM-dd HH:mm:ss") for name in names})


# --- bronze ---------------------------------------------------------------------------------------------------------


@query
def bronze_products(spark: SparkSession, sf: str) -> DataFrame:
    built = bronze.variants(testbed.title_catalog(spark, sf), width=8)
    return bronze.products(built).join(bronze.product_categories(built), "product_id")


@query
def bronze_orders(spark: SparkSession, sf: str) -> DataFrame:
    return testbed.orders(spark, sf)


@query
def bronze_order_items(spark: SparkSession, sf: str) -> DataFrame:
    return testbed.order_items(spark, sf)


@query
def bronze_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return testbed.product_inventory(spark, sf)


@query
def inventory_preview(spark: SparkSession, sf: str) -> DataFrame:
    return preview(testbed.product_inventory(spark, sf), ["product_id", "location", "size"])


@query
def inventory_grid(spark: SparkSession, sf: str) -> DataFrame:
    sizes = {
        "ECONOMY": ["XS", "S", "M"], "STANDARD": ["S", "M", "L", "XL"], "SMALL": ["XS", "S"],
        "MEDIUM": ["M", "L"], "LARGE": ["L", "XL", "XXL"], "PROMO": ["M"],
    }
    return bronze.inventory_grid(
        testbed.product_categories(spark, sf), testbed.product_inventory(spark, sf), sizes
    )


@query
def brand_from_title(spark: SparkSession, sf: str) -> DataFrame:
    titles = testbed.title_catalog(spark, sf)
    return titles.select("title_no", "title", text.brand_from_title("title").alias("brand"))


@query
def catalog_flat(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_dir(spark, "catalog")
    testbed.catalog_documents(spark, sf).write.text(folder)
    flat = catalog.read_catalog(spark, folder, whole_file=False)
    shown = {"sizes": F.array_join("sizes", ","), "discount": F.col("discount").cast("double")}
    return rounded(flat.withColumns(shown), 2)


@query
def catalog_split(spark: SparkSession, sf: str) -> DataFrame:
    """The same products from documents laid out over many lines, several in a file, which are split as they are read."""
    folder = scratch_dir(spark, "catalog")
    testbed.catalog_documents(spark, sf, pretty="true").write.text(folder)
    shown = {"sizes": F.array_join("sizes", ","), "discount": F.col("discount").cast("double")}
    return rounded(catalog.read_catalog(spark, folder).withColumns(shown), 2)


@query
def combination_id(spark: SparkSession, sf: str) -> DataFrame:
    baskets = testbed.kept_items(spark, sf).groupBy("order_id")
    return baskets.agg(F.collect_list("product_id").alias("product_ids")).select(
        "order_id", ids.combination_id("product_ids").alias("combination_id")
    )


@query
def price_orders(spark: SparkSession, sf: str) -> DataFrame:
    value = F.bround("basket_value", 2)
    priced = money.price_order("subtotal", "promo_code")
    orders = testbed.summary(spark, sf).select("order_id", "promo_code", value.alias("subtotal"))
    return rounded(
        orders.select("order_id", "promo_code", "subtotal", priced.discount.alias("discount"),
                      priced.total.alias("total_price")), 2)


@query
def event_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_dir(spark, "published")
    events.publish(events.to_events(testbed.sale_events(spark, sf), "order_id"), folder)
    parsed = events.parse_events(spark.read.text(folder), schemas.SALE_EVENT)
    return rounded(
        parsed.select(
            "event_type", "event_time", "order_id", "combination_id", "user", "is_community_created", "promo_code",
            "discount", "total_price",
            F.coalesce(F.size("items"), F.lit(0)).alias("n_items"),
            F.array_join(F.transform("items", lambda i: i["product_id"]), ",").alias("product_ids"),
        ), 2)


# --- silver ---------------------------------------------------------------------------------------------------------


@query
def dedup_order_items(spark: SparkSession, sf: str) -> DataFrame:
    return testbed.kept_items(spark, sf).select("order_id", "product_id", "amount", "l_linenumber")


@query
def dim_product(spark: SparkSession, sf: str) -> DataFrame:
    return testbed.products_dim(spark, sf).withColumn("effective_ts", F.col("effective_ts").cast("string"))


@query
def dim_store(spark: SparkSession, sf: str) -> DataFrame:
    return testbed.stores_dim(spark, sf)


@query
def dim_date(spark: SparkSession, sf: str) -> DataFrame:
    return silver.dim_date(testbed.order_ids(spark, sf))


@query
def fact_sales_item(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(testbed.sales(spark, sf), 2)


@query
def fact_basket_product(spark: SparkSession, sf: str) -> DataFrame:
    return testbed.baskets(spark, sf)


@query
def fact_basket_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(testbed.summary(spark, sf).withColumn("basket_size", F.col("basket_size").cast("double")), 2)


@query
def fact_product_counts(spark: SparkSession, sf: str) -> DataFrame:
    return silver.product_counts(testbed.baskets(spark, sf))


@query
def kx_total_baskets(spark: SparkSession, sf: str) -> DataFrame:
    return silver.total_baskets(testbed.baskets(spark, sf))


# --- affinity -------------------------------------------------------------------------------------------------------


def _affinity(spark: SparkSession, sf: str, **filters) -> DataFrame:
    baskets = testbed.baskets(spark, sf)
    if filters:
        baskets = aff.filter_baskets(baskets, testbed.heads(spark, sf), **filters, settled=True)
    return aff.affinity(stored(baskets, "baskets"), MIN_PAIRS, F.lit(REFRESHED).cast("timestamp"), settled=True)


def _named(spark: SparkSession, sf: str, table: DataFrame) -> DataFrame:
    return aff.named_topk(aff.topk(table), testbed.products_dim(spark, sf))


@query
def product_affinity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(readable(_affinity(spark, sf), "refreshed_at"))


@query
def affinity_topk(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(readable(aff.topk(_affinity(spark, sf), 3), "refreshed_at"))


@query
def affinity_topk_named(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(readable(_named(spark, sf, _affinity(spark, sf)), "refreshed_at"))


@query
def affinity_date_range(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(readable(_affinity(spark, sf, start="1996-01-01", end="1998-12-31"), "refreshed_at"))


@query
def affinity_stores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(readable(_affinity(spark, sf, store_ids=["Cologne", "Online"]), "refreshed_at"))


@query
def affinity_promo_only(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(readable(_affinity(spark, sf, promo_context=aff.PROMO_ONLY), "refreshed_at"))


@query
def affinity_non_promo(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(readable(_affinity(spark, sf, promo_context=aff.NON_PROMO_ONLY), "refreshed_at"))


@query
def affinity_empty(spark: SparkSession, sf: str) -> DataFrame:
    return readable(_affinity(spark, sf, store_ids=["Nowhere"]), "refreshed_at")


@query
def affinity_brands(spark: SparkSession, sf: str) -> DataFrame:
    """The same figures between brands, with the default support bound."""
    brands = testbed.sales(spark, sf).select("order_id", F.col("brand").alias("product_id"))
    return rounded(readable(aff.affinity(brands, refreshed_at=F.lit(REFRESHED).cast("timestamp")), "refreshed_at"))


@query
def recommend(spark: SparkSession, sf: str) -> DataFrame:
    """Partners of every product: from promoted orders where there are any, else from all orders."""
    baskets = stored(testbed.baskets(spark, sf), "baskets")
    refreshed = F.lit(REFRESHED).cast("timestamp")
    chosen = aff.filter_baskets(baskets, testbed.heads(spark, sf), promo_context=aff.PROMO_ONLY, settled=True)
    promoted = stored(chosen, "promoted")
    named = stored(_named(spark, sf, aff.affinity(promoted, MIN_PAIRS, refreshed, settled=True)), "named")
    full = aff.affinity(baskets, MIN_PAIRS, refreshed, settled=True)
    anchors = testbed.products(spark, sf).select(F.col("product_id").alias("lhs_item_id"))
    return rounded(lookups.recommend(named, full, testbed.products_dim(spark, sf), anchors, min_pair_cnt=MIN_PAIRS))


# --- key figures ----------------------------------------------------------------------------------------------------


@query
def aov_overall(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(kpis.aov_overall(testbed.summary(spark, sf)))


@query
def aov_by_region_channel(spark: SparkSession, sf: str) -> DataFrame:
    summary = stored(testbed.summary(spark, sf), "summary")
    return rounded(kpis.aov_by_region_channel(summary, testbed.stores_of(summary)), revenue=2)


@query
def aov_by_brand(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(kpis.aov_by_brand(testbed.sales(spark, sf)))


@query
def top_products_by_category(spark: SparkSession, sf: str) -> DataFrame:
    sold = kpis.product_sales(testbed.sales(spark, sf), testbed.products_dim(spark, sf))
    return rounded(kpis.top_products(sold), 2)


@query
def regional_split(spark: SparkSession, sf: str) -> DataFrame:
    m = testbed.model(spark, sf)
    return rounded(kpis.regional_split(m.fact_sales_item, m.fact_basket_summary, m.dim_store), 2)


@query
def promo_share_orders(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(kpis.promo_share_orders(testbed.summary(spark, sf)))


@query
def promo_share_users(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(kpis.promo_share_users(testbed.summary(spark, sf)))


@query
def promo_share_by_channel(spark: SparkSession, sf: str) -> DataFrame:
    summary = stored(testbed.summary(spark, sf), "summary")
    return rounded(kpis.promo_share_by_channel(summary, testbed.stores_of(summary)))


# --- measures and report --------------------------------------------------------------------------------------------


@query
def measure_totals(spark: SparkSession, sf: str) -> DataFrame:
    chosen = [
        semantic.revenue(), semantic.units_sold(), semantic.orders(), semantic.aov(), semantic.promo_orders(),
        semantic.promo_users(),
    ]
    return rounded(semantic.evaluate(testbed.model(spark, sf), [], chosen), revenue=2)


@query
def measure_aov_by_date(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.sales_dashboard(testbed.model(spark, sf))["aov_by_date"])


@query
def measures_by_store(spark: SparkSession, sf: str) -> DataFrame:
    chosen = [semantic.revenue(), semantic.orders(), semantic.aov(), semantic.promo_orders(), semantic.promo_users()]
    figures = semantic.evaluate(testbed.model(spark, sf), ["store_id", "year"], chosen)
    return rounded(figures, revenue=2)


@query
def star_revenue_by_month_channel(spark: SparkSession, sf: str) -> DataFrame:
    chosen = [semantic.revenue(), semantic.units_sold(), semantic.orders()]
    figures = semantic.evaluate(
        testbed.model(spark, sf), ["year", "month", "channel", "category"], chosen, {"region": ["NRW", "Online", "Berlin"]}
    )
    return rounded(figures, 2)


@query
def revenue_by_region_channel(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.sales_dashboard(testbed.model(spark, sf))["revenue_by_region_channel"], 2)


@query
def revenue_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.sales_dashboard(testbed.model(spark, sf, lines_only=True))["revenue_by_category"], 2)


@query
def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    """All visuals of the sales dashboard, from one pass over each fact."""
    shown = report.dashboard(testbed.model(spark, sf)).withColumn("orders", F.col("orders").cast("double"))  # NULL beside numbers
    return rounded(shown, revenue=2)


@query
def report_revenue_by_date_category(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.revenue_by_date_category(testbed.model(spark, sf)), 2)


@query
def report_units(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.units_by_date_brand_category(testbed.model(spark, sf)), 2)


@query
def report_revenue_by_brand(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.revenue_by_brand(testbed.model(spark, sf, lines_only=True), categories=["ECONOMY", "SMALL"]), 2)


@query
def report_units_total(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.units_total(testbed.model(spark, sf, lines_only=True), brands=["Brand#1", "Brand#2"]), 2)


@query
def orders_in_month(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.orders_in_month(testbed.summary(spark, sf), 12, 3)


# --- lookups --------------------------------------------------------------------------------------------------------


@query
def resolve_product(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.resolve_product(testbed.products(spark, sf), "RED w")


@query
def stock_by_name_location(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.stock(testbed.products(spark, sf), testbed.product_inventory(spark, sf), "Red Widget")


@query
def stock_by_size(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.stock_by_size(
        testbed.products(spark, sf), testbed.product_inventory(spark, sf), "blue bolt", "Metzingen"
    )


@query
def stock_by_material(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.stock_by_material(
        testbed.products(spark, sf), testbed.product_categories(spark, sf), testbed.product_inventory(spark, sf),
        "ECONOMY", "Gear",
    )


@query
def product_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.attributes(testbed.products(spark, sf), "hot gear")


# --- live figures ---------------------------------------------------------------------------------------------------


def _binned(spark: SparkSession, sf: str, figure: Callable[..., DataFrame]) -> DataFrame:
    orders = testbed.purchases(spark, sf)
    return rounded(readable(figure(orders, live.latest(orders), WEEK, HOUR), "event_time"))


@query
def live_items_sold(spark: SparkSession, sf: str) -> DataFrame:
    orders = testbed.order_heads(spark, sf)
    items = testbed.kept_items(spark, sf).withColumn("quantity", F.col("amount").cast("bigint"))
    return live.items_sold(items, orders, live.latest(orders), MONTH)


@query
def live_revenue(spark: SparkSession, sf: str) -> DataFrame:
    orders = testbed.purchases(spark, sf)
    return rounded(live.revenue(orders, live.latest(orders), WEEK), 2)


@query
def live_orders_per_bin(spark: SparkSession, sf: str) -> DataFrame:
    return _binned(spark, sf, live.orders_per_bin)


@query
def live_aov(spark: SparkSession, sf: str) -> DataFrame:
    return _binned(spark, sf, live.aov_per_bin)


@query
def live_promo_usage(spark: SparkSession, sf: str) -> DataFrame:
    return _binned(spark, sf, live.promo_usage)


@query
def live_combo_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _binned(spark, sf, live.combo_rate)


@query
def combo_sets(spark: SparkSession, sf: str) -> DataFrame:
    sets = live.combo_sets(testbed.live_combo_items(spark, sf))
    return sets.select("combination_id", F.array_join("products", ",").alias("products"))


@query
def combo_array_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs from the product arrays of the combinations."""
    return array_pairs(live.combo_sets(testbed.live_combo_items(spark, sf)), "products", "combination_id")


def _sold(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, Column]:
    orders = stored(testbed.live_combinations(spark, sf), "combinations")
    return testbed.combo_items_of(orders), orders, live.latest(orders)


@query
def sold_pairs_top20(spark: SparkSession, sf: str) -> DataFrame:
    items, orders, now = _sold(spark, sf)
    return live.top_sold_pairs(items, orders, now, MONTH).drop("pair_key")


@query
def sold_pair_top1(spark: SparkSession, sf: str) -> DataFrame:
    items, orders, now = _sold(spark, sf)
    return live.top_sold_pairs(items, orders, now, MONTH, n=1)


@query
def pair_top3_distinct(spark: SparkSession, sf: str) -> DataFrame:
    items, orders, now = _sold(spark, sf)
    return live.top_pairs(items, orders, now, MONTH)


@query
def pair_cumulative_series(spark: SparkSession, sf: str) -> DataFrame:
    items, orders, now = _sold(spark, sf)
    return readable(live.pair_series(orders, items, now, MONTH, DAY), "event_time")


@query
def pair_distinct_estimates(spark: SparkSession, sf: str) -> DataFrame:
    """Estimated distinct combinations of the top pairs over the last 30 days, merged from daily sketches."""
    items, orders, now = _sold(spark, sf)
    pairs = stored(live.top_sold_pairs(items, orders, now, MONTH), "pairs")
    start = now - interval(MONTH)
    sketches = stored(live.pair_sketches(orders, items, pairs, start, DAY), "sketches")
    return window_estimates(sketches, ["pair_key"], "event_time", start, now + interval(DAY), "combinations")


@query
def pair_running_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The running totals of the top pairs as a stream keeps them, for the bins that its watermark has passed."""
    items, orders, now = _sold(spark, sf)
    recent = stored(last(orders, "event_time", now, MONTH).select("combination_id", "event_time"), "recent")
    pairs = stored(live.top_pairs(items, orders, now, MONTH), "pairs")
    holding = stored(live.holding(live.combo_products(items), pairs), "holding")
    folder = scratch_dir(spark, "totals")
    recent.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(recent.schema).parquet(f"{folder}/in")
    figures = totals.pair_totals(stream, holding, now - interval(MONTH), datetime.timedelta(days=1), "0 seconds")
    before = spark.conf.get(totals.STATE_STORE[0])
    spark.conf.set(*totals.STATE_STORE)
    try:
        sink = figures.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        _finish([sink.start(f"{folder}/out")])
    finally:
        spark.conf.set(totals.STATE_STORE[0], before)
    return readable(spark.read.schema(figures.schema).parquet(f"{folder}/out"), "event_time")


@query
def retention_prune(spark: SparkSession, sf: str) -> DataFrame:
    orders = testbed.purchases(spark, sf)
    return rounded(readable(prune(orders, "event_time", live.latest(orders)), "event_time"), 2)


# --- the whole job --------------------------------------------------------------------------------------------------


_JOBS: dict[tuple[str, str], str] = {}


def _job(spark: SparkSession, sf: str) -> str:
    """Bronze, silver and gold in fresh namespaces of the warehouse, once in a session for each folder of tables; returns
    the namespace of the reporting views."""
    key = (spark.sparkContext.applicationId, sf)
    if key in _JOBS and spark.catalog.databaseExists(_JOBS[key]):
        return _JOBS[key]
    run = f"job_{uuid.uuid4().hex[:12]}"
    tables = {
        "products": testbed.products(spark, sf), "product_categories": testbed.product_categories(spark, sf),
        "product_inventory": testbed.product_inventory(spark, sf), "orders": testbed.orders(spark, sf),
        "order_items": testbed.order_lines(spark, sf),
    }
    options = Options(
        min_pair_cnt=MIN_PAIRS, refreshed_at=F.lit(REFRESHED).cast("timestamp"), item_order=testbed.ITEM_ORDER
    )
    full_load(spark, f"{run}_bronze", f"{run}_silver", f"{run}_gold", tables, options, f"{run}_model")
    _JOBS[key] = f"{run}_model"
    return _JOBS[key]


@query
def job_gold_affinity_topk(spark: SparkSession, sf: str) -> DataFrame:
    named = read_table(spark, _job(spark, sf), "product_affinity_topk_named")
    return rounded(readable(named, "refreshed_at"))


@query
def job_sales_top_products(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(read_table(spark, _job(spark, sf), "sales_top_products_by_category"), 2)


@query
def job_model_views(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each reporting view."""
    views = _job(spark, sf)
    counts = [
        read_table(spark, views, name).agg(F.lit(name).alias("view"), F.count(F.lit(1)).alias("n_rows"))
        for name in REPORT_SILVER + REPORT_GOLD + AFFINITY_GOLD
    ]
    return reduce(DataFrame.unionByName, counts)


# --- streams --------------------------------------------------------------------------------------------------------


def _finish(queries: list) -> None:
    for running in queries:
        running.awaitTermination()


def _publish(messages: DataFrame, folder: str) -> None:
    """Compressed text files; what was shuffled to make the messages goes when they are written."""
    with freed(messages.sparkSession):
        messages.select("value").write.text(folder, compression="lz4")


def _landed(spark: SparkSession, published: DataFrame, kind: str, name: str, arrival: Column | None = None) -> DataFrame:
    folder = scratch_dir(spark, kind)
    _publish(published, f"{folder}/in")
    start = ingest.ingest_sales if kind == "sales" else ingest.ingest_combinations
    _finish(start(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", arrival, by_day=False))
    extra = ["batch_id", "event_time"] if name.endswith("items") else ["batch_id"]
    return spark.read.parquet(f"{folder}/out/{name}").drop(*extra)


def _sales_messages(spark: SparkSession, sf: str) -> DataFrame:
    return events.to_events(testbed.sale_events(spark, sf), "order_id")


@query
def stream_sales(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_landed(spark, _sales_messages(spark, sf), "sales", "order_items"), 2)


@query
def stream_sales_orders(spark: SparkSession, sf: str) -> DataFrame:
    landed = _landed(spark, _sales_messages(spark, sf), "sales", "orders")
    flat = landed.withColumn("items", F.array_join(F.transform("items", lambda i: i["product_id"]), ","))
    return rounded(readable(flat, "event_time"), 2)


def _combination_messages(spark: SparkSession, sf: str) -> DataFrame:
    return events.to_events(testbed.combination_events(spark, sf), "combination_id")


@query
def stream_combinations(spark: SparkSession, sf: str) -> DataFrame:
    landed = _landed(spark, _combination_messages(spark, sf), "combinations", "combinations")
    return readable(landed.withColumn("items", F.size("items")), "event_time")


@query
def stream_combination_items(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_landed(spark, _combination_messages(spark, sf), "combinations", "combination_items"), 2)


@query
def stream_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Both envelope shapes and lines that are no JSON in one stream."""
    sales = testbed.sale_events(spark, sf)
    web = ~F.col("is_community_created")
    shop_items = F.transform(
        "items", lambda i: F.struct(i["product_id"].alias("product_id"), i["name"].alias("name"),
                                    i["price"].alias("price"), i["color"].alias("color")))
    from_shop = F.to_json(F.struct("order_id", "combination_id", F.col("user").alias("user_id"), shop_items.alias("items")))
    broken = F.concat(F.lit("{broken "), "order_id")
    sent = F.when(web, F.array(from_shop, broken)).when(~web, F.array(F.to_json(F.struct(*sales.columns))))
    lines = sales.select(F.explode(sent).alias("value"))
    landed = _landed(spark, lines, "sales", "orders", F.lit(REFRESHED).cast("timestamp"))
    shown = landed.withColumn("n_items", F.coalesce(F.size("items"), F.lit(0)))
    columns = ["event_type", "event_time", "order_id", "combination_id", "user", "promo_code", "total_price", "n_items"]
    return rounded(readable(shown.select(*columns), "event_time"), 2)


def _mixed_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The sale messages, each of a web order with five bad ones beside it: in one pass, so that all files hold some of them."""
    sales = testbed.sale_events(spark, sf)
    web = ~F.col("is_community_created")
    bad = [
        F.concat(F.lit('{"order_id": "'), "order_id"),
        F.to_json(F.struct(F.col("order_id").alias("x"))),
        F.to_json(F.struct("order_id", F.lit("not a time").alias("event_time"))),
        F.to_json(F.struct("order_id", F.lit("abc").alias("total_price"))),
        F.to_json(F.struct("order_id", F.array(F.struct("user", F.lit("many").alias("quantity"))).alias("items"))),
    ]
    message = F.to_json(F.struct(*sales.columns))
    return sales.select(F.explode(F.when(web, F.array(message, *bad)).otherwise(F.array(message))).alias("value"))


@query
def stream_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Landed and rejected messages of a stream in which every web order comes with five messages that are none or hold what does not fit."""
    folder = scratch_dir(spark, "rejects")
    _publish(_mixed_messages(spark, sf), f"{folder}/in")
    _finish(ingest.ingest_sales(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", by_day=False))
    landed = spark.read.parquet(f"{folder}/out/orders").groupBy(F.lit("landed").alias("reason"))
    rejects = spark.read.parquet(f"{folder}/out/orders_rejects").groupBy("reason")
    return landed.agg(F.count(F.lit(1)).alias("messages")).unionByName(rejects.agg(F.count(F.lit(1)).alias("messages")))


@query
def stream_retained(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of the kept days and their landed items: landed batch by batch, folded and retained on the way."""
    folder = scratch_dir(spark, "retained")
    share = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 6)  # a sixth of the files, which are read by a task each
    _publish(_sales_messages(spark, sf).repartition(6 * share, "key"), f"{folder}/in")
    source = {"path": f"{folder}/in", "maxFilesPerTrigger": str(2 * share)}
    _finish(ingest.ingest_sales(spark, source, f"{folder}/out", f"{folder}/checkpoint", by_day=False, maintain_every=2, keep=MONTH))
    store = ingest.sales_store(spark, f"{folder}/out", by_day=False)
    store.maintain(MONTH)
    items = store.read("order_items").groupBy("order_id").agg(F.sum("quantity").alias("units"))
    orders = store.read("orders").join(items, "order_id", "left").withColumn("units", F.coalesce("units", F.lit(0)))
    return rounded(readable(orders.select("order_id", "event_time", "total_price", "units"), "event_time"), 2)


def _purchase_stream(spark: SparkSession, sf: str, **options) -> tuple[DataFrame, str]:
    """The purchases as a stream of files in the scratch folder."""
    folder = scratch_dir(spark, "purchases")
    testbed.purchases(spark, sf).write.parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    return spark.readStream.schema(schema).options(**options).parquet(f"{folder}/in"), folder


@query
def stream_kpis_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    orders, folder = _purchase_stream(spark, sf)
    figures = windows.tumbling_kpis(orders, HOUR)
    _finish([windows.start_latest(figures, f"{folder}/out", f"{folder}/checkpoint")])
    return rounded(readable(windows.read_latest(spark, f"{folder}/out", ["event_time"]), "event_time"))


@query
def stream_kpis_folded(spark: SparkSession, sf: str) -> DataFrame:
    """The same figures from a stream that folds what it has written into days."""
    orders, folder = _purchase_stream(spark, sf, maxFilesPerTrigger=1)
    figures = windows.tumbling_kpis(orders, HOUR, "400 days")
    _finish([windows.start_latest(figures, f"{folder}/out", f"{folder}/checkpoint", maintain_every=2)])
    return rounded(readable(windows.read_latest(spark, f"{folder}/out", ["event_time"]), "event_time"))


def _cards(spark: SparkSession, orders: DataFrame, folder: str, length: str, slide: str) -> DataFrame:
    """Trailing windows from the newest state of the panes of a stream."""
    _finish([windows.start_latest(windows.panes(orders, slide, slide), f"{folder}/out", f"{folder}/checkpoint")])
    newest = windows.read_latest(spark, f"{folder}/out", ["pane_start"])
    return rounded(readable(windows.sliding_cards(newest, length, slide), "window_start", "window_end"), 2)


@query
def stream_kpis_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """All trailing windows of 6 hours, the open ones included."""
    orders, folder = _purchase_stream(spark, sf)
    return _cards(spark, orders, folder, "6 hours", HOUR)


@query
def stream_cards_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Units, revenue and orders of all trailing 30 days from the stream of sale messages, the open ones included."""
    folder = scratch_dir(spark, "cards")
    _publish(_sales_messages(spark, sf), f"{folder}/in")
    orders = ingest.landed_orders(events.read_events(spark, f"{folder}/in", schemas.SALE_EVENT))
    return _cards(spark, orders, folder, MONTH, DAY)

from __future__ import annotations

import datetime as dt

import pytest

from shelfline.plans import kpis, silver
from tests.shop import Shop


@pytest.fixture(scope="module")
def shop(spark):
    return Shop(spark)


def test_dedup_keeps_the_smallest_line(shop):
    kept = {(r.order_id, r.product_id): r.amount for r in shop.kept_items.collect()}
    assert kept[("O20240101-00001", "P1")] == 1 and len(kept) == 8


def test_dim_product_fans_out_over_categories(shop, rows):
    got = rows(silver.dim_product(shop.products, shop.cats).select("product_id", "category", "is_active", "effective_ts"))
    assert ("P3", "", True, None) in got and ("P3", "tshirts", True, None) in got and len(got) == 5


def test_dim_store_keeps_unknown_places_without_region(shop, rows):
    assert rows(shop.stores) == [
        ("Cologne", "NRW", "offline"), ("Hamburg", "Hamburg", "offline"), ("Munich", "Bavaria", "offline"),
        ("Online", "Online", "online"), ("Paris", None, "offline"),
    ]


def test_dim_date_skips_bad_order_ids(shop, rows):
    got = rows(shop.model.dim_date)
    assert got[0] == (dt.date(2024, 1, 1), 20240101, 2024, 1, 1, 1, "Mon")
    assert [r[0] for r in got] == [dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 12, 24)]


def test_summary_keeps_orders_without_lines(shop):
    got = {r.order_id: r for r in shop.summary.collect()}
    assert len(got) == 7
    first = got["O20240101-00001"]
    assert (first.basket_size, first.basket_qty, first.basket_value) == (2, 2.0, 150.0)
    empty = got["O20241224-00006"]
    assert (empty.basket_size, empty.basket_qty, empty.basket_value) == (None, None, None)
    assert got["X-1"].order_date is None and got["O20241399-00005"].order_date is None


def test_support_tables(shop, rows):
    baskets = silver.distinct_baskets(shop.items)
    assert rows(silver.product_counts(baskets)) == [("P1", 3), ("P2", 3), ("P4", 2)]
    total = silver.total_baskets(baskets)
    assert rows(total) == [(5,)] and total.schema["n"].dataType.simpleString() == "bigint"


def test_aov(shop, rows):
    # baskets: 150, 250, 50, 80, 260; orders without lines do not count
    assert rows(kpis.aov_overall(shop.summary)) == [(158.0,)]
    by_place = {(r.region, r.channel): (r.orders, r.revenue, r.aov) for r in kpis.aov_by_region_channel(shop.summary, shop.stores).collect()}
    assert by_place[("Online", "online")] == (2, 510.0, 255.0)
    assert by_place[(None, "offline")] == (1, 50.0, 50.0)
    assert by_place[(None, None)] == (1, None, None)
    assert by_place[("Hamburg", "offline")] == (1, None, None)
    by_brand = {r.brand: r.aov_brand for r in kpis.aov_by_brand(shop.sales).collect()}
    assert by_brand == {"BOSS": (100 + 100 + 80 + 260) / 4, "HUGO": (50 + 150 + 50) / 3}


def test_top_products_break_ties_by_id(spark, shop, rows):
    sold = kpis.product_sales(shop.sales, shop.dims)
    got = [r for r in rows(kpis.top_products(sold, 1)) if r[2] == "jackets"]
    assert got == [("P1", "Red Jacket", "jackets", "BOSS", 3.0, 300.0, 1)]
    tied = spark.createDataFrame([(p, "same", "c", "b", 1.0, 5.0) for p in ("P9", "P8", "P7")], sold.schema)
    assert [r.product_id for r in kpis.top_products(tied, 2).orderBy("rank_in_category").collect()] == ["P7", "P8"]


def test_regional_split_adds_up(shop):
    got = kpis.regional_split(shop.sales, shop.summary, shop.stores).collect()
    assert sum(r.revenue for r in got) == sum(r.line_value for r in shop.sales.collect())
    by_key = {(r.region, r.channel, r.brand): (r.orders, r.qty, r.revenue) for r in got}
    assert by_key[("Online", "online", "BOSS")] == (2, 4.0, 360.0)
    assert by_key[(None, "offline", "HUGO")] == (1, 1.0, 50.0)


def test_regional_split_counts_no_order_for_lines_of_unknown_orders(shop):
    got = kpis.regional_split(shop.sales, shop.summary.limit(0), shop.stores).collect()
    assert {r.orders for r in got} == {0} and {r.region for r in got} == {None}


def test_promo_shares(shop, rows):
    assert rows(kpis.promo_share_orders(shop.summary)) == [(2 / 7,)]
    # users U1, U2, U3, U4 and the missing one; U1 and the missing one had a promotion
    assert rows(kpis.promo_share_users(shop.summary)) == [(2 / 5,)]
    assert rows(kpis.promo_share_by_channel(shop.summary, shop.stores)) == [
        (None, 0, 1, 0.0), ("offline", 2, 4, 0.5), ("online", 0, 2, 0.0),
    ]
    assert rows(kpis.promo_share_orders(shop.summary.limit(0))) == [(None,)]


def test_sales_item_keeps_lines_of_unknown_products_and_their_category(spark, shop):
    from shelfline import schemas

    items = spark.createDataFrame([("o", "P1", 2, None), ("o", "P8", 1, None), ("o", "P9", 1, None)], schemas.ORDER_ITEMS)
    cats = spark.createDataFrame([("P8", "hats"), ("P1", "jackets"), ("P1", "sale")], schemas.PRODUCT_CATEGORIES)
    got = sorted((r.product_id, r.line_value, r.category or "", r.brand) for r in silver.fact_sales_item(items, shop.products, cats).collect())
    assert got == [("P1", 200.0, "jackets", "BOSS"), ("P1", 200.0, "sale", "BOSS"), ("P8", None, "hats", None), ("P9", None, "", None)]


def test_baskets_without_repeated_products_need_no_sum_per_product(spark, shop, rows):
    assert not silver.one_category(shop.cats) and silver.one_category(shop.one_category)
    sales = spark.createDataFrame(shop.sales.collect(), shop.sales.schema)  # as a table, without the shuffle that made it
    totals, summed = silver.basket_totals(sales, single=True), silver.basket_totals(sales)
    plans = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(order_id") for df in (totals, summed)]
    assert plans[0] == plans[1] - 1 and rows(totals) == rows(summed)
    assert rows(silver.fact_basket_summary(shop.orders, totals=totals)) == rows(silver.fact_basket_summary(shop.orders, shop.sales))


def test_figures_per_brand_share_the_brands_of_the_orders(shop, rows):
    held = kpis.brands_of_orders(shop.sales)
    assert rows(kpis.aov_by_brand(shop.sales, held)) == rows(kpis.aov_by_brand(shop.sales))
    split = kpis.regional_split(shop.sales, shop.summary, shop.stores, held)
    assert rows(split) == rows(kpis.regional_split(shop.sales, shop.summary, shop.stores))

from __future__ import annotations

import datetime as dt

import pytest

from shelfline.plans import report, semantic
from tests.shop import Shop


@pytest.fixture(scope="module")
def shop(spark):
    return Shop(spark)


def test_totals_count_orders_without_lines(shop):
    chosen = [semantic.revenue(), semantic.units_sold(), semantic.orders(), semantic.aov(), semantic.promo_orders(), semantic.promo_users()]
    got = semantic.evaluate(shop.model, [], chosen).first()
    assert (got.revenue, got.units_sold, got.orders) == (790.0, 11.0, 7)
    assert got.aov == pytest.approx(790 / 7) and got.promo_orders == pytest.approx(2 / 7)
    # users U1 to U4 and the one without a name; U1 and that one had a promotion
    assert got.promo_users == pytest.approx(2 / 5)


def test_users_without_a_name_count_as_one(shop):
    got = {r.channel: (r.promo_users, r.orders) for r in semantic.evaluate(shop.model, ["channel"], [semantic.promo_users(), semantic.orders()]).collect()}
    assert got["offline"] == (pytest.approx(2 / 4), 4) and got["online"] == (0.0, 2)
    plan = semantic.evaluate(shop.model, [], [semantic.promo_users()])._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_by_shared_attribute_matches_missing_values(shop):
    got = {r.region: (r.revenue, r.orders) for r in semantic.evaluate(shop.model, ["region"], [semantic.revenue(), semantic.orders()]).collect()}
    assert got == {"NRW": (150.0, 1), "Online": (510.0, 2), "Bavaria": (80.0, 1), "Hamburg": (None, 1), None: (50.0, 2)}


def test_product_attributes_do_not_split_basket_figures(shop):
    got = semantic.evaluate(shop.model, ["channel", "brand"], [semantic.revenue(), semantic.orders(), semantic.aov()])
    by_key = {(r.channel, r.brand): (r.revenue, r.orders) for r in got.collect()}
    assert by_key[("online", "BOSS")] == (360.0, 2) and by_key[("online", "HUGO")] == (150.0, 2)
    only_brand = {r.brand: (r.revenue, r.orders) for r in semantic.evaluate(shop.model, ["brand"], [semantic.revenue(), semantic.orders()]).collect()}
    assert only_brand == {"BOSS": (540.0, 7), "HUGO": (250.0, 7)}


def test_filters(shop):
    def total(**filters):
        return tuple(semantic.evaluate(shop.model, [], [semantic.revenue(), semantic.orders()], filters).first())

    assert total(channel=["online"]) == (510.0, 2)
    assert total(brand=["HUGO"]) == (250.0, 7)
    assert total(brand=[]) == (790.0, 7)
    assert total(year=[2024], promo_flag=[True]) == (230.0, 2)


def test_basket_measures_alone_ignore_product_attributes(shop):
    got = semantic.evaluate(shop.model, ["channel", "category"], [semantic.orders()])
    assert got.columns == ["channel", "orders"] and got.count() == 3


def test_star_view_joins_only_what_is_asked_for(shop):
    assert "region" not in semantic.star_view(shop.model, ["brand"]).columns
    full = semantic.star_view(shop.model)
    assert {"region", "category", "year", "user_id"} <= set(full.columns) and full.count() == 8


def test_dates_with_baskets(spark, shop, rows):
    more = shop.model.dim_date.unionByName(shop.model.dim_date.limit(1).selectExpr("date_add(date, 99) AS date", "date_key", "year", "quarter", "month", "day", "day_of_week"))
    assert report.dates_with_baskets(more, shop.summary).count() == 3


def test_report(shop, rows):
    by_date = rows(report.revenue_by_date_category(shop.model))
    assert by_date == [
        (dt.date(2024, 1, 1), "jackets", 200.0), (dt.date(2024, 1, 1), "shoes", 200.0),
        (dt.date(2024, 1, 2), "jackets", 80.0), (dt.date(2024, 1, 2), "shoes", 50.0),
    ]
    units = [tuple(r) for r in report.units_by_date_brand_category(shop.model).collect()]
    assert units[0] == (dt.date(2024, 1, 1), "HUGO", "shoes", 4.0)
    assert [tuple(r) for r in report.revenue_by_brand(shop.model).collect()] == [("BOSS", 540.0), ("HUGO", 250.0)]
    assert rows(report.revenue_by_brand(shop.model, categories=["shoes"])) == [("HUGO", 250.0)]
    assert rows(report.units_total(shop.model)) == [(11.0,)]
    assert rows(report.units_total(shop.model, brands=["BOSS"], categories=["jackets"])) == [(6.0,)]


def test_report_leaves_out_rows_without_category(shop):
    from dataclasses import replace

    from shelfline.plans.silver import dim_product

    model = replace(shop.model, dim_product=dim_product(shop.products, shop.cats.where("category IN ('', 'shoes')")))
    assert [r.brand for r in report.revenue_by_brand(model).collect()] == ["HUGO"]


def test_dashboard(shop):
    sets = report.sales_dashboard(shop.model)
    assert tuple(sets["totals"].first()) == (790.0, 7)
    assert {r.category: r.revenue for r in sets["revenue_by_category"].collect()} == {"jackets": 540.0, "shoes": 250.0}
    assert {r.date: r.aov for r in sets["aov_by_date"].collect()}[dt.date(2024, 12, 24)] is None


def test_dashboard_in_one_pass_equals_its_data_sets(shop):
    got = {}
    for r in report.dashboard(shop.model).collect():
        got.setdefault(r.visual, set()).add(tuple(r[1:]))
    sets = report.sales_dashboard(shop.model)
    total = sets["totals"].first()
    assert got["totals"] == {(None, None, None, None, None, total.revenue, total.orders, total.revenue / total.orders)}
    assert {(r[0], r[7]) for r in got["aov_by_date"]} == {(r.date, r.aov) for r in sets["aov_by_date"].collect()}
    assert {(r[1], r[2], r[5]) for r in got["revenue_by_region_channel"]} == {tuple(r) for r in sets["revenue_by_region_channel"].collect()}
    assert {(r[3], r[5]) for r in got["revenue_by_brand"]} == {tuple(r) for r in sets["revenue_by_brand"].collect()}
    assert {(r[4], r[5]) for r in got["revenue_by_category"]} == {tuple(r) for r in sets["revenue_by_category"].collect()}


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_stores_and_dates_meet_sums_not_lines(spark, shop):
    """Below each join with stores or dates the rows are summed to those keys."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chosen = [semantic.revenue(), semantic.units_sold(), semantic.orders()]
        figures = semantic.evaluate(shop.model, ["year", "channel", "category"], chosen)
        logical = figures._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [line.lstrip(" :+-|") for line in logical.splitlines()]
    depth = [len(line) - len(line.lstrip(" :+-|")) for line in logical.splitlines()]
    for at, line in enumerate(lines):
        if line.startswith("Join LeftOuter") and ("(order_date" in line or "(store_id" in line):
            left = next(i for i in range(at + 1, len(lines)) if depth[i] > depth[at])
            below = [lines[i] for i in range(left, len(lines)) if depth[i] >= depth[left]][:4]
            assert any(x.startswith(("Aggregate", "Join LeftOuter")) for x in below), below
    assert sum(x.startswith("Join LeftOuter") for x in lines) >= 5


def test_grain_keeps_figures(shop, rows):
    from pyspark.sql import functions as F

    star = semantic.star_view(shop.model)
    for by in (["year", "channel", "category"], ["date", "brand"], ["store_id", "category"], ["promo_flag", "region", "brand"], ["channel", "user_id"]):
        plain = star.groupBy(*by).agg(F.sum("line_value").alias("revenue"), F.sum("qty").alias("units_sold"))
        got = semantic.evaluate(shop.model, by, [semantic.revenue(), semantic.units_sold()])
        assert rows(got) == rows(plain)

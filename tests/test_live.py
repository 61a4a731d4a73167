from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfline.plans import live

DAY = "2024-05-01 "
ORDERS = [
    # id, time, combination, code, total
    ("a", "08:59:59", "c9", "P", 1000.0),
    ("b", "09:00:00", "c1", None, 10.0),
    ("c", "09:00:30", "c1", "P", 20.0),
    ("d", "09:30:00", "c2", "", 30.0),
    ("e", "09:30:59", None, None, 40.0),
    ("f", "10:00:00", "c3", "P", 50.0),
    ("g", "10:00:01", "c9", "P", 2000.0),
]
ITEMS = [("a", 9), ("b", 1), ("b", 2), ("d", 4), ("f", 1), ("g", 9)]
COMBO_ITEMS = [
    ("c1", "p2"), ("c1", "p1"), ("c1", "p1"), ("c1", "p3"), ("c2", "p1"), ("c2", "p2"), ("c3", "p3"), ("c3", "p1"),
    ("c3", ""), ("c9", "p1"), ("c9", "p8"), ("c3", None),
]


@pytest.fixture(scope="module")
def orders(spark):
    df = spark.createDataFrame(ORDERS, "order_id string, t string, combination_id string, promo_code string, total_price double")
    return df.withColumn("event_time", F.concat(F.lit(DAY), "t").cast("timestamp")).drop("t")


@pytest.fixture(scope="module")
def combo_items(spark):
    return spark.createDataFrame(COMBO_ITEMS, "combination_id string, product_id string")


def now():
    return F.lit(DAY + "10:00:00").cast("timestamp")


def clock(df, *columns):
    return [tuple(r) for r in df.select(F.date_format("event_time", "HH:mm").alias("t"), *columns).orderBy("t").collect()]


def test_cards(spark, orders):
    items = spark.createDataFrame(ITEMS, "order_id string, quantity long")
    assert live.items_sold(items, orders, now()).first()["items_sold"] == 8
    # the revenue card has no upper end
    assert live.revenue(orders, now()).first()["revenue"] == 2150.0
    later = F.lit("2030-01-01").cast("timestamp")
    assert live.items_sold(items, orders, later).first()["items_sold"] == 0
    assert live.revenue(orders, later).first()["revenue"] == 0.0


def test_series(orders):
    assert clock(live.orders_per_bin(orders, now()), "orders") == [("09:00", 2), ("09:30", 2), ("10:00", 1)]
    assert clock(live.aov_per_bin(orders, now()), "aov") == [("09:00", 15.0), ("09:30", 35.0), ("10:00", 50.0)]
    assert clock(live.promo_usage(orders, now()), "promo_usage_pct") == [("09:00", 50.0), ("09:30", 0.0), ("10:00", 100.0)]
    assert clock(live.combo_rate(orders, now()), "total_orders", "combo_orders", "combo_order_pct") == [
        ("09:00", 2, 2, 100.0), ("09:30", 2, 1, 50.0), ("10:00", 1, 1, 100.0)]


def test_as_of_may_be_a_subquery(orders):
    latest = orders.agg(F.max("event_time")).scalar()
    assert [r[0] for r in clock(live.orders_per_bin(orders, latest, "10 seconds"), "orders")] == ["10:00"]


def test_sold_pairs(orders, combo_items):
    top = live.top_sold_pairs(combo_items, orders, now())
    assert [tuple(r) for r in top.collect()] == [
        ("p1 × p2", "p1", "p2", 2), ("p1 × p3", "p1", "p3", 2), ("p2 × p3", "p2", "p3", 1)]
    assert live.top_sold_pairs(combo_items, orders, now(), n=1).first()["pair_key"] == "p1 × p2"


def test_combo_sets(combo_items):
    got = {r.combination_id: r.products for r in live.combo_sets(combo_items).collect()}
    assert got["c1"] == ["p1", "p2", "p3"] and got["c3"] == ["p1", "p3"]


def test_pair_series_is_dense_and_cumulative(orders, combo_items):
    series = live.pair_series(orders, combo_items, now(), "1 hour", "30 minutes", n=2)
    got = sorted((r.pair_key, r.t, r.cum) for r in series.select("pair_key", F.date_format("event_time", "HH:mm").alias("t"), "cum").collect())
    # the sale at the very end of the window is in no bin; a combination sold twice in a bin counts once
    assert got == [("p1 × p2", "09:00", 1), ("p1 × p2", "09:30", 2), ("p1 × p3", "09:00", 1), ("p1 × p3", "09:30", 1)]

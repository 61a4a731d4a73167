from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelfline import schemas
from shelfline.plans import affinity as aff
from shelfline.plans import lookups
from tests.shop import Shop

def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


@pytest.fixture(scope="module")
def shop(spark):
    return Shop(spark)


@pytest.fixture(scope="module")
def baskets(spark):
    rng = random.Random(5)
    data = [(f"o{n}", f"p{rng.randint(0, 14):02d}") for n in range(120) for _ in range(rng.randint(1, 5))]
    return spark.createDataFrame(data, "order_id string, product_id string").cache()


def by_pair(df):
    return {(r.lhs_item_id, r.rhs_item_id): r for r in df.collect()}


def test_affinity_by_hand(shop):
    got = by_pair(aff.affinity(shop.items, 1, now()))
    assert set(got) == {("P1", "P2"), ("P2", "P1"), ("P1", "P4"), ("P4", "P1")}
    r = got[("P1", "P4")]
    assert (r.pair_cnt, r.lhs_cnt, r.rhs_cnt) == (1, 3, 2)
    assert r.support_lhs == pytest.approx(3 / 5) and r.support_pair == pytest.approx(1 / 5)
    assert r.confidence_lhs_to_rhs == pytest.approx(1 / 3)
    assert r.lift == pytest.approx((1 / 3) / (2 / 5))
    assert aff.affinity(shop.items, 1, now()).schema.simpleString() == aff.empty_affinity(
        shop.items.sparkSession).schema.simpleString()


def test_affinity_properties(baskets):
    got = by_pair(aff.affinity(baskets, 2, now()))
    assert got
    for (a, b), r in got.items():
        other = got[(b, a)]
        assert r.pair_cnt == other.pair_cnt >= 2 and r.lift == other.lift
        assert r.confidence_lhs_to_rhs <= 1
        assert r.support_pair <= min(r.support_lhs, r.support_rhs)


def test_affinity_does_not_depend_on_the_block_size(baskets, rows):
    assert rows(aff.affinity(baskets, 3, now())) == rows(aff.affinity(baskets, 3, now(), bulky=2))


def test_no_pairs_and_no_baskets(spark, rows):
    single = spark.createDataFrame([("o1", "p1"), ("o2", "p1"), ("o3", "p2")], "order_id string, product_id string")
    assert aff.affinity(single, 1).count() == 0
    assert aff.affinity(single.limit(0)).count() == 0
    named = aff.named_topk(aff.topk(aff.affinity(single.limit(0))), spark.createDataFrame([], "product_id string, product_name string"))
    assert named.schema.simpleString() == aff.empty_named_topk(spark).schema.simpleString() and named.count() == 0


def test_filters(shop):
    def orders(**kwargs):
        return {r.order_id for r in aff.filter_baskets(shop.items, shop.summary, **kwargs).collect()}

    everything = {"O20240101-00001", "O20240101-00002", "O20240102-00003", "O20240102-00004", "X-1"}
    assert orders() == orders(store_ids=[]) == everything
    assert orders(start="2024-01-02") == {"O20240102-00003", "O20240102-00004"}
    assert orders(end="2024-01-01") == {"O20240101-00001", "O20240101-00002"}
    assert orders(start="2024-01-01", end="2024-01-02") == everything - {"X-1"}
    assert orders(store_ids=["Online", "Paris"]) == {"O20240101-00002", "O20240102-00003", "X-1"}
    assert orders(promo_context="promo_only") == {"O20240101-00001", "O20240102-00004"}
    assert orders(promo_context="non_promo_only") == {"O20240101-00002", "O20240102-00003", "X-1"}
    assert orders(store_ids=["Nowhere"]) == set()
    with pytest.raises(ValueError):
        orders(promo_context="sometimes")


def test_topk_ties_at_the_border(spark):
    rows = [("a", r, 5, 1, 1, 0.1, 0.1, 0.1, 0.5, 2.0, None) for r in ("z", "y", "x", "w")]
    table = spark.createDataFrame(rows, schemas.AFFINITY_DDL)
    assert sorted(r.rhs_item_id for r in aff.topk(table, 2).collect()) == ["w", "x"]


def test_recommend_falls_back_per_product(spark):
    ready = spark.createDataFrame(
        [("a", "A", "b", "B", 6, 0.1, 0.5, 2.0, None)], schemas.AFFINITY_NAMED_DDL)
    full = spark.createDataFrame(
        [(lhs, rhs, n, 9, 9, 0.1, 0.1, 0.1, 0.5, lift, None)
         for lhs, rhs, n, lift in [("a", "c", 9, 9.0), ("d", "b", 7, 1.0), ("d", "c", 7, 3.0), ("d", "a", 4, 8.0)]],
        schemas.AFFINITY_DDL)
    names = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "product_id string, product_name string")
    anchors = spark.createDataFrame([("a",), ("d",), ("e",)], "lhs_item_id string")
    got = [(r.lhs_item_id, r.rhs_item_id, r.rhs_name) for r in lookups.recommend(ready, full, names, anchors).collect()]
    assert got == [("a", "b", "B"), ("d", "c", "C"), ("d", "b", "B")]


def test_resolve_product(shop, rows):
    got = [tuple(r) for r in lookups.resolve_product(shop.products, "RED jack").collect()]
    assert got == [("P1", "Red Jacket"), ("P4", "Red Jacket")]
    assert lookups.resolve_product(shop.products, "e", limit=2).count() == 2
    assert lookups.resolve_product(shop.products, "nothing").count() == 0


def test_stock(shop, rows):
    assert rows(lookups.stock(shop.products, shop.inventory, "red JACKET")) == [("P1", 7), ("P4", 0)]
    assert rows(lookups.stock(shop.products, shop.inventory, product_id="P1", location="Munich")) == [("P1", 5)]
    sized = [tuple(r) for r in lookups.stock_by_size(shop.products, shop.inventory, "Red Jacket").collect()]
    assert sized == [("P1", "S", 4), ("P1", "XL", 3)]
    assert [r.size for r in lookups.stock_by_size(shop.products, shop.inventory, product_id="P2").collect()] == ["39", "46"]
    by_material = lookups.stock_by_material(shop.products, shop.cats, shop.inventory, "jackets", "polyester")
    assert [tuple(r) for r in by_material.collect()] == [("S", 4), ("XL", 3)]
    with pytest.raises(ValueError):
        lookups.stock(shop.products, shop.inventory)


def test_attributes_and_orders_in_month(shop, rows):
    assert rows(lookups.attributes(shop.products, "blue shoe")) == [("P2", "Blue Shoe", "blue", "Leather")]
    assert rows(lookups.attributes(shop.products, product_id="P3", columns=("base_price",))) == [("P3", "Green Shirt", 20.0)]
    assert rows(lookups.orders_in_month(shop.summary, 1, 1)) == [(2,)]
    assert rows(lookups.orders_in_month(shop.summary, 12, 0)) == [(0,)]
    assert rows(lookups.orders_in_month(shop.summary, 1, 0, year=2023)) == [(0,)]

from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from shelfline.functions import dates, ids, money, text


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_one"))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "order_id, day",
    [
        ("O20240131-00042", dt.date(2024, 1, 31)),
        ("O20241399-00001", None),
        ("X-1", None),
        ("O2024013-00001", None),
        ("", None),
    ],
)
def test_order_date(spark, order_id, day):
    assert one(spark, dates.order_date("o"), o=order_id) == day


def test_date_key(spark):
    assert one(spark, dates.date_key("d"), d=dt.date(2024, 3, 9)) == 20240309


def test_event_time_reads_offsets_and_rejects_noise(spark):
    def read(value):
        return one(spark, F.date_format(dates.event_time("t"), "yyyy-MM-dd HH:mm:ss"), t=value)

    assert read("2024-05-01T10:00:00+00:00") == "2024-05-01 10:00:00"
    assert read("2024-05-01T10:00:00.123456+02:00") == "2024-05-01 08:00:00"
    assert read("yesterday") is None


def test_time_bin(spark):
    shown = F.date_format(dates.time_bin(F.col("t").cast("timestamp"), "15 minutes"), "HH:mm:ss")
    assert one(spark, shown, t="2024-05-01 10:29:59") == "10:15:00"


def test_trailing_includes_both_ends(spark):
    now = F.lit("2024-05-01 10:00:00").cast("timestamp")
    df = spark.createDataFrame([("09:00:00",), ("08:59:59",), ("10:00:00",), ("10:00:01",)], "t string")
    df = df.select("t", F.concat(F.lit("2024-05-01 "), "t").cast("timestamp").alias("ts"))
    inside = {r.t for r in df.where(dates.trailing("ts", now, "1 hour")).collect()}
    assert inside == {"09:00:00", "10:00:00"}
    open_end = {r.t for r in df.where(dates.trailing("ts", now, "1 hour", upper=False)).collect()}
    assert open_end == {"09:00:00", "10:00:00", "10:00:01"}


def test_ids(spark):
    assert one(spark, ids.product_id("n"), n=7) == "P0007"
    assert one(spark, ids.product_id("n"), n=123456) == "P123456"
    assert one(spark, ids.order_id("d", "n"), d=dt.date(2024, 2, 3), n=12) == "O20240203-00012"


def test_combination_id_is_the_digest_of_the_sorted_ids(spark):
    digest = hashlib.sha256(b"a-1|b-2|c-3").hexdigest()
    want = "-".join([digest[:8], digest[8:12], digest[12:16], digest[16:20], digest[20:32]])
    df = spark.createDataFrame([(["c-3", "a-1", "b-2"],), (["a-1", "b-2", "c-3"],)], "i array<string>")
    assert {r.x for r in df.select(ids.combination_id("i").alias("x")).collect()} == {want}


@pytest.mark.parametrize(
    "price, original, pct",
    [(129.0, 249.0, 48), (87.5, 100.0, 12), (88.5, 100.0, 12), (100.0, 100.0, None), (10.0, None, None), (10.0, 5.0, None)],
)
def test_discount_pct(spark, price, original, pct):
    df = spark.createDataFrame([(price, original)], "p double, o double")
    assert df.select(money.discount_pct("p", "o").alias("x")).first()["x"] == pct


@pytest.mark.parametrize(
    "subtotal, code, discount, total",
    [
        (99.99, "WELCOME10", 10.0, 89.99),
        (49.99, "BUNDLE5", 0.0, 49.99),
        (50.0, "BUNDLE5", 5.0, 45.0),
        (3.0, "BUNDLE5", 0.0, 3.0),
        (20.0, "FREESHIP", 0.0, 20.0),
        (20.0, None, 0.0, 20.0),
        (20.0, "OTHER", 0.0, 20.0),
        (None, "WELCOME10", None, None),
    ],
)
def test_price_order(spark, subtotal, code, discount, total):
    df = spark.createDataFrame([(subtotal, code)], "s double, c string")
    priced = money.price_order("s", "c")
    got = df.select(priced.discount.alias("d"), priced.total.alias("t")).first()
    assert (got.d, got.t) == (discount, total)


def test_subtotal(spark):
    df = spark.createDataFrame(
        [([(1.25, 2), (3.0, 1)],), ([],), (None,), ([(None, 2), (1.0, 1)],)],
        "items array<struct<price double, quantity long>>",
    )
    assert [r.x for r in df.select(money.subtotal("items").alias("x")).collect()] == [5.5, 0.0, 0.0, 1.0]


def test_ratios(spark):
    assert one(spark, money.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, money.ratio_or_zero(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, money.ratio(F.lit(1), F.lit(4))) == 0.25


def test_not_empty(spark):
    df = spark.createDataFrame([(None,), ("",), ("x",)], "c string")
    assert [r.x for r in df.select(text.not_empty("c").alias("x")).collect()] == [False, False, True]


def test_brand_from_title(spark):
    df = spark.createDataFrame([("Hemd von Boss",), ("HUGO Jeans",), ("hugo by boss",), ("Plain",), (None,)], "t string")
    got = [r.x for r in df.select(text.brand_from_title("t").alias("x")).collect()]
    assert got[:3] == ["BOSS", "HUGO", "BOSS"]
    assert set(got[3:]) <= {"BOSS", "HUGO"}
    assert got == [r.x for r in df.select(text.brand_from_title("t").alias("x")).collect()]


def test_brand_split_is_close_to_the_share(spark):
    titles = spark.range(5000).select(F.concat(F.lit("title "), "id").alias("t"))
    first = titles.where(text.brand_from_title("t") == "BOSS").count()
    assert 0.57 < first / 5000 < 0.63


def test_size_order(spark):
    sizes = ["XXXL", "30/32", "XS", "46", "L", "39", "31/34", "odd", "31/32", "M", "S", None]
    df = spark.createDataFrame([(s,) for s in sizes], "size string")
    got = [r.size for r in df.orderBy(text.size_sort_key("size")).collect()]
    assert got == ["30/32", "31/32", "31/34", "39", "46", "XS", "S", "M", "L", "XXXL", None, "odd"]


def test_pair_key_and_stringify(spark):
    assert one(spark, text.pair_key(F.lit("a"), F.lit("b"))) == "a × b"
    assert one(spark, text.stringify(F.struct(F.lit(1).alias("n")), nested=True)) == '{"n":1}'
    assert one(spark, text.stringify(F.lit(5))) == "5"

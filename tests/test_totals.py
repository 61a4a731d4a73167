"""Running totals that a stream keeps, against the batch figure."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from shelfline.plans import live
from shelfline.streaming import totals

START = datetime.datetime(2024, 5, 1, 10)
ITEMS = [("c1", "p1"), ("c1", "p2"), ("c2", "p1"), ("c2", "p2"), ("c2", "p3"), ("c3", "p2"), ("c3", "p3"), ("c4", "p9")]


@pytest.fixture()
def keyed_state(spark):
    before = spark.conf.get(totals.STATE_STORE[0])
    spark.conf.set(*totals.STATE_STORE)
    yield
    spark.conf.set(totals.STATE_STORE[0], before)


def put(spark, base, rows):
    df = spark.createDataFrame([(f"o{m}{c}", START + datetime.timedelta(minutes=m), c) for m, c in rows], "order_id string, event_time timestamp, combination_id string")
    df.coalesce(1).write.mode("append").parquet(f"{base}/in")


def run(spark, base, holding):
    stream = spark.readStream.schema("order_id string, event_time timestamp, combination_id string").option("maxFilesPerTrigger", "1").parquet(f"{base}/in")
    figures = totals.pair_totals(stream, holding, F.lit(str(START)).cast("timestamp"), datetime.timedelta(minutes=10), "5 minutes")
    query = figures.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out")
    query.awaitTermination()
    got = spark.read.schema(figures.schema).parquet(f"{base}/out")
    return sorted((r.pair_key, r.t, r.cum) for r in got.select("pair_key", F.date_format("event_time", "HH:mm").alias("t"), "cum").collect())


def test_equal_to_the_batch_figure_also_after_a_restart(spark, tmp_path, keyed_state):
    base = str(tmp_path)
    items = spark.createDataFrame(ITEMS, "combination_id string, product_id string")
    first = [(1, "c1"), (2, "c1"), (3, "c2"), (12, "c1"), (14, "c4"), (15, None)]
    put(spark, base, first)
    pairs = spark.createDataFrame([("p1 × p2", "p1", "p2"), ("p2 × p3", "p2", "p3")], "pair_key string, product_a string, product_b string")
    holding = live.holding(live.combo_products(items), pairs)
    run(spark, base, holding)
    second = [(13, "c2"), (41, "c3"), (55, "c1"), (56, "c2")]  # the third and fourth bin are empty for one pair
    put(spark, base, second)
    run(spark, base, holding)
    put(spark, base, [(76, "c2"), (4, "c3")])  # one that comes too late
    got = run(spark, base, holding)
    orders = spark.createDataFrame(
        [(START + datetime.timedelta(minutes=m), c) for m, c in first + second], "event_time timestamp, combination_id string")
    now = F.lit(str(START + datetime.timedelta(minutes=60))).cast("timestamp")
    batch = live.pair_series(orders, items, now, "1 hour", "10 minutes", n=2)
    want = sorted((r.pair_key, r.t, r.cum) for r in batch.select("pair_key", F.date_format("event_time", "HH:mm").alias("t"), "cum").collect())
    # the watermark stands at 71 minutes: seven bins are over, the batch window holds six of them
    assert [x for x in got if x[1] < "11:00"] == want and len(want) == 12
    assert [x for x in got if x[1] >= "11:00"] == [("p1 × p2", "11:00", want[5][2]), ("p2 × p3", "11:00", want[11][2])]

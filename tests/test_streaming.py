from __future__ import annotations

import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from shelfline import schemas
from shelfline.operators.retention import prune
from shelfline.plans import live
from shelfline.sources.events import parse_events, read_events
from shelfline.streaming import ingest, windows
from shelfline.workload import queries


def put(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines), encoding="utf-8")


def sale(order, minute, n_items=1, **more):
    return {
        "event_type": "sale", "event_time": f"2024-05-01T10:{minute:02d}:00+00:00", "order_id": order, "combination_id": "c1",
        "user": "u1", "is_community_created": True, "promo_code": None, "discount": 1.5, "total_price": 10.0,
        "items": [{"product_id": f"p{i}", "name": "n", "color": "red", "size": "M", "quantity": 1, "price": 10.0} for i in range(n_items)],
        **more,
    }


def finish(queries):
    for query in queries:
        query.awaitTermination()


def test_sales_land_once_also_after_a_restart(spark, tmp_path, rows):
    source, out, checkpoint = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    web = {"order_id": "w1", "combination_id": "c2", "user_id": "shopper", "items": [{"product_id": "p7", "name": "n", "price": 3.0, "color": "blue"}]}
    put(source, "1.json", [sale("a", 1, 2), web, "{broken", sale("b", 2, 0), sale("n", 3, items=None)])
    arrival_time = datetime.datetime(2024, 6, 1)
    arrival = F.lit("2024-06-01 00:00:00").cast("timestamp")
    finish(ingest.ingest_sales(spark, str(source), out, checkpoint, arrival))
    put(source, "2.json", [sale("c", 4, 1)])
    for _ in range(2):
        finish(ingest.ingest_sales(spark, str(source), out, checkpoint, arrival))
    orders = spark.read.parquet(f"{out}/orders")
    got = {r.order_id: (r.user, r.event_type, r.t, str(r.event_date)) for r in orders.withColumn("t", F.date_format("event_time", "MM-dd HH:mm")).collect()}
    assert orders.count() == 5
    assert got["a"] == ("u1", "sale", "05-01 10:01", "2024-05-01")
    assert got["w1"] == ("shopper", "sale", "06-01 00:00", "2024-06-01")
    items = spark.read.parquet(f"{out}/order_items")
    assert items.columns == [
        "product_id", "color", "size", "quantity", "price", "order_id", "item_index", "event_time", "event_date", "batch_id",
    ]
    rejects = spark.read.parquet(f"{out}/orders_rejects")
    assert rows(rejects.select("value", "reason", "arrived")) == [("{broken", "no JSON", arrival_time)]
    assert rows(items.select("order_id", "item_index", "product_id")) == [("a", 0, "p0"), ("a", 1, "p1"), ("c", 0, "p0"), ("w1", 0, "p7")]


def test_combinations_land_in_tables(spark, tmp_path, rows):
    event = {
        "event_type": "combination_created", "event_time": "2024-05-01T10:00:00+00:00", "combination_id": "c1", "user": "u1",
        "is_community_created": False,
        "items": [{"product_id": "p1", "name": "n", "brand": "b", "category": "k", "price": 1.0, "original_price": 2.0, "color": "red",
                   "size": "M", "image_url": "x"}],
    }
    put(tmp_path / "in", "1.json", [event])
    spark.sql("CREATE DATABASE IF NOT EXISTS live_t")
    finish(ingest.ingest_combinations(spark, str(tmp_path / "in"), "live_t", f"{tmp_path}/checkpoint", by_day=False))
    combos = spark.table("live_t.combinations")
    assert combos.columns == ["event_type", "event_time", "combination_id", "user_id", "community_created", "items", "batch_id"]
    assert combos.first()["community_created"] is False
    assert rows(spark.table("live_t.combination_items").drop("event_time", "batch_id")) == [("p1", "n", "b", "k", 1.0, "red", "M", "c1", 0)]


def test_stream_equals_batch(spark, tmp_path, rows):
    lines = [sale(f"o{n}", n % 50, n % 4) for n in range(60)]
    put(tmp_path / "in", "1.json", lines[:30])
    put(tmp_path / "in", "2.json", lines[30:])
    source = {"path": str(tmp_path / "in"), "maxFilesPerTrigger": "1"}
    finish(ingest.ingest_sales(spark, source, f"{tmp_path}/out", f"{tmp_path}/checkpoint"))
    batch = ingest.landed_order_items(parse_events(spark.read.text(str(tmp_path / "in")), schemas.SALE_EVENT))
    assert rows(spark.read.parquet(f"{tmp_path}/out/order_items").select(*batch.columns)) == rows(batch)


ORDER_SCHEMA = "order_id string, event_time timestamp, promo_code string, combination_id string, total_price double"


def put_orders(spark, folder, batch, minutes):
    rows = [(f"{batch}-{i}", f"2024-05-01 {m // 60 + 10:02d}:{m % 60:02d}:30", "P" if m % 2 else None, "c" if m % 3 else "", float(m)) for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "order_id string, t string, promo_code string, combination_id string, total_price double")
    df.select("order_id", F.col("t").cast("timestamp").alias("event_time"), "promo_code", "combination_id", "total_price").coalesce(1).write.mode(
        "append").parquet(folder)


def run_tumbling(spark, base, watermark):
    stream = spark.readStream.schema(ORDER_SCHEMA).option("maxFilesPerTrigger", "1").parquet(f"{base}/in")
    finish([windows.start_latest(windows.tumbling_kpis(stream, "1 minute", watermark), f"{base}/out", f"{base}/checkpoint")])
    return windows.read_latest(spark, f"{base}/out", ["event_time"])


def test_tumbling_equals_batch_and_drops_what_is_later_than_the_watermark(spark, tmp_path):
    base = str(tmp_path)
    put_orders(spark, f"{base}/in", 1, [0, 0, 1, 5])
    put_orders(spark, f"{base}/in", 2, [40, 41, 41])
    run_tumbling(spark, base, "10 minutes")
    time.sleep(1)
    put_orders(spark, f"{base}/in", 3, [35, 2])  # one late within the watermark, one beyond it
    put_orders(spark, f"{base}/in", 4, [50])
    got = run_tumbling(spark, base, "10 minutes")
    kept = spark.read.schema(ORDER_SCHEMA).parquet(f"{base}/in").where("total_price <> 2.0")
    now = F.lit("2024-05-02").cast("timestamp")

    def values(df, *names):
        return sorted(tuple(r) for r in df.select(F.date_format("event_time", "HH:mm").alias("t"), *names).collect())

    assert values(got, "orders") == values(live.orders_per_bin(kept, now, "30 days"), "orders")
    assert values(got, "aov") == values(live.aov_per_bin(kept, now, "30 days"), "aov")
    assert values(got, "promo_usage_pct") == values(live.promo_usage(kept, now, "30 days"), "promo_usage_pct")
    assert values(got, "combo_orders", "combo_order_pct") == values(live.combo_rate(kept, now, "30 days"), "combo_orders", "combo_order_pct")


def run_cards(spark, base, orders, length):
    finish([windows.start_latest(windows.panes(orders, "1 minute", "1 minute"), f"{base}/out", f"{base}/checkpoint")])
    cards = windows.sliding_cards(windows.read_latest(spark, f"{base}/out", ["pane_start"]), length, "1 minute")
    return cards.withColumn("w", F.date_format("window_end", "HH:mm")).collect()


def test_sliding_windows_hold_the_trailing_sums_up_to_now(spark, tmp_path):
    base = str(tmp_path)
    put_orders(spark, f"{base}/in", 1, [0, 1, 61, 62, 200])
    stream = spark.readStream.schema(ORDER_SCHEMA).parquet(f"{base}/in")
    got = {r.w: (r.orders, r.revenue) for r in run_cards(spark, base, stream, "1 hour")}
    assert got["10:01"] == (1, 0.0) and got["10:02"] == (2, 1.0) and got["11:00"] == (2, 1.0)
    assert got["11:01"] == (1, 1.0) and got["11:03"] == (2, 123.0) and got["12:02"] == (1, 62.0)
    assert got["13:21"] == (1, 200.0) and got["14:20"] == (1, 200.0)  # the windows that are still open
    put_orders(spark, f"{base}/in", 2, [200])
    got = {r.w: (r.orders, r.revenue) for r in run_cards(spark, base, stream, "1 hour")}
    assert got["13:21"] == (2, 400.0) and got["11:03"] == (2, 123.0)


def test_a_kafka_source_takes_its_options(spark):
    with pytest.raises(Exception) as error:

        read_events(spark, {"kafka.bootstrap.servers": "broker:9092", "subscribe": "sales"}, schemas.SALE_EVENT)
    assert "kafka" in str(error.value).lower()


def test_retention_skips_whole_days(spark, tmp_path):
    put(tmp_path / "in", "1.json", [sale("a", 1), sale("b", 2, event_time="2024-04-20T10:00:00+00:00"), sale("c", 3, event_time="2024-04-30T10:02:00+00:00")])
    finish(ingest.ingest_sales(spark, str(tmp_path / "in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint"))
    orders = spark.read.parquet(f"{tmp_path}/out/orders")
    kept = prune(orders, "event_time", F.lit("2024-05-01 10:03:00").cast("timestamp"), day="event_date")
    assert {r.order_id for r in kept.collect()} == {"a"}
    assert "PartitionFilters: [isnotnull(event_date" in kept._jdf.queryExecution().executedPlan().toString()


def test_sliding_windows_sum_units_where_orders_carry_items(spark, tmp_path):
    put(tmp_path / "in", "1.json", [sale("a", 1, 2), sale("b", 3, 1), sale("c", 4, items=None), sale("z", 59)])
    orders = ingest.landed_orders(read_events(spark, str(tmp_path / "in"), schemas.SALE_EVENT))
    got = {r.w: (r.orders, r.items_sold) for r in run_cards(spark, tmp_path, orders, "3 minutes")}
    early = {"10:02": (1, 2), "10:03": (1, 2), "10:04": (2, 3), "10:05": (2, 1), "10:06": (2, 1), "10:07": (1, 0)}
    assert got == early | {"11:00": (1, 1), "11:01": (1, 1), "11:02": (1, 1)}


def test_nothing_is_lost_and_no_time_is_made_up(spark, tmp_path):
    lines = [sale("good", 1), "{broken", '{"x": 1}', sale("odd", 2, event_time="not a time"), sale("none", 3, event_time=None), ""]
    put(tmp_path / "in", "1.json", lines)
    arrival = F.lit("2024-06-01 00:00:00").cast("timestamp")
    queries = ingest.ingest_sales(spark, str(tmp_path / "in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint", arrival)
    finish(queries)
    assert len(queries) == 1  # the source is read once
    orders = spark.read.parquet(f"{tmp_path}/out/orders").select("order_id", F.date_format("event_time", "MM-dd").alias("day"))
    assert {tuple(r) for r in orders.collect()} == {("good", "05-01"), ("none", "06-01")}
    rejects = {r.reason: r.n for r in spark.read.parquet(f"{tmp_path}/out/orders_rejects").groupBy("reason").agg(F.count("*").alias("n")).collect()}
    assert rejects == {"no JSON": 1 + (spark.read.text(str(tmp_path / "in")).count() - 5), "no known field": 1, "unreadable time": 1}
    assert sum(rejects.values()) + orders.count() == spark.read.text(str(tmp_path / "in")).count()


def test_bad_messages_come_from_one_pass(spark):
    lines = queries._mixed_messages(spark, "/root/testdata/sf0.001")
    assert "Union" not in lines._jdf.queryExecution().optimizedPlan().toString()
    bad = lines.where("NOT value LIKE '{\"event_type\"%'").count()
    assert bad > 0 and bad % 5 == 0


def test_a_batch_is_judged_once_into_files_and_not_kept_in_memory(spark, tmp_path, rows, monkeypatch):
    kept, judged = [], []
    for name in ("persist", "cache"):
        monkeypatch.setattr(type(spark.range(1)), name, lambda df, *level: kept.append(df) or df)
    once = ingest.judge_messages
    monkeypatch.setattr(ingest, "judge_messages", lambda *a: judged.append(a) or once(*a))
    put(tmp_path / "in", "1.json", [sale("a", 1, 2), "{broken", sale("b", 2, total_price="abc"), sale("c", 3, items=None)])
    finish(ingest.ingest_sales(spark, str(tmp_path / "in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint"))
    assert not kept and len(judged) == 1
    assert list((tmp_path / "checkpoint" / "judged").iterdir()) == []
    assert rows(spark.read.parquet(f"{tmp_path}/out/orders").select("order_id")) == [("a",), ("c",)]
    assert rows(spark.read.parquet(f"{tmp_path}/out/order_items").select("order_id", "product_id")) == [("a", "p0"), ("a", "p1")]
    rejects = spark.read.parquet(f"{tmp_path}/out/orders_rejects").where("reason <> 'no JSON'")
    assert [json.loads(r.value)["order_id"] for r in rejects.collect()] == ["b"]


def test_messages_are_published_compressed_and_free_their_shuffles(spark, tmp_path, monkeypatch):
    name, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    writer = type(spark.range(1).write)
    text = writer.text
    monkeypatch.setattr(writer, "text", lambda w, *a, **b: seen.append(w._spark.conf.get(name)) or text(w, *a, **b))
    before = spark.conf.get(name)
    queries._publish(queries._mixed_messages(spark, "/root/testdata/sf0.001"), f"{tmp_path}/in")
    assert seen == ["true"] and spark.conf.get(name) == before
    files = [f.name for f in (tmp_path / "in").glob("part-*")]
    assert files and all(f.endswith(".lz4") for f in files)

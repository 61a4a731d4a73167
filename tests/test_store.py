"""Batches that appear as a whole, folding, retention and removal of files."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from shelfline.streaming import ingest
from shelfline.streaming.store import BATCH, DAY, Landed, Store
from shelfline.streaming.windows import figures_store

from .test_streaming import finish, put, sale


def day(n, hour=10):
    return datetime.datetime(2024, 5, n, hour)


def orders(spark, rows):
    return spark.createDataFrame([(i, t, float(n)) for i, t, n in rows], "order_id string, event_time timestamp, total_price double")


def lines(spark, rows):
    return spark.createDataFrame(rows, "order_id string, event_time timestamp, line int")


def two(spark, target, **options):
    return Store(spark, target, "pair", [Landed("heads"), Landed("lines")], **options)


def shown(store, name="heads", column="order_id"):
    return sorted(r[0] for r in store.read(name).select(column).collect())


def files(store, name):
    """Files that a reader opens."""
    state = store.state()
    opened = store._rows(name, store._columns(state, name)).where((F.col(BATCH) > state.mark) & (F.col(BATCH) <= state.last))
    both = [opened, *(store._folded(state, name, days) for days in [state.days.get(name)] if days)]
    return sum(df.select(F.input_file_name().alias("f")).distinct().count() for df in both)


@pytest.mark.parametrize("place", ["folder", "namespace"])
@pytest.mark.parametrize("by_day", [True, False])
def test_fold_retain_and_vacuum(spark, tmp_path, place, by_day):
    target = str(tmp_path / "out") if place == "folder" else f"store_{by_day}".lower()
    if place == "namespace":
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {target}")
    store = two(spark, target, by_day=by_day)

    def land(batch, rows):
        store.write(batch, {"heads": orders(spark, rows), "lines": lines(spark, [(i, t, 0) for i, t, _ in rows])})

    land(0, [("a", day(1), 1), ("b", day(2), 2)])
    land(1, [("c", day(2, 12), 3), ("d", day(4), 4)])
    before = sorted(map(tuple, store.read("heads").collect()))
    assert store.fold() and not store.fold()
    assert sorted(map(tuple, store.read("heads").collect())) == before and len(before) == 4
    land(2, [("late", day(1, 1), 5), ("e", day(5), 6)])
    assert shown(store) == shown(store, "lines") == ["a", "b", "c", "d", "e", "late"]
    assert store.fold() and shown(store) == shown(store, "lines") == ["a", "b", "c", "d", "e", "late"]
    kept = store.retain("2 days")
    assert kept == {"heads": day(3).date(), "lines": day(3).date()} == store.retain("2 days")
    assert shown(store) == shown(store, "lines") == ["d", "e"]
    land(3, [("old", day(2, 3), 7), ("kept day", day(3, 1), 8)])
    assert shown(store) == ["d", "e", "kept day"]  # late rows of a kept day stay, others do not come back
    assert store.vacuum(1) > 0
    left = [p for name in ("heads_days", "lines_days") for p in store._partitions(name)]
    assert {p[DAY] for p in left} == {"2024-05-04", "2024-05-05"}
    assert {int(p[BATCH]) for p in store._partitions("heads")} == {3}
    assert shown(store) == shown(store, "lines") == ["d", "e", "kept day"]
    store.maintain("2 days", 1)
    assert shown(store) == ["d", "e", "kept day"] and store.vacuum(1) == 0


def test_a_batch_shows_all_its_tables_or_none(spark, tmp_path, monkeypatch):
    store = two(spark, str(tmp_path / "out"))
    store.write(0, {"heads": orders(spark, [("a", day(1), 1)]), "lines": lines(spark, [("a", day(1), 0)])})
    put_rows = Store._put

    def fail(self, rows, name, by):
        if name == "lines":
            raise OSError("lost")
        put_rows(self, rows, name, by)

    batch = {"heads": orders(spark, [("b", day(1), 2)]), "lines": lines(spark, [("b", day(1), 0)])}
    with monkeypatch.context() as patch, pytest.raises(OSError):
        patch.setattr(Store, "_put", fail)
        store.write(1, batch)
    assert shown(store) == shown(store, "lines") == ["a"]
    for _ in range(2):  # again, and once more
        store.write(1, batch)
        assert shown(store) == shown(store, "lines") == ["a", "b"]
    store.fold()
    store.write(1, batch)  # a folded batch that is run again
    assert shown(store) == shown(store, "lines") == ["a", "b"]


def test_a_fold_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    store = two(spark, str(tmp_path / "out"))
    store.write(0, {"heads": orders(spark, [("a", day(1), 1)]), "lines": lines(spark, [("a", day(1), 0)])})
    with monkeypatch.context() as patch, pytest.raises(OSError):
        patch.setattr(Store, "_snapshot", lambda self, state: (_ for _ in ()).throw(OSError("lost")))
        store.fold()
    assert shown(store) == ["a"]
    store.write(1, {"heads": orders(spark, [("b", day(1), 1)]), "lines": lines(spark, [("b", day(1), 0)])})
    assert store.fold() and shown(store) == shown(store, "lines") == ["a", "b"]


def test_nothing_has_landed(spark, tmp_path):
    store = two(spark, str(tmp_path / "out"))
    with pytest.raises(LookupError):
        store.read("heads")
    assert not store.fold() and store.retain() == {} and store.vacuum() == 0


def test_rows_without_a_time_are_kept(spark, tmp_path):
    store = two(spark, str(tmp_path / "out"))
    store.write(0, {"heads": orders(spark, [("a", None, 1), ("b", day(1), 1), ("c", day(9), 1)]), "lines": lines(spark, [])})
    store.maintain("2 days", 1)
    assert shown(store) == ["a", "c"] and shown(store, "lines") == []


def test_five_hundred_batches_read_a_bounded_number_of_files(spark, tmp_path):
    """The newest row of each minute counts, whether its batch is folded or open."""
    path, n = str(tmp_path / "out"), 500
    store = figures_store(spark, path, ["event_time"])
    store.write(0, {"figures": spark.createDataFrame([(day(1), 0)], "event_time timestamp, orders int")})
    made = spark.range(1, n).select(
        (F.lit(day(1)) + F.make_interval(mins=F.floor(F.col("id") / 3).cast("int"))).alias("event_time"), F.col("id").cast("int").alias("orders"), F.col("id").alias(BATCH)
    )
    made.repartition(4, BATCH).write.mode("append").partitionBy(BATCH).parquet(f"{path}/figures")  # the other batches, in one job
    store._enter([("batch", "figures", None, None, i, None, store.state().columns["figures"], i) for i in range(1, n)])
    want = {day(1) + datetime.timedelta(minutes=m): min(3 * m + 2, n - 1) for m in range(n // 3 + 1)}

    def got():
        return {r.event_time: r.orders for r in store.read("figures").collect()}

    assert files(store, "figures") > 100
    store.maintain(None, 1)
    assert got() == want and files(store, "figures") <= 2
    assert len(store._partitions("figures")) == 0 and len(store._entries()) < 5
    store.write(n, {"figures": spark.createDataFrame([(day(1), 77), (day(2), 1)], "event_time timestamp, orders int")})
    assert got() == want | {day(1): 77, day(2): 1}


def test_ingest_maintains_what_it_lands(spark, tmp_path):
    for n in range(6):
        put(tmp_path / "in", f"{n}.json", [sale(f"o{n}", n, 2, event_time=f"2024-05-0{n + 1}T10:00:00+00:00"), "{broken"])
    source = {"path": str(tmp_path / "in"), "maxFilesPerTrigger": "1"}
    out = f"{tmp_path}/out"
    finish(ingest.ingest_sales(spark, source, out, f"{tmp_path}/checkpoint", maintain_every=2, keep="2 days"))
    store = ingest.sales_store(spark, out)
    assert shown(store, "orders") == ["o3", "o4", "o5"] and len(shown(store, "order_items")) == 6
    assert store.read("orders_rejects").count() == 6  # by their own clock, the time of arrival
    assert store.read("orders").columns == [*spark.read.parquet(f"{out}/orders_days").drop("event_date", "version").columns, DAY]


def test_maintenance_does_not_rewrite_days_that_it_drops(spark, tmp_path, monkeypatch):
    store = two(spark, str(tmp_path / "out"), by_day=False)
    written, put_rows = [], store._put

    def noted(rows, name, by):
        if name == "heads_days":
            written.append(sorted(r[0].day for r in rows.select(DAY).distinct().collect()))
        put_rows(rows, name, by)

    monkeypatch.setattr(store, "_put", noted)
    for batch, rows in enumerate([[("a", day(1), 1), ("b", day(9), 2)], [("c", day(2), 3), ("d", day(10), 4), ("n", None, 5)]]):
        store.write(batch, {"heads": orders(spark, rows), "lines": lines(spark, [(i, t, 0) for i, t, _ in rows])})
        store.maintain("2 days")
    assert written == [[9], [10, 31]]  # rows without a time stand in a day that is never dropped
    assert shown(store) == shown(store, "lines") == ["b", "d", "n"]

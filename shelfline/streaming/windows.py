"""Windowed live figures as streams.

The batch figures of `plans.live` define what is right; the streams give the same for events within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfline.functions.money import ratio_or_zero
from shelfline.functions.text import not_empty
from shelfline.streaming.store import DAY, Landed, Store


def tumbling_kpis(orders: DataFrame, step: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """Orders, revenue, order value, promotion share and combination share per bin."""
    total = F.count(F.lit(1))
    combos = F.count_if(not_empty("combination_id"))
    figures = (
        orders.withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", step).alias("bin"))
        .agg(
            total.alias("orders"),
            F.sum("total_price").alias("revenue"),
            ratio_or_zero(F.sum("total_price"), total).alias("aov"),
            ratio_or_zero(100.0 * F.count_if(not_empty("promo_code")), total).alias("promo_usage_pct"),
            combos.alias("combo_orders"),
            ratio_or_zero(100.0 * combos, total).alias("combo_order_pct"),
        )
    )
    return figures.select(F.col("bin.start").alias("event_time"), *figures.columns[1:])


def panes(orders: DataFrame, slide: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """Orders, revenue and, where the orders carry their items, units sold per slide.

    In update mode a pane is written again whenever it changes, also the one that is still open.
    """
    sums = {"revenue": F.col("total_price")}
    if "items" in orders.columns:
        sums["items_sold"] = F.aggregate(
            F.coalesce("items", F.array()), F.lit(0).cast("bigint"),
            lambda acc, item: acc + F.coalesce(item["quantity"], F.lit(0).cast("bigint")),
        )
    figures = (
        orders.select("event_time", *[column.alias(name) for name, column in sums.items()])
        .withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", slide).alias("pane"))
        .agg(F.count(F.lit(1)).alias("orders"), *[F.sum(name).alias(name) for name in sums])
    )
    return figures.select(F.col("pane.start").alias("pane_start"), *figures.columns[1:])


def sliding_cards(latest_panes: DataFrame, length: str = "1 hour", slide: str = "1 minute") -> DataFrame:
    """The figures of every trailing window, up to the one that ends with the newest pane and those after it.

    Reads the newest state of the panes (`read_latest`), so the window that is still open counts what has come so far.
    Only panes, not events, are copied into the windows that hold them.
    """
    figures = [c for c in latest_panes.columns if c != "pane_start"]
    windows = latest_panes.groupBy(F.window("pane_start", length, slide).alias("span")).agg(
        *[F.sum(name).alias(name) for name in figures]
    )
    return windows.select(F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), *figures)


def figures_store(spark: SparkSession, path: str, keys: list[str]) -> Store:
    """The rows of live figures below a folder: the newest of each key counts. The first key is their time."""
    return Store(spark, path, "figures", [Landed("figures", keys[0], tuple(keys))], by_day=False)


def start_latest(
    df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, keys: list[str] | None = None, maintain_every: int | None = None, keep: str | None = None
) -> StreamingQuery:
    """Write each batch's changed rows below `path`; a repeated batch replaces itself.

    Given its keys (by default the first column) and `maintain_every`, the stream folds what it has written into one
    partition per day after so many batches, and keeps the days of `keep`, or all.
    """
    store = figures_store(df.sparkSession, path, keys or df.columns[:1])

    def write(batch: DataFrame, batch_id: int) -> None:
        store.write(batch_id, {"figures": batch})
        if maintain_every and batch_id % maintain_every == maintain_every - 1:
            store.maintain(keep)

    return (
        df.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last written row of each key."""
    return figures_store(spark, path, keys).read("figures").drop(DAY)

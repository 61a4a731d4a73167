"""From event streams to landed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfline import schemas
from shelfline.functions.dates import event_time
from shelfline.functions.text import stringify
from shelfline.operators.nested import expand, manage_fields
from shelfline.sources.events import judge_messages, read_messages, rejected
from shelfline.streaming.store import Landed, Store

SALE, COMBINATION = "sale", "combination_created"


def normalise(envelope: DataFrame, event_type: str, arrival: Column | None = None) -> DataFrame:
    """Bring the envelopes of both producers to one shape.

    The web shop sends `user_id` for `user`, and neither type nor time: the type follows from the stream, and the
    time is then the time of arrival. A time that is present but unreadable stays NULL.
    """
    arrival = F.current_timestamp() if arrival is None else arrival
    named = envelope.withColumns(
        {
            "user": F.coalesce("user", "user_id"),
            "event_type": F.coalesce("event_type", F.lit(event_type)),
            "event_time": F.when(F.col("event_time").isNull(), arrival).otherwise(event_time("event_time")),
        }
    )
    return named.drop("user_id")


# Landed columns and the fields they come from
ORDER_ITEM_FIELDS = {
    "color": "item.color", "size": "item.size", "quantity": "item.quantity", "price": "item.price",
    "order_id": "order_id", "item_index": "item_index",
}
COMBINATION_FIELDS = {
    "event_type": "event_type", "event_time": "event_time", "combination_id": "combination_id",
    "user_id": "user", "community_created": "is_community_created", "items": "items",
}
COMBINATION_ITEM_FIELDS = {
    "product_id": "item.product_id", "name": "item.name", "brand": "item.brand", "category": "item.category",
    "price": "item.price", "color": "item.color", "size": "item.size", "combination_id": "combination_id",
    "ArrayIndex_items": "ArrayIndex_items",
}


def landed_orders(envelope: DataFrame, arrival: Column | None = None) -> DataFrame:
    return normalise(envelope, SALE, arrival)


def landed_order_items(envelope: DataFrame, *more: str) -> DataFrame:
    """One row per line; `more` columns of the envelope, such as its time, are carried along."""
    lines = expand(envelope.select("order_id", "items", *more), "items", "item_index")
    kept = lines.withColumn("item_product", stringify("item.product_id"))
    return manage_fields(kept, {"product_id": "item_product", **ORDER_ITEM_FIELDS, **{name: name for name in more}})


def landed_combinations(envelope: DataFrame, arrival: Column | None = None) -> DataFrame:
    return manage_fields(normalise(envelope, COMBINATION, arrival), COMBINATION_FIELDS)


def landed_combination_items(envelope: DataFrame, *more: str) -> DataFrame:
    lines = expand(envelope.select("combination_id", "items", *more), "items", "ArrayIndex_items")
    return manage_fields(lines, COMBINATION_ITEM_FIELDS | {name: name for name in more})


def start_ingest(
    df: DataFrame,
    target: str,
    checkpoint: str,
    *,
    fmt: str = "parquet",
    trigger: dict | None = None,
    partition_by: str | None = None,
) -> StreamingQuery:
    """Append a stream to a table, or to files when `target` is a path. Each row lands once, also after a restart
    from the checkpoint. Without a trigger the stream runs through what is there and ends."""
    writer = (
        df.writeStream.format(fmt)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
    )
    if partition_by:
        writer = writer.partitionBy(partition_by)
    return writer.start(target) if "/" in target else writer.toTable(target)


def sales_store(spark: SparkSession, target: str, **options) -> Store:
    """The tables of the sales stream below `target`: `orders`, `order_items` and `orders_rejects`."""
    return Store(spark, target, "sales", [Landed("orders"), Landed("order_items"), Landed("orders_rejects", "arrived", clock="arrival")], **options)


def combination_store(spark: SparkSession, target: str, **options) -> Store:
    """The tables of the combination stream: `combinations`, `combination_items` and `combinations_rejects`."""
    tables = [Landed("combinations"), Landed("combination_items"), Landed("combinations_rejects", "arrived", clock="arrival")]
    return Store(spark, target, "combinations", tables, **options)


def _written(judged: DataFrame, place: str) -> DataFrame:
    """Judged messages, written once and read again: of those that are taken the event alone, of the others the text."""
    taken = F.col("reason").isNull()
    halves = {"value": F.when(~taken, F.col("value")), "event": F.when(taken, F.col("event"))}
    judged.withColumns(halves).write.mode("overwrite").parquet(place)
    return judged.sparkSession.read.schema(judged.schema).parquet(place)


def _ingest(
    source: str | dict[str, str], store: Store, checkpoint: str, schema: T.StructType, kind: str,
    land: tuple[Callable, Callable], arrival: Column | None, trigger: dict | None = None, maintain_every: int | None = None, keep: str | None = None,
) -> list[StreamingQuery]:
    """One stream that reads and parses each message once and writes the events, their items and the rejects.

    The judged messages of a batch stand in files below its checkpoint until all three have landed, since a batch is as
    large as its files: kept in the executors' memory they would fill it, and go whole from one executor to another.
    """
    arrived = F.current_timestamp() if arrival is None else arrival
    events, items, rejects = store.tables

    def write(batch: DataFrame, number: int) -> None:
        place = f"{checkpoint.rstrip('/')}/judged/{number}"
        try:
            judged = _written(judge_messages(batch, schema).withColumn("arrived", arrived), place)
            taken = judged.where("reason IS NULL").select("event.*", "arrived")
            timed = normalise(taken, kind, F.col("arrived")).drop("arrived")
            store.write(number, {events: land[0](timed), items: land[1](timed), rejects: rejected(judged, F.col("arrived"))})
        finally:
            files, path = store.files(place)
            files.delete(path, True)
        if maintain_every and number % maintain_every == maintain_every - 1:
            store.maintain(keep)

    stream = read_messages(store.spark, source)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return [writer.trigger(**(trigger or {"availableNow": True})).start()]


def ingest_sales(
    spark: SparkSession, source: str | dict[str, str], target: str, checkpoint: str,
    arrival: Column | None = None, by_day: bool = True, fmt: str = "parquet", **options,
) -> list[StreamingQuery]:
    """Sales stream to `orders`, `order_items` and `orders_rejects` below `target`, a namespace or a folder.

    `by_day` lands orders and items in one partition per day of the event, which suits a live stream; a replay of years
    of history is better landed without. Every message ends in `orders` or in `orders_rejects`. `sales_store` reads the
    tables of whole batches and maintains them; with `maintain_every` the stream itself does that, after so many batches,
    and keeps the days of `keep`, or all.
    """
    land = (lambda timed: timed, lambda timed: landed_order_items(timed, "event_time"))
    store = sales_store(spark, target, by_day=by_day, fmt=fmt)
    return _ingest(source, store, checkpoint, schemas.SALE_EVENT, SALE, land, arrival, **options)


def ingest_combinations(
    spark: SparkSession, source: str | dict[str, str], target: str, checkpoint: str,
    arrival: Column | None = None, by_day: bool = True, fmt: str = "parquet", **options,
) -> list[StreamingQuery]:
    """Combination stream to `combinations`, `combination_items` and `combinations_rejects` below `target`, as above."""
    land = (
        lambda timed: manage_fields(timed, COMBINATION_FIELDS),
        lambda timed: landed_combination_items(timed, "event_time"),
    )
    store = combination_store(spark, target, by_day=by_day, fmt=fmt)
    return _ingest(source, store, checkpoint, schemas.COMBINATION_EVENT, COMBINATION, land, arrival, **options)

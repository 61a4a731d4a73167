"""Order and combination events as JSON messages: packing, publishing, reading."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions.dates import event_time


def pack_items(items: DataFrame, key: str, order: list[str], fields: dict[str, Column]) -> DataFrame:
    """One row per `key` with an `items` array of records, in the given order.

    An array becomes one message, and a message broker bounds the size of a message, so a group here is as small
    as an order that can be sent at all.
    """
    record = F.struct(*[column.alias(name) for name, column in fields.items()])
    place = F.struct(*order)
    packed = items.select(key, F.struct(place.alias("place"), record.alias("record")).alias("entry"))
    return packed.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list("entry")), lambda entry: entry["record"]).alias("items")
    )


def to_events(df: DataFrame, key_col: str) -> DataFrame:
    """Key and JSON value of each row, the shape a message broker's sink takes. Fields that are NULL are left out."""
    return df.select(F.col(key_col).alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def publish(events: DataFrame, target: str | dict[str, str]) -> None:
    """Send the messages to a Kafka topic, given the options of a Kafka sink, or append them to text files in a folder,
    one message per line."""
    if isinstance(target, dict):
        events.selectExpr("CAST(key AS STRING) AS key", "value").write.format("kafka").options(**target).save()
    else:
        events.select("value").write.mode("append").text(target)


UNFIT = " does not fit"


def _given(value: Column) -> Column:
    return value.isNotNull() & ~F.is_variant_null(value)


def _looker(read: Column, dtype: T.DataType, name: str) -> Callable[[Column, Column], Column]:
    """Of an element of an array and its place: the first field that was sent and not read."""

    def look(x: Column, i: Column) -> Column:
        whole = F.when(_given(x) & F.get(read, i).isNull(), F.lit(f"{name}[]"))
        return F.coalesce(whole, _lost(x, F.get(read, i), dtype, f"{name}[].")) if isinstance(dtype, T.StructType) else whole

    return look


def _lost(sent: Column, read: Column, dtype: T.StructType, path: str = "") -> Column:
    """The first field of a record that was sent, as a variant, and is NULL in what was read; NULL if there is none.

    Elements of arrays are looked into, so a price inside one item counts too.
    """

    found = []
    for f in dtype.fields:
        name, value, got = f"{path}{f.name}", F.try_variant_get(sent, f"$['{f.name}']", "variant"), read[f.name]
        found.append(F.when(_given(value) & got.isNull(), F.lit(name)))
        if isinstance(f.dataType, T.StructType):
            found.append(_lost(value, got, f.dataType, f"{name}."))
        elif isinstance(f.dataType, T.ArrayType):
            each, inner = F.try_variant_get(value, "$", "array<variant>"), f.dataType.elementType

            found.append(F.get(F.filter(F.transform(each, _looker(got, inner, name)), lambda x: x.isNotNull()), F.lit(0)))
    return F.coalesce(*found)


def judge_messages(raw: DataFrame, schema: T.StructType, column: str = "value", time: str = "event_time") -> DataFrame:
    """Each message as `value`, its parsed `event`, and in `reason` why it cannot be taken, NULL if it can.

    Not taken are text that is no JSON or of which no field is known, messages with a field that does not fit its type
    (the reason names it, as in `items[].price does not fit`), and those whose time is present but unreadable. Only
    messages that the parser marks as not wholly read are looked into field by field.
    """
    value, unread = F.col(column).cast("string"), "_unread"
    marked = T.StructType([*schema.fields, T.StructField(unread, T.StringType())])
    parsed = F.from_json("value", marked, {"columnNameOfCorruptRecord": unread})
    # rows of a generator: a filter on the reason would else be moved below the parser, and parse once for each field it reads
    once = F.array(F.struct(parsed.alias("event"), F.try_parse_json("value").alias("sent")))
    read = raw.select(value.alias("value")).select("value", F.inline(once))
    known = reduce(or_, [F.col(f"event.{name}").isNotNull() for name in schema.fieldNames()])
    lost = F.when(F.col(f"event.{unread}").isNotNull(), _lost(F.col("sent"), F.col("event"), schema))
    reasons = [F.when(F.col("sent").isNull(), "no JSON"), F.concat(lost, F.lit(UNFIT)), F.when(~known, "no known field")]
    if time in schema.fieldNames():
        given = F.col(f"event.{time}")
        reasons.append(F.when(given.isNotNull() & event_time(given).isNull(), "unreadable time"))
    return read.select("value", F.col("event").dropFields(unread).alias("event"), F.coalesce(*reasons).alias("reason"))


def parse_events(raw: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """The events of the messages that can be read, if only in part: a field that does not fit is NULL here.

    What lands takes no such message: there `rejected` has it, with the field.
    """
    return judge_messages(raw, schema, column).where(F.coalesce(F.col("reason").endswith(UNFIT), F.lit(True))).select("event.*")


def rejected(judged: DataFrame, arrival: Column) -> DataFrame:
    """The messages of `judge_messages` that cannot be taken, as text, with the reason and the time of arrival."""
    return judged.where("reason IS NOT NULL").select("value", "reason", arrival.alias("arrived"))


def read_messages(spark: SparkSession, source: str | dict[str, str]) -> DataFrame:
    """A stream of messages as they come, in `value`.

    `source` is a folder of text files with one message per line, or source options: with a `path` those of such a
    folder (`maxFilesPerTrigger`, ...), else those of a Kafka source (`kafka.bootstrap.servers`, `subscribe`,
    `maxOffsetsPerTrigger`, ...). Unless they say otherwise a batch takes a bounded part of a backlog.
    """
    options = source if isinstance(source, dict) else {"path": source}
    fmt = "text" if "path" in options else "kafka"
    options = ({"maxFilesPerTrigger": "1000"} if fmt == "text" else {"maxOffsetsPerTrigger": "5000000"}) | options
    return spark.readStream.format(fmt).options(**options).load()


def read_events(spark: SparkSession, source: str | dict[str, str], schema: T.StructType) -> DataFrame:
    """A stream of the events of those messages that can be taken."""
    return parse_events(read_messages(spark, source), schema)

"""Dates, times and time windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfline.functions.columns import ColumnLike, as_column

# fixed value: an order id starts with its day, as in O20240131-00042
ORDER_ID_DAY = r"^O\d{8}-"


def order_date(order_id: ColumnLike) -> Column:
    """The day inside an order id; NULL when the id has none or the digits are no date."""
    text = as_column(order_id)
    parts = [F.substring(text, 2, 4), F.substring(text, 6, 2), F.substring(text, 8, 2)]
    return F.when(text.rlike(ORDER_ID_DAY), F.concat_ws("-", *parts).try_cast("date"))


def date_key(day: ColumnLike) -> Column:
    """A date as the number yyyymmdd."""
    day = as_column(day)
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def event_time(text: ColumnLike) -> Column:
    """ISO-8601 text, with or without an offset, as a timestamp; NULL when it is none."""
    return F.try_to_timestamp(as_column(text))


def time_bin(ts: ColumnLike, step: str = "1 minute") -> Column:
    """Start of the bin of length `step` that holds `ts`; bins are aligned to the epoch."""
    return F.window(as_column(ts), step)["start"]


def interval(length: str) -> Column:
    """`'1 hour'`, `'7 days'` and the like as an interval."""
    return F.expr(f"INTERVAL '{length}'")


def trailing(ts: ColumnLike, as_of: Column, length: str, *, upper: bool = True) -> Column:
    """True from `as_of - length` up to `as_of`, both included; without `upper` the later end is open."""
    ts = as_column(ts)
    inside = ts >= as_of - interval(length)
    return inside & (ts <= as_of) if upper else inside

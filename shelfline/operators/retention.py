"""Retention and trailing windows on a table with a time column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from shelfline.functions.columns import ColumnLike, as_column
from shelfline.functions.dates import interval, trailing


def prune(df: DataFrame, ts: ColumnLike, as_of: Column, keep: str = "1 day", day: str | None = None) -> DataFrame:
    """Rows not older than `keep` before `as_of`.

    `day` names the column a table is partitioned by; whole days before the bound are then not even listed.
    """
    oldest = as_of - interval(keep)
    kept = df.where(as_column(ts) >= oldest)
    return kept.where(as_column(day) >= oldest.cast("date")) if day else kept


def last(df: DataFrame, ts: ColumnLike, as_of: Column, length: str = "1 hour", *, upper: bool = True) -> DataFrame:
    """Rows of the trailing window up to `as_of`."""
    return df.where(trailing(ts, as_of, length, upper=upper))

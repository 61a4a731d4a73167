"""Deduplication by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup(df: DataFrame, keys: list[str], order: list[str | Column] | None = None) -> DataFrame:
    """Keep the first row per key in `order`, by default the order of all other columns.

    The order should be total, so that reruns and retried tasks keep the same row. Spark limits each key to one row
    on the map side before it shuffles, so a key that holds much of the table does not load a single task.
    """
    rest = [name for name in df.columns if name not in keys]
    ranking = Window.partitionBy(*keys).orderBy(*(order or rest or keys))
    return df.withColumn("_place", F.row_number().over(ranking)).where("_place = 1").drop("_place")

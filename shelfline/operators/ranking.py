"""Top rows per group and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(
    df: DataFrame, group: list[str], order: list[Column], n: int, rank_col: str | None = None
) -> DataFrame:
    """The first `n` rows of each group. End `order` with a unique column, so that ties have one answer.

    Written as a row number with a bound, which Spark also applies on the map side: no more than `n` rows of a group
    leave each task, however large the group is.
    """
    name = rank_col or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    kept = ranked.where(F.col(name) <= n)
    return kept if rank_col else kept.drop(name)


def top_n(df: DataFrame, by: str, n: int, tiebreak: list[str]) -> DataFrame:
    """The `n` rows with the highest `by`; equal values are ordered by the tie-break columns."""
    return df.orderBy(F.desc(by), *tiebreak).limit(n)

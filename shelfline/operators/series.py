"""Dense time series and running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def step_micros(step: str) -> Column:
    """Length of a step such as `'1 minute'` in microseconds; Spark folds it to a constant."""
    zero = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
    return F.expr(f"timestampdiff(MICROSECOND, {zero}, {zero} + INTERVAL '{step}')")


def with_bins(keys: DataFrame, ts: str, start: Column, end: Column, step: str) -> DataFrame:
    """Each row once per bin from `start` up to but not including `end`."""
    first, length = F.unix_micros(start), step_micros(step)
    last_bin = F.ceil((F.unix_micros(end) - first) / length) - 1
    numbered = keys.withColumn(ts, F.explode(F.sequence(F.lit(0).cast("bigint"), last_bin)))
    return numbered.withColumn(ts, F.timestamp_micros(first + F.col(ts) * length))


def aligned_bin(ts: Column, start: Column, step: str) -> Column:
    """Start of the bin of length `step`, counted from `start`, that holds `ts`."""
    first, length = F.unix_micros(start), step_micros(step)
    offset = F.unix_micros(ts) - first
    return F.timestamp_micros(first + offset - F.pmod(offset, length))


def make_series(
    binned: DataFrame, keys: list[str], ts: str, value: str, start: Column, end: Column, step: str
) -> DataFrame:
    """Every bin of every key, with 0 where `binned` has no row.

    `binned` has one row per key and bin. Only the keys are expanded, each into the fixed
    number of bins between `start` and `end`; the values are joined on.
    """
    spine = with_bins(binned.select(*keys).distinct(), ts, start, end, step)
    return spine.join(binned, [*keys, ts], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def cumulative(series: DataFrame, keys: list[str], ts: str, value: str, total: str = "cum") -> DataFrame:
    """Running total per key over time. The rows of a key are the bins of one interval, so a group stays small."""
    upto = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return series.withColumn(total, F.sum(value).over(upto))

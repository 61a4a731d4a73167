"""Distinct counts that can be added up: a sketch per key and time bin, merged over any range of bins.

An exact distinct count over a window has to look at all values of the window again. A sketch is small and of bounded
size; those of the bins of a window merge into the sketch of the window. Counts are estimates: with 2**lg_k registers
the relative standard error is about 1.04 / sqrt(2**lg_k) for large counts, and small counts are nearly exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12


def bin_sketches(rows: DataFrame, keys: list[str], ts: str, value: str, lg_k: int = LG_K) -> DataFrame:
    """(keys, ts, sketch): a sketch of the distinct values of each key and bin; `ts` holds the start of the bin."""
    return rows.groupBy(*keys, ts).agg(F.hll_sketch_agg(value, lg_k).alias("sketch"))


def window_estimates(sketches: DataFrame, keys: list[str], ts: str, start: Column, end: Column, name: str = "estimate") -> DataFrame:
    """Estimated distinct values of each key in the bins from `start` up to but not including `end`."""
    inside = sketches.where((F.col(ts) >= start) & (F.col(ts) < end))
    return inside.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))


def standard_error(lg_k: int = LG_K) -> float:
    return 1.04 / 2 ** (lg_k / 2)

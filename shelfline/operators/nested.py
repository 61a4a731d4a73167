"""Arrays of records to rows and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.operators.pairs import pair_counts


def expand(df: DataFrame, array: str, index: str = "item_index", value: str = "item") -> DataFrame:
    """One row per element of an array, with its index from 0; all other columns are kept. A row whose array is
    missing or empty gives no row."""
    parents = [name for name in df.columns if name != array]
    return df.select(*parents, F.posexplode(array).alias(index, value)).withColumn(index, F.col(index).cast("bigint"))


def manage_fields(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Pick and rename fields: output name to source field or nested path."""
    return df.select(*[F.col(path).alias(name) for name, path in mapping.items()])


def array_pairs(df: DataFrame, array: str, key: str, min_pair_cnt: int = 1) -> DataFrame:
    """Unordered pairs of the distinct values in each row's array, counted over the keys that hold both.

    With a `min_pair_cnt` of 2 or more, rarer values and pairs go before pairs are formed.
    """
    values = df.select(key, F.explode(F.array_distinct(array)).alias("value"))
    return pair_counts(values, min_pair_cnt, group=key, item="value")

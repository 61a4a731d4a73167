"""Formatted and content-derived ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfline.functions.columns import ColumnLike, as_column


def padded(prefix: str, number: ColumnLike, width: int) -> Column:
    """`prefix` and the number with leading zeros; longer numbers keep all their digits."""
    digits = as_column(number).cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0")))


def product_id(number: ColumnLike, width: int = 4) -> Column:
    return padded("P", number, width)


def day_digits(day: ColumnLike) -> Column:
    """The day as it stands in an order id."""
    return F.date_format(as_column(day), "yyyyMMdd")


def order_id(day: ColumnLike, number: ColumnLike, width: int = 5) -> Column:
    return order_id_of(day_digits(day), number, width)


def order_id_of(digits: ColumnLike, number: ColumnLike, width: int = 5) -> Column:
    return F.concat(F.lit("O"), as_column(digits), padded("-", number, width))


def combination_id(item_ids: ColumnLike) -> Column:
    """Id of a set of items: equal for equal items in any order.

    SHA-256 over the sorted ids joined by `|`; its first 32 hex digits are written as 8-4-4-4-12.
    """
    digest = F.sha2(F.array_join(F.array_sort(as_column(item_ids)), "|"), 256)
    return F.regexp_replace(
        F.substring(digest, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )

"""Text predicates, keys and sort keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfline.functions.columns import ColumnLike, as_column

# fixed values: clothing sizes, smallest first
ALPHA_SIZES = ["XS", "S", "M", "L", "XL", "XXL", "XXXL"]

# fixed values: brands named in product titles, and the share of unnamed titles that goes to the first
TITLE_BRANDS = ["BOSS", "HUGO"]
FIRST_BRAND_PERCENT = 60


def not_empty(text: ColumnLike) -> Column:
    """False for NULL and for the empty string."""
    return F.coalesce(F.length(as_column(text)), F.lit(0)) > 0


def same_text(left: ColumnLike, text: str) -> Column:
    """Equality without regard to case."""
    return F.lower(as_column(left)) == F.lower(F.lit(text))


def pair_key(first: ColumnLike, second: ColumnLike) -> Column:
    return F.concat(as_column(first), F.lit(" × "), as_column(second))


def stringify(value: ColumnLike, *, nested: bool = False) -> Column:
    """Text form of a field: JSON for a nested one, the plain value otherwise."""
    return F.to_json(as_column(value)) if nested else as_column(value).cast("string")


def brand_from_title(title: ColumnLike, salt: str = "") -> Column:
    """Brand named in a title. Other titles are split 60 to 40 by a hash of their text, so that reruns agree."""
    title = F.coalesce(as_column(title), F.lit(""))
    first, second = TITLE_BRANDS
    bucket = F.conv(F.substring(F.md5(F.concat(title, F.lit(salt))), 1, 8), 16, 10).cast("long") % 100
    named = F.upper(title)
    return (
        F.when(named.contains(first), first)
        .when(named.contains(second), second)
        .when(bucket < FIRST_BRAND_PERCENT, first)
        .otherwise(second)
    )


def size_sort_key(size: ColumnLike) -> Column:
    """Sort key of a size: numbers ascending, then XS to XXXL, then anything else by its text.

    A two-part size such as 30/32 sorts by its first number, then by its second.
    """
    size = as_column(size)
    first = F.substring_index(size, "/", 1).try_cast("double")
    second = F.substring_index(size, "/", -1).try_cast("double")
    place = F.array_position(F.array(*[F.lit(s) for s in ALPHA_SIZES]), size)
    group = F.when(first.isNotNull(), 0).when(place > 0, 1).otherwise(2)
    return F.struct(
        group.alias("kind"),
        F.coalesce(first, F.when(place > 0, place.cast("double")), F.lit(0.0)).alias("main"),
        F.coalesce(second, F.lit(0.0)).alias("minor"),
        F.coalesce(size, F.lit("")).alias("text"),
    )

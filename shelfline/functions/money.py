"""Prices, discounts and guarded ratios. Money is double, rounded half to even."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfline.functions.columns import ColumnLike, as_column

# fixed values: promotion codes, the share or amount each takes off, and the order value a fixed amount needs
PERCENT_CODES = {"WELCOME10": 0.10}
AMOUNT_CODES = {"BUNDLE5": (5.00, 50.0)}
FREE_SHIPPING_CODES = ["FREESHIP"]


class PricedOrder(NamedTuple):
    discount: Column
    total: Column


def discount_pct(price: ColumnLike, original: ColumnLike) -> Column:
    """Whole percent off the original price; NULL unless the original price is higher."""
    price, original = as_column(price), as_column(original)
    return F.when(original > price, F.bround((F.lit(1) - price / original) * 100).cast("int"))


def subtotal(items: ColumnLike) -> Column:
    """Sum of price times quantity over an array of items; 0 without items."""
    listed = F.filter(as_column(items), lambda item: item["price"].isNotNull() & item["quantity"].isNotNull())
    total = F.aggregate(
        listed, F.lit(0.0), lambda acc, item: acc + item["price"] * item["quantity"].cast("double")
    )
    return F.bround(F.coalesce(total, F.lit(0.0)), 2)


def price_order(subtotal: ColumnLike, code: ColumnLike) -> PricedOrder:
    """Discount and total of an order under a promotion code; unknown and missing codes take nothing off.

    Without a subtotal there is neither.
    """
    subtotal, code = as_column(subtotal), as_column(code)
    off = F.when(subtotal.isNotNull(), 0.0)
    for name, share in PERCENT_CODES.items():
        off = F.when(code == name, share * subtotal).otherwise(off)
    for name, (amount, floor) in AMOUNT_CODES.items():
        off = F.when((code == name) & (subtotal >= floor), F.lit(amount)).otherwise(off)
    return PricedOrder(F.bround(off, 2), F.bround(F.when(off > subtotal, 0.0).otherwise(subtotal - off), 2))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL for a zero denominator instead of an error."""
    return F.try_divide(numerator.cast("double"), denominator)


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, F.lit(0.0)).otherwise(ratio(numerator, denominator))


def decimal_sum(amount: ColumnLike) -> Column:
    """A sum of amounts, each rounded to six decimal places, that stays a decimal and so can be summed again."""
    return F.sum(as_column(amount).cast("decimal(28,6)"))


def exact_sum(amount: ColumnLike) -> Column:
    """A sum of amounts that does not depend on the order of the rows: each is rounded to six decimal places first."""
    return decimal_sum(amount).cast("double")

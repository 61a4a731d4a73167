"""Declared table and event shapes."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, nullable) for name, dtype, nullable in fields])


_S, _D, _I, _L, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()

PRODUCTS = _struct(
    ("product_id", _S, False), ("name", _S, False), ("material", _S, True),
    ("base_price", _D, True), ("color", _S, True), ("brand", _S, True),
)
PRODUCT_CATEGORIES = _struct(("product_id", _S, False), ("category", _S, False))
PRODUCT_INVENTORY = _struct(
    ("product_id", _S, False), ("location", _S, False), ("size", _S, False), ("amount", _I, False),
)
ORDERS = _struct(
    ("order_id", _S, False), ("user_id", _S, True), ("location", _S, True),
    ("promo_flag", _B, True), ("promo_code", _S, True),
)
ORDER_ITEMS = _struct(
    ("order_id", _S, False), ("product_id", _S, False), ("amount", _I, False), ("color", _S, True),
)

AFFINITY_DDL = (
    "lhs_item_id string, rhs_item_id string, pair_cnt long, lhs_cnt long, rhs_cnt long, "
    "support_lhs double, support_rhs double, support_pair double, "
    "confidence_lhs_to_rhs double, lift double, refreshed_at timestamp"
)
AFFINITY_NAMED_DDL = (
    "lhs_item_id string, lhs_name string, rhs_item_id string, rhs_name string, pair_cnt long, "
    "support_pair double, confidence_lhs_to_rhs double, lift double, refreshed_at timestamp"
)

# Event items. `discount` is a double: declared as a whole number it would turn 12.5 into NULL. `product_id` is a
# string, which also keeps an object sent in its place as JSON text.
SALE_ITEM = _struct(
    ("product_id", _S, True), ("name", _S, True), ("color", _S, True),
    ("size", _S, True), ("quantity", _L, True), ("price", _D, True),
)
COMBINATION_ITEM = _struct(
    ("product_id", _S, True), ("name", _S, True), ("brand", _S, True), ("category", _S, True),
    ("price", _D, True), ("original_price", _D, True), ("color", _S, True), ("size", _S, True),
    ("image_url", _S, True),
)

# The envelopes carry both spellings of the user field, because the two producers differ.
SALE_EVENT = _struct(
    ("event_type", _S, True), ("event_time", _S, True), ("order_id", _S, True), ("combination_id", _S, True),
    ("user", _S, True), ("user_id", _S, True), ("is_community_created", _B, True), ("promo_code", _S, True),
    ("discount", _D, True), ("total_price", _D, True), ("items", T.ArrayType(SALE_ITEM), True),
)
COMBINATION_EVENT = _struct(
    ("event_type", _S, True), ("event_time", _S, True), ("combination_id", _S, True),
    ("user", _S, True), ("user_id", _S, True), ("is_community_created", _B, True),
    ("items", T.ArrayType(COMBINATION_ITEM), True),
)

CATALOG_PRODUCT = _struct(
    ("id", _S, True), ("name", _S, True), ("brand", _S, True), ("price", _D, True), ("originalPrice", _D, True),
    ("color", _S, True), ("image", _S, True), ("sizes", T.ArrayType(_S), True),
)
CATALOG = T.MapType(_S, T.ArrayType(CATALOG_PRODUCT))

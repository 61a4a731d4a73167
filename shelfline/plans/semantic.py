"""Business measures over the star schema, evaluated by any of its attributes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions.money import decimal_sum, exact_sum, ratio
from shelfline.sources.tables import read_table

PRODUCT_ATTRIBUTES = ["product_name", "category", "brand"]
STORE_ATTRIBUTES = ["region", "channel"]
DATE_ATTRIBUTES = ["date", "date_key", "year", "quarter", "month", "day", "day_of_week"]
BASKET_ATTRIBUTES = ["store_id", "user_id", "promo_flag", "promo_code"]


@dataclass(frozen=True)
class Model:
    """The star: two facts and three dimensions. Sales lead to products and baskets, baskets to stores and dates."""

    dim_product: DataFrame
    dim_store: DataFrame
    dim_date: DataFrame
    fact_sales_item: DataFrame
    fact_basket_summary: DataFrame

    @staticmethod
    def from_tables(spark: SparkSession, silver: str) -> Model:
        return Model(**{name: read_table(spark, silver, name) for name in Model.__dataclass_fields__})


def _with_basket_dims(model: Model, df: DataFrame, columns: set[str]) -> DataFrame:
    if columns & set(STORE_ATTRIBUTES):
        df = df.join(model.dim_store.select("store_id", *STORE_ATTRIBUTES), "store_id", "left")
    if columns & set(DATE_ATTRIBUTES):
        dates = model.dim_date.select(F.col("date").alias("order_date"), *DATE_ATTRIBUTES)
        df = df.join(dates, "order_date", "left")
    return df


def _basket_keys(columns: set[str]) -> list[str]:
    """The columns of the baskets that lead to these attributes."""
    keys = [name for name in BASKET_ATTRIBUTES if name in columns]
    if columns & set(STORE_ATTRIBUTES) and "store_id" not in keys:
        keys.append("store_id")
    return keys + ["order_date"] * bool(columns & set(DATE_ATTRIBUTES))


def _basket_star(model: Model, columns: set[str], parts: dict[str, Column], more: Sequence[str] = ()) -> DataFrame:
    """Counts of the baskets per key that leads to the attributes, with these: stores and dates meet counts, not orders."""
    keys = list(dict.fromkeys([*_basket_keys(columns), *more]))
    return _with_basket_dims(model, _aggregate(model.fact_basket_summary, keys, parts), columns)


def _rolled_star(model: Model, columns: set[str]) -> DataFrame:
    """Sums of the lines by product, basket, store and date attributes, with the sums taken before each join:

    per order and product attributes, so that the orders meet no single lines, then per store, day and basket
    attributes, so that stores and dates meet no orders.
    """
    attributes, keys = [name for name in PRODUCT_ATTRIBUTES if name in columns], _basket_keys(columns)
    sums = [F.sum("qty").alias("qty"), decimal_sum("line_value").alias("line_value")]
    lines = model.fact_sales_item.select("order_id", "product_id", "qty", "line_value")
    lines = lines.join(model.dim_product.select("product_id", *attributes), "product_id", "left")
    per_order = lines.groupBy("order_id", *attributes).agg(*sums)
    heads = model.fact_basket_summary.select("order_id", *keys)
    placed = per_order.join(heads, "order_id", "left").groupBy(*keys, *attributes).agg(*sums)
    return _with_basket_dims(model, placed, columns)


def star_view(model: Model, columns: Sequence[str] | None = None, *, rolled_up: bool = False) -> DataFrame:
    """Order lines with the attributes of their product, basket, store and date.

    With `columns` given, only the joins that provide one of them are made. `rolled_up` sums quantity and value of the
    lines before each join, down to the keys that lead to those columns. The sums stay the same, the joins get smaller,
    and a product or order with very many lines arrives as one row. Only the join of lines and products, where attributes
    of both products and orders are asked for, meets single lines; a hot product is left to the adaptive skew join.
    """
    every = PRODUCT_ATTRIBUTES + STORE_ATTRIBUTES + DATE_ATTRIBUTES + BASKET_ATTRIBUTES
    wanted = set(every if columns is None else columns)
    by_product = bool(wanted & set(PRODUCT_ATTRIBUTES))
    by_order = bool(wanted - set(PRODUCT_ATTRIBUTES))
    if rolled_up and by_product and by_order:
        return _rolled_star(model, wanted)
    star = model.fact_sales_item.select("order_id", "product_id", "qty", "unit_price", "line_value")
    if rolled_up and by_product != by_order:
        key = "product_id" if by_product else "order_id"
        star = star.groupBy(key).agg(F.sum("qty").alias("qty"), decimal_sum("line_value").alias("line_value"))
    if by_product:
        star = star.join(model.dim_product.select("product_id", *PRODUCT_ATTRIBUTES), "product_id", "left")
    if by_order:
        heads = model.fact_basket_summary.select("order_id", "order_date", *BASKET_ATTRIBUTES)
        star = star.join(heads, "order_id", "left")
        if rolled_up:
            sums = [F.sum("qty").alias("qty"), decimal_sum("line_value").alias("line_value")]
            star = star.groupBy(*_basket_keys(wanted)).agg(*sums)
        star = _with_basket_dims(model, star, wanted)
    return star


@dataclass(frozen=True)
class Measure:
    """A named figure: sums over the sales fact, counts over the basket fact, and how they combine."""

    name: str
    result: Column
    sales: dict[str, Column] = field(default_factory=dict)
    baskets: dict[str, Column] = field(default_factory=dict)
    # aggregates over users instead of baskets; `_promoted` tells whether a user has a promoted basket
    users: dict[str, Column] = field(default_factory=dict)


def _revenue() -> dict[str, Column]:
    return {"_revenue": exact_sum("line_value")}


def _orders() -> dict[str, Column]:
    # An order has one basket row and each dimension joins many-to-one: counting ids counts distinct ids.
    return {"_orders": F.count("order_id")}


def _promoted(value: Column) -> Column:
    return F.when(F.coalesce("promo_flag", F.lit(False)), value)


def revenue() -> Measure:
    return Measure("revenue", F.col("_revenue"), sales=_revenue())


def units_sold() -> Measure:
    return Measure("units_sold", F.col("_units"), sales={"_units": F.sum("qty")})


def orders() -> Measure:
    """Orders, those without lines included."""
    return Measure("orders", F.col("_orders"), baskets=_orders())


def aov() -> Measure:
    """Revenue over orders: unlike the mean basket value, empty orders count."""
    return Measure("aov", ratio(F.col("_revenue"), F.col("_orders")), sales=_revenue(), baskets=_orders())


def promo_orders() -> Measure:
    """Share of orders with a promotion, from 0 to 1."""
    parts = {**_orders(), "_promo_orders": F.count(_promoted(F.col("order_id")))}
    return Measure("promo_orders", ratio(F.col("_promo_orders"), F.col("_orders")), baskets=parts)


def promo_users() -> Measure:
    """Share of users with a promoted order in the context; all orders without a user count as one user."""
    parts = {"_promo_users": F.count_if("_promoted"), "_users": F.count(F.lit(1))}
    return Measure("promo_users", ratio(F.col("_promo_users"), F.col("_users")), users=parts)


def _filtered(df: DataFrame, filters: dict[str, Sequence]) -> DataFrame:
    for name, values in filters.items():
        if values:
            df = df.where(F.col(name).isin(*values))
    return df


def _aggregate(df: DataFrame, by: Sequence[str], parts: dict[str, Column]) -> DataFrame:
    aggregates = [column.alias(name) for name, column in parts.items()]
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)


def _join_on(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Full join that also matches NULL attributes."""
    left, right = left.alias("l"), right.alias("r")
    matches = [F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}")) for name in by]
    keys = [F.coalesce(F.col(f"l.{name}"), F.col(f"r.{name}")).alias(name) for name in by]
    rest = [F.col(f"l.{c}") for c in left.columns if c not in by] + [
        F.col(f"r.{c}") for c in right.columns if c not in by
    ]
    return left.join(right, reduce(lambda a, b: a & b, matches), "full").select(*keys, *rest)


def evaluate(
    model: Model,
    by: Sequence[str],
    measures: Sequence[Measure],
    filters: dict[str, Sequence] | None = None,
) -> DataFrame:
    """Measures by attributes, under lists of allowed attribute values.

    Each fact is aggregated on its own and the results are joined, so basket figures are never repeated per line.
    Product attributes describe lines only: they neither split nor filter the basket figures.
    """
    by, filters = list(by), filters or {}
    sales_parts = {name: column for m in measures for name, column in m.sales.items()}
    basket_parts = {name: column for m in measures for name, column in m.baskets.items()}
    user_parts = {name: column for m in measures for name, column in m.users.items()}
    shared = [name for name in by if name not in PRODUCT_ATTRIBUTES]
    shared_filters = {name: values for name, values in filters.items() if name not in PRODUCT_ATTRIBUTES}

    sales = baskets = None
    if sales_parts:
        star = star_view(model, [*by, *filters], rolled_up=True)
        sales = _aggregate(_filtered(star, filters), by, sales_parts)
    if basket_parts or user_parts:
        added = {name: F.coalesce(F.sum(name), F.lit(0)) for name in basket_parts}
        promoted = {"_promoted": F.max(F.coalesce("promo_flag", F.lit(False)))} if user_parts else {}
        star = _basket_star(model, {*shared, *shared_filters}, basket_parts | promoted, ["user_id"] if user_parts else [])
        star = _filtered(star, shared_filters)
        if user_parts:
            # one row per user, with the counts of the baskets
            star = _aggregate(star, list(dict.fromkeys([*shared, "user_id"])), added | {"_promoted": F.max("_promoted")})
        basket_parts = added | user_parts
        baskets = _aggregate(star, shared, basket_parts)

    if sales is None:
        joined = baskets
    elif baskets is None:
        joined = sales
    elif not shared:
        joined = sales.select("*", *[baskets.select(name).scalar().alias(name) for name in basket_parts])
    elif shared == by:
        joined = _join_on(sales, baskets, shared)
    else:
        joined = _attach(sales, baskets, shared)
    kept = by if sales is not None else shared
    return joined.select(*kept, *[m.result.alias(m.name) for m in measures])


def _attach(sales: DataFrame, baskets: DataFrame, shared: list[str]) -> DataFrame:
    """Basket figures beside finer sales rows; NULL attributes match."""
    sales, baskets = sales.alias("l"), baskets.alias("r")
    matches = [F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}")) for name in shared]
    rest = [F.col(f"r.{c}") for c in baskets.columns if c not in shared]
    return sales.join(baskets, reduce(lambda a, b: a & b, matches), "left").select("l.*", *rest)

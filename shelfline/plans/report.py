"""Data sets of the sales report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.functions.money import exact_sum, ratio
from shelfline.functions.text import not_empty
from shelfline.plans import semantic
from shelfline.plans.semantic import Model, star_view


def dates_with_baskets(dim_date: DataFrame, summary: DataFrame) -> DataFrame:
    """The dates on which there were orders."""
    return dim_date.join(summary.select(F.col("order_date").alias("date")).distinct(), "date", "left_semi")


def report_filter(
    star: DataFrame, brands: Sequence[str] | None = None, categories: Sequence[str] | None = None
) -> DataFrame:
    """Rows with a category, limited to the chosen brands and categories; no choice means all."""
    kept = star.where(not_empty("category"))
    if brands:
        kept = kept.where(F.col("brand").isin(*brands))
    if categories:
        kept = kept.where(F.col("category").isin(*categories))
    return kept


def _dated_star(model: Model, attributes: Sequence[str]) -> DataFrame:
    """Sums of lines by date and product attributes, kept to the dates that have orders.

    A line has its date from its order, so a date that is found is one of `dates_with_baskets`.
    """
    return star_view(model, ["date", *attributes], rolled_up=True).where("date IS NOT NULL")


def revenue_by_date_category(model: Model) -> DataFrame:
    figures = _dated_star(model, ["category"]).groupBy("date", "category").agg(exact_sum("line_value").alias("revenue"))
    return figures.orderBy("date", "category")


def units_by_date_brand_category(model: Model) -> DataFrame:
    figures = _dated_star(model, ["brand", "category"]).groupBy("date", "brand", "category").agg(F.sum("qty").alias("units_sold"))
    return figures.orderBy(F.desc("units_sold"), "date", "brand", "category")


def revenue_by_brand(
    model: Model, brands: Sequence[str] | None = None, categories: Sequence[str] | None = None
) -> DataFrame:
    star = report_filter(star_view(model, semantic.PRODUCT_ATTRIBUTES, rolled_up=True), brands, categories)
    return star.groupBy("brand").agg(exact_sum("line_value").alias("revenue")).orderBy(F.desc("revenue"), "brand")


def units_total(
    model: Model, brands: Sequence[str] | None = None, categories: Sequence[str] | None = None
) -> DataFrame:
    """Units sold for the chosen brands and categories."""
    chosen = {"brand": list(brands or ()), "category": list(categories or ())}
    return semantic.evaluate(model, [], [semantic.units_sold()], {k: v for k, v in chosen.items() if v})


def sales_dashboard(model: Model) -> dict[str, DataFrame]:
    """The asked-for sales dashboard, one data set per visual."""
    return {
        "totals": semantic.evaluate(model, [], [semantic.revenue(), semantic.orders()]),
        "aov_by_date": semantic.evaluate(model, ["date"], [semantic.aov()]),
        "revenue_by_region_channel": semantic.evaluate(model, ["region", "channel"], [semantic.revenue()]),
        "revenue_by_brand": semantic.evaluate(model, ["brand"], [semantic.revenue()]),
        "revenue_by_category": semantic.evaluate(model, ["category"], [semantic.revenue()]),
    }


# fixed values: the visuals of the dashboard, and the attributes each splits its figures by
VISUALS = {
    "totals": [], "aov_by_date": ["date"], "revenue_by_region_channel": ["region", "channel"],
    "revenue_by_brand": ["brand"], "revenue_by_category": ["category"],
}


def dashboard(model: Model) -> DataFrame:
    """All visuals of the dashboard in one pass over each fact: (visual, date, region, channel, brand, category, revenue,
    orders, aov).

    The lines are summed to date, place, brand and category once; grouping sets over these sums give every visual.
    Orders and order values are given where the split is by dates or none, since products do not split baskets; dates
    without lines have a row too.
    """
    axes = list(dict.fromkeys(name for names in VISUALS.values() for name in names))
    cells = star_view(model, axes, rolled_up=True)
    sets = [[F.col(name) for name in names] for names in VISUALS.values()]
    numbers = {sum(1 << (len(axes) - 1 - i) for i, axis in enumerate(axes) if axis not in names): visual for visual, names in VISUALS.items()}
    named = F.create_map(*[F.lit(part) for entry in numbers.items() for part in entry])
    sales = cells.groupingSets(sets, *axes).agg(F.grouping_id(*axes).cast("int").alias("split"), exact_sum("line_value").alias("revenue"))
    dated = semantic.evaluate(model, ["date"], [semantic.orders()])
    counts = dated.groupingSets([[F.col("date")], []], "date").agg(F.grouping_id("date").alias("whole"), F.sum("orders").alias("orders"))
    counts = counts.select(F.when(F.col("whole") == 0, "aov_by_date").otherwise("totals").alias("visual"), "date", "orders")
    sales = sales.select(named[F.col("split")].alias("visual"), *axes, "revenue").alias("s")
    both = sales.join(counts.alias("c"), (F.col("s.visual") == F.col("c.visual")) & F.col("s.date").eqNullSafe(F.col("c.date")), "full")
    return both.select(
        F.coalesce("s.visual", "c.visual").alias("visual"), F.coalesce("s.date", "c.date").alias("date"), *axes[1:], "revenue", "orders",
        ratio(F.col("revenue"), F.col("orders")).alias("aov"),
    )

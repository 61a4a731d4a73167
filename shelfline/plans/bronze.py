"""Raw product tables: colour variants of catalog titles and the stock grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline import schemas
from shelfline.functions.ids import product_id
from shelfline.functions.text import brand_from_title
from shelfline.sources.tables import with_schema

# fixed values: sizes kept in stock per category, and the places that keep stock
CATEGORY_SIZES = {
    "shoes": ["39", "40", "41", "42", "43", "44", "45", "46"],
    "trousers": [
        "29/30", "30/32", "31/32", "31/34", "32/30", "32/32", "32/34", "33/32", "33/34", "34/32", "34/34", "36/32",
        "38/32", "40/34", "42/34",
    ],
    "tshirts": ["XS", "S", "M", "L", "XL", "XXL", "XXXL"],
    "jackets": ["S", "M", "L", "XL", "XXL"],
}
STOCK_LOCATIONS = ["Cologne", "Metzingen", "Munich", "Hamburg", "Online"]

# Titles per numbering block. Blocks are numbered in parallel; only one row per block is put in a total order.
TITLES_PER_BLOCK = 10_000


def variants(catalog: DataFrame, *, width: int = 4, salt: str = "", block: int = TITLES_PER_BLOCK) -> DataFrame:
    """One product per title and colour, numbered from 1 in catalog order.

    `catalog` has category_no, category, title_no, title, material, price, colors; a title is identified by
    (category_no, title_no). The running number is a prefix sum of colour counts: titles are summed in blocks, the
    blocks (one row each) get their offsets, and each block then numbers its own titles. A block holds at most
    `block` titles, so no window sees the whole catalog but the one over the block totals.
    """
    titles = catalog.withColumn("n_colors", F.greatest(F.size("colors"), F.lit(0))).withColumn(
        "block_no", F.floor(F.col("title_no") / block)
    )
    place = ["category_no", "block_no"]
    before = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        titles.groupBy(*place)
        .agg(F.sum("n_colors").alias("n"))
        .select(*place, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("block_offset"))
    )
    in_block = Window.partitionBy(*place).orderBy("title_no").rowsBetween(Window.unboundedPreceding, -1)
    numbered = titles.join(offsets, place).withColumn(
        "first_no", F.col("block_offset") + F.coalesce(F.sum("n_colors").over(in_block), F.lit(0)) + 1
    )
    colored = numbered.select("*", F.posexplode("colors").alias("color_no", "color"))
    return colored.select(
        product_id(F.col("first_no") + F.col("color_no"), width).alias("product_id"),
        F.col("title").alias("name"),
        "material",
        F.col("price").cast("double").alias("base_price"),
        "color",
        brand_from_title("title", salt).alias("brand"),
        "category",
    )


def products(built: DataFrame) -> DataFrame:
    return with_schema(built, schemas.PRODUCTS)


def product_categories(built: DataFrame) -> DataFrame:
    return with_schema(built, schemas.PRODUCT_CATEGORIES)


def _lookup(entries: dict[str, list[str]]) -> Column:
    return F.create_map(
        *[part for key, values in entries.items() for part in (F.lit(key), F.array(*[F.lit(v) for v in values]))]
    )


def inventory_grid(
    cats: DataFrame,
    inventory: DataFrame,
    sizes: dict[str, list[str]] | None = None,
    locations: list[str] | None = None,
) -> DataFrame:
    """Every expected (product, location, size) with its stock, 0 where there is none.

    The grid grows each product by the fixed lists of places and of its category's sizes; nothing is cross-joined.
    """
    places = F.array(*[F.lit(name) for name in locations or STOCK_LOCATIONS])
    by_category = _lookup(sizes or CATEGORY_SIZES)
    grid = (
        cats.select("product_id", "category", F.explode(by_category[F.col("category")]).alias("size"))
        .withColumn("location", F.explode(places))
        .select("product_id", "category", "location", "size")
    )
    stock = inventory.groupBy("product_id", "location", "size").agg(F.sum("amount").alias("amount"))
    return grid.join(stock, ["product_id", "location", "size"], "left").select(
        "product_id", "category", "location", "size", F.coalesce("amount", F.lit(0)).alias("amount")
    )

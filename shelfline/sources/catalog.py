"""The shop's nested product catalog: JSON documents that map a category to its products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline import schemas
from shelfline.functions.money import discount_pct
from shelfline.session import stored

# fixed values: display names of the catalog's categories
CATEGORY_NAMES = {
    "hosen": "Hosen", "jacken": "Jacken", "pullover": "Pullover",
    "schuhe": "Schuhe", "roecke": "Röcke", "kleider": "Kleider",
}


def category_name(category_id: Column) -> Column:
    """Display name of a category; an unknown one shows its id with a capital first letter."""
    names = F.create_map(*[F.lit(part) for entry in CATEGORY_NAMES.items() for part in entry])
    capitalised = F.concat(F.upper(F.substring(category_id, 1, 1)), F.lower(F.substr(category_id, F.lit(2))))
    return F.coalesce(names[category_id], capitalised)


def _products(parsed: DataFrame) -> DataFrame:
    """Product columns from (category_id, product)."""
    return parsed.select(
        F.col("product.id").alias("product_id"),
        F.col("product.name").alias("name"),
        F.col("product.brand").alias("brand"),
        F.col("product.price").alias("price"),
        F.col("product.originalPrice").alias("original_price"),
        discount_pct("product.price", "product.originalPrice").alias("discount"),
        F.col("product.color").alias("color"),
        F.col("product.image").alias("image"),
        F.col("product.sizes").alias("sizes"),
        "category_id",
        category_name(F.col("category_id")).alias("category_name"),
    )


def flatten_catalog(documents: DataFrame, column: str = "value") -> DataFrame:
    """One row per product of the JSON documents in `column`."""
    listed = documents.select(F.from_json(column, schemas.CATALOG).alias("catalog")).select(F.explode("catalog").alias("category_id", "products"))
    return _products(listed.select("category_id", F.explode("products").alias("product")))


# Patterns of JSON text, written so that they never go back over what they have matched
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_OPEN_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+$'
# all that comes before the product: up to the brace that follows the start of a list or a comma
_HEAD = rf'^(?:[^"\[,]++|{_STRING}|[\[,](?!\s*+\{{))*+[\[,]\s*+(?=\{{)'
_CATEGORY = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"\s*+:\s*+\[\s*+$'


def _carried(rows: DataFrame, amount: Column, name: str) -> DataFrame:
    """Adds the sum of `amount` over all earlier rows of a file: sums within blocks, which tasks take one each, and over
    the totals of earlier blocks, a row per block."""
    inside = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("file", "block").agg(F.sum(amount).alias("_total"))
    totals = totals.select("file", "block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carry"))
    summed = rows.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(totals, ["file", "block"])
    return summed.withColumn(name, F.col("_inside") + F.col("_carry")).drop("_inside", "_carry")


def split_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(category_id, product) of every product in catalog files of any layout and size, product as parsed record.

    Files are cut at closing braces, so a block of a file is read by a task of its own, however the document is laid out.
    Quotes before a piece tell whether it starts inside a string, braces outside of strings how deep; a product is the
    pieces since the last return to the depth of the document. Its category is the last name of a list before it. Only
    the pieces of one product are gathered. Documents may follow each other in a file.
    """
    text = spark.read.option("lineSep", "}").text(path)
    rows = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value"
    )
    quotes = F.length(F.regexp_replace(F.regexp_replace("value", r"\\.", ""), r'[^"]++', ""))
    rows = _carried(stored(rows.withColumn("quotes", quotes.cast("bigint")), "catalog"), F.col("quotes"), "quoted")
    starts_inside, ends_inside = F.col("quoted") % 2 == 1, (F.col("quoted") + F.col("quotes")) % 2 == 1
    plain = F.concat(F.when(starts_inside, F.lit('"')).otherwise(F.lit("")), F.col("value"))
    plain = F.regexp_replace(F.regexp_replace(plain, _STRING, ""), _OPEN_STRING, "")
    opened = F.length(F.regexp_replace(plain, r"[^{]++", ""))
    rows = rows.withColumn("change", (opened - F.when(ends_inside, 0).otherwise(1)).cast("bigint"))
    rows = _carried(rows, F.col("change"), "depth")
    done = (~ends_inside & (F.col("depth") + F.col("change") == 1)).cast("bigint")
    rows = _carried(rows.withColumn("done", done), F.col("done"), "number")
    piece = F.struct("block", "place", F.col("value").alias("text"))
    whole = rows.groupBy("file", "number").agg(
        F.array_sort(F.collect_list(piece)).alias("pieces"), F.max("done").alias("done"), F.max(F.struct("block", "place")).alias("end")
    ).where("done = 1")
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["text"], F.lit("}"))), "")
    found = whole.select("file", F.col("end.block").alias("block"), F.col("end.place").alias("place"), text.alias("text"))
    head = F.regexp_extract("text", _HEAD, 0)
    found = found.withColumns({"head": head, "category": F.nullif(F.regexp_extract(head, _CATEGORY, 1), F.lit(""))})
    product = F.from_json(F.substr("text", F.length("head") + 1), schemas.CATALOG_PRODUCT)
    name = F.from_json(F.concat(F.lit('{"name":"'), "category", F.lit('"}')), "name string")["name"]
    return _last_named(found).select(name.alias("category_id"), product.alias("product"))


def _last_named(found: DataFrame) -> DataFrame:
    """The category of each product: its own, or the last one named before it in its file."""
    upto = Window.partitionBy("file", "block").orderBy("place")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = found.groupBy("file", "block").agg(F.max_by("category", F.when(F.col("category").isNotNull(), F.col("place"))).alias("_last"))
    blocks = blocks.select("file", "block", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    own = F.last("category", ignorenulls=True).over(upto)
    return found.withColumn("_own", own).join(blocks, ["file", "block"]).withColumn("category", F.coalesce("_own", "_before")).drop("_own", "_before")


def read_catalog(spark: SparkSession, path: str, *, whole_file: bool | None = None) -> DataFrame:
    """The products of catalog files, whatever their size and layout. Small documents may be read whole, which is cheaper:
    one per file (`whole_file=True`) or one per line (`False`)."""
    if whole_file is None:
        return _products(split_catalog(spark, path))
    return flatten_catalog(spark.read.text(path, wholetext=whole_file))

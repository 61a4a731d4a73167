"""Named tables of a namespace (a layer): scan, declared shapes, overwrite, reset, reporting views."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the tables of each layer, and those shown to reports
BRONZE_TABLES = ["product_inventory", "product_categories", "products", "orders", "order_items"]
SILVER_TABLES = [
    "dim_product", "dim_store", "dim_date", "fact_sales_item", "fact_basket_product", "fact_basket_summary",
    "fact_product_counts", "kx_total_baskets",
]
GOLD_TABLES = [
    "fact_product_affinity", "fact_product_affinity_topk", "product_affinity_topk_named", "sales_aov_overall",
    "sales_aov_by_region_channel", "sales_aov_by_brand", "sales_top_products_by_category", "sales_regional_split",
    "sales_promo_share_orders", "sales_promo_share_users", "sales_promo_share_by_channel",
]
REPORT_SILVER = ["dim_product", "dim_store", "dim_date", "fact_sales_item", "fact_basket_summary"]
AFFINITY_GOLD = ["product_affinity_topk_named"]
REPORT_GOLD = [name for name in GOLD_TABLES if name.startswith("sales_")]


def read_table(spark: SparkSession, ns: str, name: str) -> DataFrame:
    return spark.table(f"{ns}.{name}")


def preview(df: DataFrame, order: list[str], n: int = 1000) -> DataFrame:
    """The first `n` rows in the given order. Sort and limit run as one top-n, so no task holds the table."""
    return df.orderBy(*order).limit(n)


def judge_rows(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns in the declared order and type, and in `reason` why a row breaks the declaration, or NULL.

    A row breaks it with a value that does not fit its type, or with no value in a column that needs one. A column the
    input lacks counts as NULL, so producers may add and omit optional fields.
    """
    present = set(df.columns)
    reason, values = F.lit(None).cast("string"), []
    for f in schema.fields:
        raw = F.col(f.name) if f.name in present else F.lit(None)
        value = raw.try_cast(f.dataType) if f.name in present else raw.cast(f.dataType)
        if f.name in present:
            reason = F.coalesce(reason, F.when(raw.isNotNull() & value.isNull(), f"{f.name}: does not fit {f.dataType.simpleString()}"))
        if not f.nullable:
            reason = F.coalesce(reason, F.when(raw.isNull(), f"{f.name}: missing"))
        values.append(value.alias(f.name))
    return df.select(*values, reason.alias("reason"))


def split_by_schema(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The rows that keep to the declaration, and the others as JSON text with the reason."""
    judged = judge_rows(df, schema)
    bad = df.withColumn("_row", F.to_json(F.struct(*df.columns)))
    rejects = judge_rows(bad, T.StructType([*schema.fields, T.StructField("_row", T.StringType())]))
    return (
        judged.where("reason IS NULL").drop("reason"),
        rejects.where("reason IS NOT NULL").select(F.col("_row").alias("value"), "reason"),
    )


def with_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows in the declared shape; one that breaks the declaration stops the job, nothing is blanked out.

    `split_by_schema` sets such rows aside instead.
    """
    present = set(df.columns)

    def checked(f: T.StructField) -> Column:
        if f.name not in present:
            return F.lit(None).cast(f.dataType) if f.nullable else F.raise_error(F.lit(f"{f.name}: missing")).cast(f.dataType)
        raw, value = F.col(f.name), F.col(f.name).try_cast(f.dataType)
        breaks = value.isNull() if not f.nullable else raw.isNotNull() & value.isNull()
        text = F.concat(F.lit(f"{f.name} takes no such value: "), F.coalesce(raw.cast("string"), F.lit("NULL")))
        return F.when(breaks, F.raise_error(text).cast(f.dataType)).otherwise(value)

    return df.select(*[checked(f).alias(f.name) for f in schema.fields])


def empty_like(spark: SparkSession, ddl: str) -> DataFrame:
    """A table without rows of the declared shape."""
    return spark.createDataFrame([], ddl)


def write_table(
    df: DataFrame,
    ns: str,
    name: str,
    fmt: str = "parquet",
    *,
    partition_by: Iterable[str] = (),
    buckets: tuple[int, str] | None = None,
    replace_schema: bool = True,
) -> None:
    """Overwrite a table with the rows of `df`; running it twice leaves the same table.

    `buckets`, a number and a column, lays the table out by the hash of that column: tables with the same buckets are
    joined and grouped on it without a shuffle.
    """
    writer = df.write.mode("overwrite").format(fmt)
    if replace_schema and fmt == "delta":
        writer = writer.option("overwriteSchema", "true")
    columns = list(partition_by)
    if columns:
        writer = writer.partitionBy(*columns)
    if buckets:
        writer = writer.bucketBy(*buckets).sortBy(buckets[1])
    writer.saveAsTable(f"{ns}.{name}")


def reset_layer(spark: SparkSession, ns: str, retired: Iterable[str] = ()) -> None:
    """A namespace for plain tables, without those named as retired. `Layer` rebuilds a layer as a whole."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {ns}")
    for name in retired:
        spark.sql(f"DROP TABLE IF EXISTS {ns}.`{name}`")


class Layer:
    """A layer whose tables are rebuilt as a whole: each build fills a namespace of its own, and the layer's names are views
    on the build in force.

    ```
    with Layer(spark, "gold").rebuild() as build:   # a namespace such as gold__v7
        write_table(df, build, "sales")
    ```

    The views move to the new build when the block ends well; then names that it does not have disappear, and builds
    older than the one before it, which readers may still be in, are dropped. A build that fails leaves every name on the
    old rows, and its own tables go with the next one.
    """

    def __init__(self, spark: SparkSession, ns: str) -> None:
        self.spark, self.ns = spark, ns

    def builds(self) -> list[int]:
        """Numbers of the builds that exist, whole or not."""
        names = [r[0].rpartition(".")[2] for r in self.spark.sql(f"SHOW DATABASES LIKE '{self.ns}__v*'").collect()]
        ends = [n.removeprefix(f"{self.ns}__v".lower()) for n in (x.lower() for x in names)]
        return sorted(int(e) for e in ends if e.isdigit())

    def current(self) -> int | None:
        """The build in force."""
        if not self.spark.catalog.databaseExists(self.ns):
            return None
        found = self.spark.sql(f"DESCRIBE DATABASE EXTENDED {self.ns}").where("info_name = 'Properties'").first()
        number = re.search(r"\(build,(\d+)\)", found[1] if found else "")
        return int(number[1]) if number else None

    @contextmanager
    def rebuild(self) -> Iterator[str]:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.ns}")
        number = max([0, *self.builds()]) + 1
        build = f"{self.ns}__v{number}"
        self.spark.sql(f"CREATE DATABASE {build}")
        yield build
        self._switch(build, number)

    def _switch(self, build: str, number: int) -> None:
        before = self.current()
        names = [r.tableName for r in self.spark.sql(f"SHOW TABLES IN {build}").collect() if not r.isTemporary]
        have = [r.tableName for r in self.spark.sql(f"SHOW TABLES IN {self.ns}").collect() if not r.isTemporary]
        views = {r.viewName for r in self.spark.sql(f"SHOW VIEWS IN {self.ns}").collect() if not r.isTemporary}
        for name in names:
            if name in have and name not in views:  # a table from before there were builds
                self.spark.sql(f"DROP TABLE {self.ns}.`{name}`")
            self.spark.sql(f"CREATE OR REPLACE VIEW {self.ns}.`{name}` AS SELECT * FROM {build}.`{name}`")
        self.spark.sql(f"ALTER DATABASE {self.ns} SET DBPROPERTIES ('build' = '{number}')")
        for name in set(have) - set(names):
            self.spark.sql(f"DROP {'VIEW' if name in views else 'TABLE'} IF EXISTS {self.ns}.`{name}`")
        for old in self.builds():
            if old not in (number, before):
                self.spark.sql(f"DROP DATABASE IF EXISTS {self.ns}__v{old} CASCADE")


def register_model(spark: SparkSession, silver: str, gold: str, views: str | None = None) -> list[str]:
    """Views over the tables that reports read; returns their names.

    In a namespace `views` they are part of the catalog and outlive the job; without one they end with the session.
    """
    sources = [(silver, name) for name in REPORT_SILVER] + [(gold, name) for name in REPORT_GOLD + AFFINITY_GOLD]
    if views:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {views}")
    for ns, name in sources:
        if views:
            spark.sql(f"CREATE OR REPLACE VIEW {views}.`{name}` AS SELECT * FROM {ns}.`{name}`")
        else:
            read_table(spark, ns, name).createOrReplaceTempView(name)
    return [name for _, name in sources]

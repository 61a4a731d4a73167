"""From raw documents to packed token sequences, in five stages over the whole corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. `run` writes every result as Parquet in the shared
folder and hands it to the next stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import jaccard, language, leaks, packing, substrings
from shelfline.llm.frames import fold, freed, small_batches, table
from shelfline.session import scratch_dir, stored

# Tokenizers, learned models and suffix automata have no SQL
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """A stage whose text goes to Python workers in small batches, and whose shuffle files go with their queries: the
    workers, the executors and their disks serve all stages in turn."""
    return wraps(stage)(lambda spark, docs, sf_dir: stage(freed(small_batches(spark)), docs, sf_dir))


def free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """The documents with a unique key in the order of their ids: the id itself where every row has one of its own.

    Otherwise the rows are written once, in the order of id (null last) and text, and numbered.
    """
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    placed = docs.withColumn(key, F.monotonically_increasing_id())  # so that equal rows need not lie in one task
    placed = placed.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), key)
    return stored(placed.withColumn(key, F.monotonically_increasing_id()), "keyed")


def texts_of(rows: DataFrame, key: str) -> DataFrame:
    """Key and text alone: what the operators read, without names of the input that could clash with theirs."""
    return rows.select(F.col(key).alias("doc_id"), "text")


@bounded
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter go, those in several languages stay."""
    model = language.fit(docs.where(fold(F.col("doc_id")) != 2))
    into = free(docs, "_language")
    found = language.label(docs, model, into=into, spans=False)
    return found.where(F.col(f"{into}.lang_pred") != language.UNKNOWN).select(*docs.columns)


@bounded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id; a row without a word stays.

    Rows count one by one, whether or not their id is null or repeated; a null id comes after all others.
    """
    key = free(docs, "_key")
    rows = keyed(docs, key)
    groups = jaccard.near_groups(texts_of(rows, key)).where("doc_id = component_id").select(F.col("doc_id").alias(key))
    return rows.join(groups, key, "left_semi").select(*docs.columns)


@bounded
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that also stand earlier; n_chars follows; a document of nothing else goes."""
    key = free(docs, "_key")
    rows = keyed(docs, key)
    kept = substrings.cut_out(rows, substrings.repeated_spans(texts_of(rows, key)), id_col=key)
    return kept.withColumn("n_chars", F.length("text").cast("long")).where("text IS NOT NULL AND n_chars > 0").select(*docs.columns)


@bounded
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark."""
    key = free(docs, "_key")
    rows = keyed(docs, key)
    leaked = leaks.find_leaks(texts_of(rows, key), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(leaked, key, "left_anti").select(*docs.columns)


@bounded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

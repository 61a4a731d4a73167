"""One query per operator, over whole tables, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import alignment, jaccard, language, leaks, licenses, negatives, packing, quality, substrings, swaps, urls, vectors, warc
from shelfline.llm.frames import fold, freed, small_batches, table
from shelfline.session import scratch_dir

# Fixed values
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
GOOD = 0.7


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License statements of all documents: where the base phrases stand, and the labels of base phrases and rules."""
    found = licenses.scan(table(spark, folder, "documents").select("doc_id", "text"), PHRASES)
    base = F.filter("licenses.found", lambda x: x.phrase)
    return found.select("doc_id", F.col("licenses.n_words").alias("n_words"), F.col("licenses.found").alias("found"), base.alias("base")).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct("found.label")), ",").alias("labels"),
        F.coalesce(F.array_max("found.certainty"), F.lit(0.0)).alias("score"),
    )


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(table(spark, folder, "documents"))


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each document without the windows of 20 words that also start earlier."""
    kept = substrings.without_repeats(table(spark, folder, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors of a label with a cosine of at least 0.98."""
    return vectors.near_links(table(spark, folder, "embeddings"), threshold=0.98)


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of all documents, by a model that never saw the documents held out."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.fit(documents, labels.where(fold(F.col("doc_id")) != 2))
    found = quality.score(documents, model)
    return found.select(
        "doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted")
    )


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as WARC records, read back from the archive."""
    archive = warc.stored(warc.write(table(spark, folder, "pages")), scratch_dir(spark, "warc"))
    return warc.read(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents linked by a similarity of at least 0.75 on five-word shingles."""
    return jaccard.near_groups(table(freed(small_batches(spark)), folder, "documents"), words=5, percent=75)


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on the URLs of all pages: by rule, else by the model."""
    found = urls.judge(table(spark, folder, "pages"), URL_RULES, urls.train(spark))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Where documents hold an item of the benchmark, with up to a fifth of its words edited."""
    return leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Main language of each document, by a model that never saw the documents held out."""
    documents = table(spark, folder, "documents")
    model = language.fit(documents.where(fold(F.col("doc_id")) != 2))
    found = language.label(documents.select("doc_id", "text"), model, spans=False)
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "language.lang_pred", "language.score")


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, with every seventh label moved on by one."""
    rows = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(moved, F.col("vec_id") % 100 == 0)


def op12_swap_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in as few sequences of 2048 tokens as a local search finds."""
    return swaps.pack(table(spark, folder, "documents"))


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers, over all documents."""
    found = alignment.alignment(table(spark, folder, "documents"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_packing": op2_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_quality": op5_quality,
    "op6_warc": op6_warc,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_url_filter": op8_url_filter,
    "op9_decontamination": op9_decontamination,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_swap_packing": op12_swap_packing,
    "op13_alignment": op13_alignment,
}

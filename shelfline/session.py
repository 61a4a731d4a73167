"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that may be changed on a running session. Joins of a fact with a key that holds a large share of the rows
# rely on the adaptive skew join; "force" lets Spark split such a partition even when the next step then needs one
# more shuffle, which is far cheaper than one task with a third of the data.
# A shuffle partition of 16 MB takes a few hundred MB in the sorts and hash tables of its task, whatever the table's size.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.parquet.compression.codec": "zstd",
}


# Temporary folders of local sessions, by application; removed when Python ends
_LOCAL: dict[str, tempfile.TemporaryDirectory] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the plans in this library count on."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside go when their query ends, not when the driver collects its garbage.

    For queries that are run once: what runs a second time would have to shuffle again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def build_session(app_name: str = "shelfline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; `conf` keys use `__` for the dots of a Spark setting."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.getOrCreate())


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder named in `spark.checkpoint.dir`, which all executors share.

    Only a local session without that setting gets a temporary folder of its own. On a cluster such a folder would be
    another one on every machine, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.TemporaryDirectory(prefix="shelfline-", ignore_cleanup_errors=True)
        base = _LOCAL[app].name
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result to the shared scratch folder and read it back.

    For rows that several branches of a plan use: they are computed once, survive the loss of an executor, and their
    true size is known when the joins above them are planned.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

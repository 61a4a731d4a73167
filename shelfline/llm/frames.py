"""Small helpers around DataFrames: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.session import scratch_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there.

    The folder is the one the session names in `spark.checkpoint.dir`; a local session without it gets a folder of its
    own. Spark removes the files once nothing refers to them, where its cleaner is told to.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def small_batches(spark: SparkSession) -> SparkSession:
    """Rows go to Python workers a few MB at a time, as well as at most 10,000: a batch stands in the JVM and in the worker,
    on its way in and on its way out, in every task, and what was once taken up is not given back to the system."""
    spark.conf.set(*BATCH_BYTES)
    return spark


FREED = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def freed(spark: SparkSession) -> SparkSession:
    """Shuffle files go when the query that wrote them ends. Else they stay until the driver collects its garbage, and an
    operator of many queries fills the disks with shuffles that nothing reads any more."""
    spark.conf.set(*FREED)
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(key: Column) -> Column:
    """The remainder that keeps rows out of every training set where it is 2; a null key counts as an empty one."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4


BITS = 1 << 23  # of a sieve: 1 MB, whatever the number of ids


def sieve(ids: DataFrame) -> np.ndarray:
    """A bitmap of BITS bits with one set for each id: what it lacks is none of the ids."""
    place = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(BITS))
    rows = ids.select(F.floor(place / 32768).cast("int").alias("part"), (place % 32768).alias("bit"))
    bits = np.zeros(BITS // 8, np.uint8)
    for row in rows.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        bits[row.part * 4096 : (row.part + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    return bits


def sifted(df: DataFrame, id_col: str, bits: np.ndarray, inside: bool = True) -> DataFrame:
    """Rows whose id may be (or, not inside, surely is not) one of the sieve's.

    Keeps text that no join will need out of a shuffle. The sieve is of one size: with very many ids it holds back
    less, never wrongly.
    """

    def pick(batches):
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array(hit == (1 if inside else 0)))

    placed = df.withColumn("_place", F.pmod(F.xxhash64(F.col(id_col)), F.lit(BITS)))
    return placed.mapInArrow(pick, df.schema)


FOREST = 1 << 19  # links that one task contracts at once, about


def _forest(batches):
    """The links of a task, contracted: (root, node) for each node, root being the smallest the task can reach."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = parent.setdefault(x, x)
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 100_000):
        some = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_pydict({"a": [parent[x] for x in some], "b": some}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node that can be reached.

    Each task contracts its share of the links to a forest. While there is more than one share, large-star and
    small-star steps alternate with that: each links a node's neighbours to the smallest of them, so hubs never gather
    their neighbours in one task, and a handful of rounds is enough whatever the length of the chains.
    """
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    shares = max(1, -(-edges.count() // FOREST))
    edges = cut(edges.coalesce(shares).mapInArrow(_forest, "a long, b long"))
    before = None
    for _ in range(rounds if shares > 1 else 0):
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = large.where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("a"), F.col("a").alias("b")).union(small.select("m", "b")).toDF("a", "b")
        edges = cut(small.where("a < b").distinct().coalesce(shares).mapInArrow(_forest, "a long, b long").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        if shares > 1:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a")).distinct()

"""Hard negatives: for each anchor its best positives, and for each positive the best negatives within a band below it.

Components become integers, so scores are exact. Anchors are dealt to shares and candidates to blocks; a task holds one
share and one block. It clusters its anchors and sorts the block once per cluster, by what the angle between a candidate
and the cluster's center allows a member to score at most. Every member walks that list, a stretch at a time, until what
it holds beats all that can follow. The first pass looks for positives among the rows of an anchor's label, the second
for negatives among all rows, with the positives' scores as bands. The best of each block meet in a ranking per anchor.

Of equal vectors of one label only those with the smallest ids can be among the best, as ties go to smaller ids: no more
of them are candidates than are asked for, and one for the anchor itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.frames import cut

BLOCK = 1 << 14  # candidates of a block, about
SHARE = 1 << 12  # anchors of a share, about
BYTES = 16 << 20  # of the vectors of either, about
CLUSTER = 64  # anchors of a cluster, about
MOST_TASKS = 1 << 16  # of a pass; groups beyond it share tasks
STRETCH = 512  # candidates that a cluster walks at once
SLACK = 1e-6  # of angles
EXACT = 1 << 53  # products below it are exact in double precision
MOST = (1 << 63) - 1

ROWS = "key long, id long, label string, anchor boolean, vector binary"
FOUND = "anchor long, wanted long, key long, id long, score long"


def _valid(batches, scale: float):
    names, kinds = ["key", "id", "label", "anchor", "vector"], [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    for batch in batches:
        rows = []
        for key, i, label, anchor, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if i is None or label is None or values is None or any(v is None for v in values):
                continue
            vector = np.floor(np.array(values, np.float64) * scale)
            if np.isfinite(vector).all():
                rows.append((key, i, label, bool(anchor), (vector + 0.0).tobytes()))
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.float64) for b in blobs]) if blobs else np.zeros((0, 0))


def _products(a: np.ndarray, b: np.ndarray, longest: float) -> np.ndarray:
    """Inner products; in whole numbers of any size where doubles would round."""
    if longest < EXACT:
        return a @ b.T
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    return np.array([[sum(x * y for x, y in zip(u, v, strict=True)) for v in whole[1]] for u in whole[0]], object).reshape(len(a), len(b))


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def clusters(units: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the members of each cluster, by k-means on directions."""
    k = -(-len(units) // CLUSTER)
    random = np.random.default_rng(7)
    centers = units[np.sort(random.permutation(len(units))[:k])]
    for _ in range(6 if k > 1 else 0):
        home = (units @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, home, units)
        centers = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-9, _unit(sums), centers)
    home = (units @ centers.T).argmax(axis=1)
    return [np.flatnonzero(home == c) for c in range(k) if (home == c).any()]


def bounds(members: np.ndarray, candidates: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """What a member of norm 1 can score with each candidate at most.

    Seen from the members' center, the angle between a member and a candidate is at least that of the candidate less
    the largest of a member.
    """
    center = _unit(members.sum(axis=0, keepdims=True))[0]
    if not center.any():
        return norms * (1 + 1e-9)
    some = members.any(axis=1)  # a member without a direction scores 0 with all
    widest = np.arccos(np.clip(members[some] @ center, -1.0, 1.0)).max(initial=0.0)
    angles = np.arccos(np.clip(_unit(candidates) @ center, -1.0, 1.0))
    return norms * (np.cos(np.maximum(0.0, angles - widest - SLACK)) + 1e-9)


class Best:
    """The best candidates of one anchor in one band: higher scores first, then smaller ids."""

    def __init__(self, number: int, low: int | None, high: int | None) -> None:
        self.number, self.low, self.high = number, low, high
        self.rows: list[tuple] = []  # (-score, id, key), ascending

    def open(self, bound: float) -> bool:
        """Could a candidate that scores up to `bound` still count?"""
        if self.low is not None and (bound < self.low or self.low > self.high):
            return False
        return len(self.rows) < self.number or bound >= -self.rows[-1][0]

    def take(self, scores: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        inside = np.ones(len(scores), bool) if self.low is None else (scores >= self.low) & (scores <= self.high)
        if len(self.rows) == self.number:
            inside &= scores >= -self.rows[-1][0]
        at = np.flatnonzero(inside)
        if len(at) > self.number:
            at = at[np.lexsort((keys[at], ids[at], -scores[at]))[: self.number]]
        if len(at):
            new = [(-int(scores[i]), int(ids[i]), int(keys[i])) for i in at]
            self.rows = sorted(self.rows + new)[: self.number]


def _walk(table: pa.Table, number: int, band: tuple[int, int] | None) -> pa.Table:
    """The best of a block for each anchor of a share: of its label, or, given bands, of other labels inside each."""
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    anchors, block = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
    block = block.sort_by([("id", "ascending"), ("key", "ascending")])
    out: list[tuple] = []
    if len(anchors) and len(block):
        asking, members = anchors.sort_by("key"), _matrix(anchors.sort_by("key").column("vector").to_pylist())
        vectors = _matrix(block.column("vector").to_pylist())
        ids, keys, labels = (block.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key", "label"))
        own, own_labels = asking.column("key").to_numpy(), asking.column("label").to_pylist()
        bands = asking.column("wanted").to_pylist()
        sizes, norms = np.linalg.norm(members, axis=1), np.linalg.norm(vectors, axis=1)
        longest, units = sizes.max() * norms.max(), _unit(members)
        for cluster in clusters(units):
            limits = bounds(units[cluster], vectors, norms)
            order = np.argsort(-limits, kind="stable")
            limits = limits[order]
            best = {}
            for m in cluster.tolist():
                if band is None:
                    best[m] = {0: Best(number, None, None)}
                else:
                    best[m] = {p: Best(number, -(-band[0] * p // 100), band[1] * p // 100) for p in bands[m]}
            active = cluster.tolist()
            for at in range(0, len(order), STRETCH):
                active = [m for m in active if any(b.open(sizes[m] * limits[at]) for b in best[m].values())]
                if not active:
                    break
                some = order[at : at + STRETCH]
                for m, scores in zip(active, _products(members[active], vectors[some], longest), strict=True):
                    usable = keys[some] != own[m] if band is None else labels[some] != own_labels[m]
                    for b in best[m].values():
                        b.take(scores[usable], ids[some][usable], keys[some][usable])
            out += [(int(own[m]), p, key, i, max(-MOST, min(MOST, -s))) for m, of in best.items() for p, b in of.items() for s, i, key in b.rows]
    columns = list(zip(*out, strict=True)) or [[]] * 5
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor", "wanted", "key", "id", "score"])


def _dealt(candidates: DataFrame, anchors: DataFrame, by: Column) -> DataFrame:
    """Candidates and anchors of the same kind, once for each share and once for each block."""
    full = F.least(F.lit(BYTES) / F.greatest(F.lit(1), F.octet_length("vector")), F.lit(BLOCK))
    most = F.greatest(F.lit(1), F.least(F.lit(BYTES) / F.greatest(F.lit(1), F.octet_length("vector")), F.lit(SHARE)))
    candidates, anchors = candidates.withColumn("kind", by), anchors.withColumn("kind", by)
    blocks = candidates.groupBy("kind").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.first(full))).cast("int").alias("blocks"))
    shares = anchors.groupBy("kind").agg(F.ceil(F.count("*") / F.first(most)).cast("int").alias("shares"))
    sizes = blocks.join(shares, "kind")  # a kind without an anchor is asked nothing
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    columns = ["key", "id", "label", "vector", "wanted"]
    held = candidates.withColumn("wanted", F.lit(None).cast("array<long>")).join(sizes, "kind").select(
        "kind", (place % F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
        F.lit(False).alias("asks"), *columns
    )
    asking = anchors.join(sizes, "kind").select(
        "kind", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), (place % F.col("shares")).cast("int").alias("share"),
        F.lit(True).alias("asks"), *columns
    )
    # a task per group: the work grows with the product of both sides, so Spark must not merge groups by their bytes
    groups = sizes.agg(F.sum(F.col("blocks") * F.col("shares"))).first()[0] or 1
    return held.union(asking).repartition(min(groups, MOST_TASKS), "kind", "block", "share")


def _best(dealt: DataFrame, number: int, band: tuple[int, int] | None) -> DataFrame:
    found = dealt.groupBy("kind", "block", "share").applyInArrow(lambda t: _walk(t, number, band), FOUND)
    first = Window.partitionBy("anchor", "wanted").orderBy(F.desc("score"), "id", "key")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= number)


def hard_negatives(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 5, band: tuple[int, int] = (80, 100), scale: float = 256.0,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), ranks from 1 per anchor and positive.

    A component x counts as floor(scale * x), a score is the inner product of two rows. An anchor's positives are the
    `positives` best other rows of its label; its negatives for one of them the `negatives` best rows of other labels
    with a score between band[0] and band[1] percent of the positive's. Ties go to the smaller id. All are taken where
    there are fewer; a positive without a negative has no row.

    Rows with a null id, label or vector, with a null or non-finite component, or one that the scale makes infinite,
    take no part. Vectors of different lengths never meet; vectors without a component score 0. Rows that repeat an id
    count one by one, in no fixed order between equal ones. Scores beyond 64 bits are given as the largest one. An
    empty table, or one without an anchor, gives an empty one; other columns are ignored.
    """
    plain = rows.select(
        F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long"), F.col(label_col).cast("string"), anchor, F.col(vector_col).cast("array<double>")
    )
    valid = cut(plain.mapInArrow(lambda it: _valid(it, scale), ROWS))
    copy = F.row_number().over(Window.partitionBy("label", "vector").orderBy("id", "key"))
    candidates = cut(valid.withColumn("copy", copy).where(F.col("copy") <= max(positives + 1, negatives)).drop("copy", "anchor"))
    anchors = valid.where("anchor").drop("anchor")
    size = F.octet_length("vector")
    asked = anchors.withColumn("wanted", F.array(F.lit(0).cast("long")))
    near = cut(_best(_dealt(candidates, asked, F.concat_ws(":", size, "label")), positives, None).select(
        "anchor", F.col("id").alias("positive_id"), F.col("rank").alias("place"), F.col("score").alias("positive_score")
    ))
    wanted = near.groupBy(F.col("anchor").alias("key")).agg(F.collect_set("positive_score").alias("wanted"))  # at most `positives`
    far = _best(_dealt(candidates, anchors.join(wanted, "key"), size.cast("string")), negatives, band).select(
        "anchor", F.col("wanted").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    ids = anchors.select(F.col("key").alias("anchor"), F.col("id").alias("anchor_id"))
    return near.join(far, ["anchor", "positive_score"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )

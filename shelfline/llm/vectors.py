"""Near-duplicate vectors: a robust-pruned flat graph, searched from medoids, with verified links.

Equal vectors of a label are one node. Centers, fitted per label on a sample that grows with it, cut the nodes of a label
into cells; a cell too large for one task is dealt out in blocks by a hash. The graph is built on overlapping shards: each
node takes part in a block of its nearest and of its second nearest cell, where it gets a few diverse neighbours (robust
pruning, with some far ones so that groups of near copies stay tied to the rest). The adjacency lists of all shards are
united.

A node can only link into cells whose members lie, seen from the center, within the threshold's angle of its own (the
triangle inequality); it visits the blocks of all of these, in parts, so that a task holds one block and one part,
whatever the size of the cell. There its search starts from the medoids of the connected parts of the block's graph, and
from its own place where it has one, walks greedily to where it can come no nearer, and goes on through all nodes within
range until no more turn up. Every link is verified in double precision. `audit` compares the links of every twentieth
vector with all vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm import frames

SHARD = 16384  # nodes of a block, and of a part, about
BYTES = 8 << 20  # of their vectors, about
CENTERS = 2048  # of a label, at most: cells beyond it are larger and have more blocks
MOST_CENTERS = 1 << 16  # of all labels together, about: they are sent to all tasks
DEGREE = 24  # neighbours of a node in a shard
POOL = 64  # nearest nodes among which they are chosen
FAR = 4  # neighbours of a node anywhere in its shard
ALPHA = 1.2  # how much closer a neighbour has to be to a candidate to replace it
BEAM = 32  # nodes that a walk keeps
WIDER = 1.25  # how far beyond the threshold's angle a search still goes on
SAMPLE = 8  # vectors for each center on which the centers are fitted, about
TILE = 1 << 22  # similarities that a task holds at once
SLACK = 1e-6  # of angles

NODES = "vec_id long, label string, vector binary"


def _valid(batches):
    for batch in batches:
        ids, labels, vectors = [], [], []
        for i, label, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if i is None or label is None or not values or any(v is None for v in values):
                continue
            vector = np.array(values, np.float64)
            norm = np.linalg.norm(vector) if np.isfinite(vector).all() else 0.0
            if norm > 0 and np.isfinite(norm):
                ids.append(i), labels.append(label), vectors.append((vector + 0.0).tobytes())
        yield pa.RecordBatch.from_pydict(
            {"vec_id": ids, "label": labels, "vector": vectors}, pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("vector", pa.binary())])
        )


def _unit(blobs: list[bytes]) -> np.ndarray:
    rows = np.stack([np.frombuffer(b, np.float64) for b in blobs])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _nearest(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    step = max(1, TILE // len(centers))
    return np.concatenate([(vectors[i : i + step] @ centers.T).argmax(axis=1) for i in range(0, len(vectors), step)])


def _centers(table: pa.Table) -> pa.Table:
    """Centers of one kind of vector, by k-means on a sample."""
    vectors = _unit(table.sort_by("node").column("vector").to_pylist())
    k = min(len(vectors), table.column("centers")[0].as_py())
    random = np.random.default_rng(3)
    centers = vectors[random.permutation(len(vectors))[:k]]
    for _ in range(8):
        sums = np.zeros_like(centers)
        np.add.at(sums, _nearest(vectors, centers), vectors)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centers)
    kind = table.column("kind")[0].as_py()
    return pa.table({"kind": pa.array([kind] * k, pa.string()), "center": pa.array([c.tobytes() for c in centers], pa.binary())})


def _angles(batch: pa.RecordBatch, centers: dict[str, np.ndarray]):
    """(row numbers, angles to all centers of their kind) of the rows whose kind has centers, some at a time."""
    kinds = np.array(batch.column(1).to_pylist(), object)
    for kind in set(kinds) & set(centers):
        rows = np.flatnonzero(kinds == kind)
        step = max(1, TILE // len(centers[kind]))
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            yield kind, some, np.arccos(np.clip(_unit(batch.column(2).take(pa.array(some)).to_pylist()) @ centers[kind].T, -1.0, 1.0))


def _assigned(batches, centers: dict[str, np.ndarray]):
    """The rows with the number of their nearest and second nearest center, and the angle to the nearest."""
    for batch in batches:
        cell, second, angle = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
        for _, rows, angles in _angles(batch, centers):
            cell[rows], angle[rows] = angles.argmin(axis=1), angles.min(axis=1)
            if angles.shape[1] > 1:
                angles[np.arange(len(rows)), cell[rows]] = np.inf
                second[rows] = angles.argmin(axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(second), pa.array(angle)], [*batch.schema.names, "home", "second", "angle"])


def _visits(batches, centers: dict[str, np.ndarray], rings: dict[str, np.ndarray], angle: float):
    """The rows once for each cell in which they may have a link, their own among them."""
    for batch in batches:
        kinds = np.array(batch.column(1).to_pylist(), object)
        home = batch.column(4).to_numpy()
        at, cells = [np.flatnonzero([k not in centers for k in kinds])], []
        cells.append(home[at[0]])
        for kind, rows, angles in _angles(batch, centers):
            low, high = rings[kind]
            near = (angles <= high + angle + SLACK) & (angles >= low - angle - SLACK)
            near[np.arange(len(rows)), home[rows]] = True
            row, cell = np.nonzero(near)
            at.append(rows[row]), cells.append(cell)
        at, cells = np.concatenate(at).astype(np.int64), np.concatenate(cells).astype(np.int32)
        for i in range(0, len(at), 1 << 14):
            some = batch.take(pa.array(at[i : i + (1 << 14)]))
            yield pa.RecordBatch.from_arrays([*some.columns[:5], pa.array(cells[i : i + (1 << 14)])], [*some.schema.names[:5], "cell"])


def prune(near: np.ndarray, away: np.ndarray, apart: np.ndarray) -> list[int]:
    """Places in `near` of the neighbours of a node: nearest first, without those a chosen one is much closer to.

    `away` are the distances of the candidates from the node, ascending, `apart` those between them.
    """
    alive, chosen = np.ones(len(near), bool), []
    while len(chosen) < DEGREE and alive.any():
        first = int(alive.argmax())
        alive[first] = False
        chosen.append(first)
        alive &= ALPHA * apart[first] > away
    return chosen


def _lists(table: pa.Table) -> pa.Table:
    """Adjacency lists of one shard, both ways, so that walks can turn."""
    table = table.sort_by("node")
    nodes, vectors = table.column("node").to_numpy(), _unit(table.column("vector").to_pylist())
    n, random = len(nodes), np.random.default_rng(11)
    pool, step = min(POOL, n - 1), max(1, TILE // n)
    sources, targets = [], []
    for i in range(0, n if n > 1 else 0, step):
        similar = vectors[i : i + step] @ vectors.T
        similar[np.arange(len(similar)), np.arange(i, i + len(similar))] = -np.inf
        nearest = np.argpartition(-similar, pool - 1, axis=1)[:, :pool]
        far = random.integers(0, n, (len(similar), FAR))
        for k, row in enumerate(similar):
            near = nearest[k][np.lexsort((nearest[k], -row[nearest[k]]))]
            chosen = near[prune(near, 1.0 - row[near], 1.0 - vectors[near] @ vectors[near].T)]
            chosen = np.append(chosen, far[k][far[k] != i + k])
            sources.append(np.full(len(chosen), i + k)), targets.append(chosen)
    source, target = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sources, targets))
    both = np.unique(np.concatenate([source * n + target, target * n + source]))
    return pa.table({"node": pa.array(nodes[both // max(1, n)], pa.int64()), "other": pa.array(nodes[both % max(1, n)], pa.int64())})


class Graph:
    """The members of a block with their neighbours, and an entry for each connected part."""

    def __init__(self, vectors: np.ndarray, nodes: np.ndarray, others: list[list[int] | None]) -> None:
        self.vectors = vectors
        sizes = np.array([len(x or ()) for x in others], np.int64)
        wanted = np.fromiter((o for x in others for o in x or ()), np.int64, int(sizes.sum()))
        place = np.minimum(np.searchsorted(nodes, wanted), max(0, len(nodes) - 1))
        here = nodes[place] == wanted if len(nodes) else np.zeros(0, bool)
        source = np.repeat(np.arange(len(nodes)), sizes)[here]
        self.targets = place[here]
        self.first = np.append(0, np.cumsum(np.bincount(source, minlength=len(nodes))))
        self.entries = self._entries()

    def after(self, some: np.ndarray) -> np.ndarray:
        """Neighbours of some nodes."""
        parts = [self.targets[self.first[i] : self.first[i + 1]] for i in some.tolist()]
        return np.unique(np.concatenate(parts)) if parts else some

    def _entries(self) -> np.ndarray:
        """The medoid of each connected part."""
        part, found = np.full(len(self.vectors), -1), []
        for start in range(len(self.vectors)):
            if part[start] >= 0:
                continue
            frontier = np.array([start])
            part[start] = start
            while len(frontier):
                frontier = self.after(frontier)
                frontier = frontier[part[frontier] < 0]
                part[frontier] = start
            inside = np.flatnonzero(part == start)
            found.append(inside[(self.vectors[inside] @ self.vectors[inside].mean(axis=0)).argmax()])
        return np.array(found, np.int64)

    def near(self, query: np.ndarray, own: int, threshold: float, wide: float) -> np.ndarray:
        """Members within the threshold of the query: a greedy walk from all entries, then outwards through what is in
        the wider range."""
        starts = self.entries if own < 0 else np.unique(np.append(self.entries, own))
        seen = np.zeros(len(self.vectors), bool)
        seen[starts] = True
        at, similar, done = starts, self.vectors[starts] @ query, np.zeros(len(starts), bool)
        while True:
            best = np.argsort(-similar, kind="stable")[:BEAM]
            some = best[~done[best]][:8]
            some = some if len(some) else np.flatnonzero(~done & (similar >= wide))
            if not len(some):
                return at[similar >= threshold]
            done[some] = True
            new = self.after(at[some])
            new = new[~seen[new]]
            seen[new] = True
            at, similar = np.append(at, new), np.append(similar, self.vectors[new] @ query)
            done = np.append(done, np.zeros(len(new), bool))


def _links(table: pa.Table, threshold: float) -> pa.Table:
    """Of a block and a part: the weight of each visitor's links into the block, and what ties nodes to a component."""
    table = table.sort_by("node")
    nodes, vectors, copies = table.column("node").to_numpy(), _unit(table.column("vector").to_pylist()), table.column("copies").to_numpy()
    inside, asking = (np.flatnonzero(table.column(c).to_numpy(zero_copy_only=False)) for c in ("member", "visitor"))
    graph = Graph(vectors[inside], nodes[inside], table.column("others").take(pa.array(inside)).to_pylist())
    own = np.full(len(nodes), -1)
    own[inside] = np.arange(len(inside))
    wide = float(np.cos(min(np.pi, WIDER * np.arccos(np.clip(threshold, -1.0, 1.0)))))
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    weights = np.zeros(len(nodes), np.int64)
    for q in asking.tolist() if len(inside) else []:
        near = inside[graph.near(vectors[q], int(own[q]), threshold - 1e-9, wide)]
        # by a sum that is the same in both directions
        near = [n for n in near.tolist() if n != q and float(np.dot(vectors[q], vectors[n])) >= threshold]
        weights[q] = copies[near].sum()
        for n in near:
            a, b = find(q), find(n)
            parent[max(a, b)] = min(a, b)
    tied = [i for i in range(len(nodes)) if find(i) != i]
    return pa.table({
        "node": pa.array(np.r_[nodes[asking], nodes[tied]], pa.int64()),
        "weight": pa.array(np.r_[weights[asking], np.zeros(len(tied), np.int64)], pa.int64()),
        "root": pa.array([None] * len(asking) + [int(nodes[find(i)]) for i in tied], pa.int64()),
    })


def _prepared(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    plain = rows.select(F.col(id_col).cast("long"), F.col(label_col).cast("string"), F.col(vector_col).cast("array<double>"))
    return plain.mapInArrow(_valid, NODES)


def _united(placed: DataFrame) -> DataFrame:
    """(node, others): the neighbours of each node, from the shards of its nearest and its second nearest cell.

    A shard is a block that is searched later, and the nodes of other cells that come second there.
    """
    places = F.array(F.col("home"), F.when(F.col("second") >= 0, F.col("second")))
    shards = placed.select("kind", "node", "vector", "home", F.explode(F.array_compact(places)).alias("cell"))
    own = F.count(F.when(F.col("cell") == F.col("home"), 1))
    blocks = shards.groupBy("kind", "cell").agg(F.greatest(F.lit(1), F.ceil(own / F.first(_shard()))).cast("int").alias("blocks"))
    dealt = shards.join(blocks, ["kind", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    edges = dealt.select("kind", "cell", "block", "node", "vector").groupBy("kind", "cell", "block").applyInArrow(_lists, "node long, other long")
    return frames.cut(edges.groupBy("node").agg(F.collect_set("other").alias("others")))  # of two shards at most


def _shard() -> Column:
    """Nodes that a block or a part of their kind has, about."""
    return F.greatest(F.lit(1), F.least(F.lit(SHARD), F.floor(F.lit(BYTES) / F.octet_length("vector"))))


def near_links(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each input row.

    Vectors link when their labels are equal and not null and their cosine is at least the threshold. Null, empty and
    zero vectors, those with a null or non-finite component, and rows without an id or label link with nothing. Vectors
    of different lengths never meet. Rows that repeat an id are told apart only by their vectors: their links are added
    up. Other columns are ignored.
    """
    valid = frames.cut(_prepared(rows, id_col, vector_col, label_col))
    nodes = valid.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    kind = F.concat_ws(":", F.octet_length("vector"), "label")
    nodes = frames.cut(nodes.select("node", kind.alias("kind"), "vector", "copies"))
    # kinds that one task can hold have one cell and no center
    counts = nodes.groupBy("kind").agg(F.count("*").alias("nodes"), F.first(_shard()).alias("shard")).where("nodes > shard")
    counts = frames.cut(counts.withColumn("centers", F.least(F.lit(CENTERS), F.ceil(F.col("nodes") / F.col("shard")))))
    every = counts.agg(F.sum("centers")).first()[0] or 1
    if every > MOST_CENTERS:  # larger cells, with more blocks
        counts = counts.withColumn("centers", F.ceil(F.col("centers") * (MOST_CENTERS / every))).where("centers > 1")
    counts = counts.withColumn("centers", F.col("centers").cast("int"))
    wanted = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) <= F.col("centers") * SAMPLE / F.col("nodes") * (1 << 30)
    sample = nodes.join(F.broadcast(counts), "kind").where(wanted).select("node", "kind", "vector", "centers")
    fitted: dict[str, list[np.ndarray]] = {}
    for row in sample.groupBy("kind").applyInArrow(_centers, "kind string, center binary").toLocalIterator():
        fitted.setdefault(row.kind, []).append(np.frombuffer(row.center, np.float64))
    centers = {k: np.stack(v) for k, v in fitted.items()}
    send = rows.sparkSession.sparkContext.broadcast(centers)  # MOST_CENTERS of them, about
    columns = "node long, kind string, vector binary, copies long, home int"
    placed = nodes.select("node", "kind", "vector", "copies").mapInArrow(lambda it: _assigned(it, send.value), f"{columns}, second int, angle double")
    placed = frames.cut(placed)
    lists = _united(placed)
    rings = {k: np.stack([np.full(len(c), np.inf), np.full(len(c), -np.inf)]) for k, c in centers.items()}  # empty cells have no visitors
    if centers:
        for row in placed.join(F.broadcast(counts), "kind").groupBy("kind", "home").agg(F.min("angle"), F.max("angle")).toLocalIterator():
            if row.kind in rings:
                rings[row.kind][:, row.home] = row[2], row[3]
    angle = float(np.arccos(np.clip(threshold, -1.0, 1.0)))
    around = rows.sparkSession.sparkContext.broadcast(rings)
    visits = placed.mapInArrow(lambda it: _visits(it, send.value, around.value, angle), f"{columns}, cell int")
    own = F.col("cell") == F.col("home")
    sizes = visits.groupBy("kind", "cell").agg(
        F.ceil(F.count(F.when(own, 1)) / F.first(_shard())).cast("int").alias("blocks"), F.ceil(F.count("*") / F.first(_shard())).cast("int").alias("parts")
    )
    dealt = visits.join(sizes, ["kind", "cell"])
    dealt = dealt.withColumns({"block": F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), "part": F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")})
    # a member stands in every part of its block; a visitor asks in one part of every block
    member = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda p: F.struct(F.col("block").alias("block"), p.alias("part"), F.lit(True).alias("member"), (p == F.col("part")).alias("visitor")),
    )
    asks = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: ~own | (b != F.col("block")))
    asks = F.transform(asks, lambda b: F.struct(b.alias("block"), F.col("part").alias("part"), F.lit(False).alias("member"), F.lit(True).alias("visitor")))
    dealt = dealt.select("kind", "cell", "node", "vector", "copies", F.explode(F.when(own, F.concat(member, asks)).otherwise(asks)).alias("at"))
    dealt = dealt.join(lists, "node", "left")  # of the members; visitors need none
    dealt = dealt.select("kind", "cell", "at.*", "node", "vector", "copies", F.when(F.col("at.member"), F.col("others")).alias("others"))
    found = frames.cut(
        dealt.groupBy("kind", "cell", "block", "part").applyInArrow(lambda t: _links(t, threshold), "node long, weight long, root long")
    )
    roots = frames.components(found.where("root IS NOT NULL").select(F.col("node").alias("a"), F.col("root").alias("b")))
    weights = found.groupBy("node").agg(F.sum("weight").alias("weight"))
    known = nodes.join(weights, "node", "left").join(roots, "node", "left")
    known = known.select("kind", "vector", (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    each = valid.withColumn("kind", kind).join(known, ["kind", "vector"]).groupBy("vec_id").agg(
        F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id")
    )
    ids = rows.select(F.col(id_col).cast("long").alias("vec_id"))
    out = ids.join(each, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def exact_counts(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, every: int = 20) -> DataFrame:
    """(vec_id, n_links) by comparison of every vector whose id is divisible by `every` with all of its label."""
    valid = _prepared(rows, id_col, vector_col, label_col)
    queries = valid.where(F.col("vec_id") % every == 0).toArrow()

    def compare(batches):
        labels = np.array(queries.column("label").to_pylist(), object)
        ids = queries.column("vec_id").to_numpy()
        sizes = np.array([len(v) for v in queries.column("vector").to_pylist()])
        for batch in batches:
            total = np.zeros(len(ids), np.int64)
            for i, label, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = np.flatnonzero((labels == label) & (sizes == len(blob)))
                if len(mine):
                    near = _unit([queries.column("vector")[int(q)].as_py() for q in mine]) @ _unit([blob])[0] >= threshold
                    total[mine[near & (ids[mine] != i)]] += 1
            yield pa.RecordBatch.from_pydict({"vec_id": ids, "n": total})

    return valid.mapInArrow(compare, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n_links"))


def audit(rows: DataFrame, found: DataFrame, **options) -> float:
    """Share of the links of every twentieth vector that `near_links` has found."""
    exact = exact_counts(rows, **options).withColumnRenamed("n_links", "wanted")
    both = found.join(exact, "vec_id").agg(F.sum(F.least("n_links", "wanted")), F.sum("wanted")).first()
    return 1.0 if not both[1] else both[0] / both[1]

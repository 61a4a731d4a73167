"""Near-duplicate groups by Jaccard similarity of word shingles, exact, by universe partition and pigeonhole.

Two sets of sizes t <= r with a similarity of at least c/100 differ in at most h = (t + r) * (100 - c) / (100 + c)
tokens. Hash the universe of tokens into more than h segments: some segment is then equal in both sets, or differs in
one token if enough segments also serve one-deletion neighbours. Each set is indexed by its non-empty segments, once per
size band that can hold its smaller partners. A set of the band it belongs to is *safe* when its non-empty segments,
counted twice where deletions are indexed, exceed its h; then no partner of its size or larger can be missed. The few
sets that are not safe by chance go through a prefix join instead, so no link is lost.

Costs steer what is compared: a set stays safe without as much of its segments as it has to spare, so it leaves out those
that most sets share, up to all of them. Members of a segment are not compared pair by pair: each is held against one of them, linked sets merge into
components, and members of components that segments still connect are compared in blocks: first by sketches of a bit for
each token, which are too far apart for most pairs, and by their tokens only in the blocks where sketches leave a pair open.

Sets are held as sorted 64-bit hashes of their shingles; equal sets share a class and are handled once.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm import frames
from shelfline.llm.text import SPACES, Words, mix, words_of

_U = np.uint64
GROWTH = 1.6  # of a size band
SPARE = 1.5  # segments, in terms of those that a full set of the band needs
LEVELS = np.array([1, 2, 3, 5, 8, 16, 32, 64, 128, 512, 2048, 8192, 65536, 1 << 24])  # steps of the members of a segment
BUCKET = 1 << 21  # shingles whose signatures are sorted at once, about
PASSES = 8  # of a task over its signatures at most, about: a set is named once in each task that has some of its own
BATCH = 1 << 19  # signatures that a task sorts at once, about
BLOCK = 512  # sets that one task holds against as many others
SKETCHED = 4096  # sketches that one task holds against as many others
SKETCH = 1 << 16  # bits of the largest sketch
HELD = 1 << 22  # members of shared segments that a task sums up at once, about

PROFILE = "doc_id long, n_shingles long, cls long, safe boolean, slack long"
BLOCKS = "bucket int, classes binary, counts binary, high binary, low binary"
FOUND = "a long, b long, weight long, level int, members binary"
SETS = "cls long, n int, tokens binary, sketch binary"


@lru_cache(maxsize=None)
def bands(percent: int, limit: int = 1 << 40) -> dict[str, np.ndarray]:
    """Per size band: its first size, number of segments, and how many of them index deletions."""
    first, segments, doubled = [1], [], []
    while first[-1] < limit:
        first.append(max(first[-1] + 1, int(np.ceil(first[-1] * GROWTH))))
    for top in (f - 1 for f in first[1:]):
        need = differ(np.array([top]), percent)[0] + 1
        m = int(np.ceil(SPARE * need))
        share = top / m
        one, two = 1 - np.exp(-share), 1 - np.exp(-share) * (1 + share)
        spread = np.sqrt(m * np.exp(-share) * (1 - (1 + share) * np.exp(-share)))
        segments.append(m)
        doubled.append(int(np.clip(np.ceil((need + 5 * spread + 2 - m * one) / two), 0, m)))
    return {"first": np.array(first[:-1]), "segments": np.array(segments), "doubled": np.array(doubled)}


def differ(size: np.ndarray, percent: int) -> np.ndarray:
    """Most tokens in which a set of this size and a linked one, as large or larger, can differ."""
    return (size + size * 100 // percent) * (100 - percent) // (100 + percent)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the index of each text's first one.

    A text with fewer than n words, but at least one, has a single shingle of all its words.
    """
    hashes = words.hashes()
    at, tokens = words.windows(hashes, n)
    texts = len(words.first) - 1
    owner = np.repeat(np.arange(texts), np.diff(words.first))[at]
    size = np.diff(words.first)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        owner, tokens = np.append(owner, short), np.append(tokens, words.whole(hashes)[short])
    order = np.lexsort((tokens, owner))
    owner, tokens = owner[order], tokens[order]
    fresh = np.ones(len(tokens), bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    owner, tokens = owner[fresh], tokens[fresh]
    return tokens, np.searchsorted(owner, np.arange(texts + 1))


def classes_of(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set, equal for equal sets."""
    return np.array(
        [
            int.from_bytes(hashlib.blake2b(tokens[a:b].tobytes(), digest_size=8).digest(), "little", signed=True)
            for a, b in zip(first[:-1], first[1:], strict=True)
        ],
        np.int64,
    )


def signatures(tokens: np.ndarray, first: np.ndarray, percent: int):
    """(owner, signature, kind) of all sets, and each set's capacity in its own band.

    kind: 1 for a segment less one token, 2 in the set's own band, 4 for a segment whose deletions are indexed too.
    """
    plan = bands(percent)
    size = np.diff(first)
    capacity = np.zeros(len(size), np.int64)
    own = np.searchsorted(plan["first"], size, "right") - 1
    lowest = np.searchsorted(plan["first"], -(-size * percent // 100), "right") - 1
    mixed = mix(tokens)
    found = []
    for back in range(int((own - lowest)[size > 0].max(initial=-1)) + 1):
        chosen = np.flatnonzero((size > 0) & (own - back >= lowest))
        if not len(chosen):
            continue
        owner = np.repeat(chosen, size[chosen])
        at = np.concatenate([np.arange(first[i], first[i + 1]) for i in chosen])
        band = own[owner] - back
        segment = ((tokens[at] >> _U(16)) % plan["segments"][band].astype(_U)).astype(np.int64)
        order = np.lexsort((segment, owner))
        owner, band, segment, value = owner[order], band[order], segment[order], mixed[at[order]]
        head = np.ones(len(owner), bool)
        head[1:] = (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1])
        start = np.flatnonzero(head)
        count = np.diff(np.append(start, len(owner)))
        total = np.add.reduceat(value, start)
        salt = mix((band.astype(_U) << _U(44)) + segment.astype(_U) + _U(1))
        twice = (segment[start] < plan["doubled"][band[start]]) & (count > 1)
        if back == 0:
            np.add.at(capacity, owner[start], 1 + twice)
        each = np.repeat(twice, count)
        dropped = np.repeat(total, count)[each] - value[each]
        found.append((owner[start], mix(total + salt[start]), 4 * twice + 2 * (back == 0)))
        found.append((owner[each], mix(dropped + salt[each]), np.full(each.sum(), 1 + 2 * (back == 0))))
    if not found:
        return (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)), capacity
    owner, signature, kind = (np.concatenate([x[i] for x in found]) for i in range(3))
    return (owner, signature, kind), capacity


def _profiles(batches, words: int, percent: int):
    for batch in batches:
        size, cls, safe, slack = [], [], [], []
        for _, _, w in words_of(batch.column(1), SPACES, lower=True):
            tokens, first = shingles(w, words)
            n = np.diff(first)
            _, capacity = signatures(tokens, first, percent)
            spare = capacity - differ(n, percent) - 1
            size.append(n), cls.append(classes_of(tokens, first)), safe.append((n == 0) | (spare >= 0)), slack.append(spare)
        if size:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.concatenate(x)) for x in (size, cls, safe, slack))],
                ["doc_id", "n_shingles", "cls", "safe", "slack"],
            )


def _blocks(batches, words: int, percent: int, buckets: int):
    parts, held, seen = [], 0, set()
    for batch in batches:
        for _, _, w in words_of(batch.column(1), SPACES, lower=True):
            tokens, first = shingles(w, words)
            cls = classes_of(tokens, first)
            fresh = np.zeros(len(cls), bool)  # a copy within the batch adds nothing
            for i, c in enumerate(cls.tolist()):
                fresh[i] = c not in seen
                seen.add(c)
            (owner, signature, kind), _ = signatures(tokens, first, percent)
            keep = fresh[owner]
            parts.append((cls[owner[keep]], signature[keep], kind[keep]))
            held += int(keep.sum())
            if held > BATCH:
                yield from _dealt(parts, buckets)
                parts, held = [], 0
            if len(seen) > BATCH:
                seen.clear()
    if parts:
        yield from _dealt(parts, buckets)


def _dealt(parts: list[tuple], buckets: int):
    cls, signature, kind = (np.concatenate([p[i] for p in parts]) for i in range(3))
    bucket = ((signature & _U(0xFFFF)).astype(np.int64) * buckets) >> 16
    order = np.lexsort((cls, bucket))
    bucket, cls, signature = bucket[order], cls[order], signature[order]
    high = (signature >> _U(32)).astype(np.uint32)
    low = ((signature >> _U(16)) & _U(0xF8)).astype(np.uint8) | kind[order].astype(np.uint8)
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
    rows = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        start = np.flatnonzero(np.r_[True, cls[a + 1 : b] != cls[a : b - 1]])
        counts = np.diff(np.append(start, b - a))
        counts = counts.astype(np.uint16) if counts.max() < 1 << 16 else counts.astype(np.uint32)
        rows.append((int(bucket[a]), cls[a:b][start].tobytes(), counts.tobytes(), high[a:b].tobytes(), low[a:b].tobytes()))
    if rows:
        yield pa.RecordBatch.from_pydict(
            dict(zip(["bucket", "classes", "counts", "high", "low"], map(list, zip(*rows, strict=True)), strict=True)),
            pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("classes", "counts", "high", "low"))]),
        )


def _members(batches):
    """Of one bucket: sets to hold against each other first, the member lists of shared segments, and what hot ones cost.

    The signatures stay as they came, and are sorted a part at a time, by their first bits.
    """
    rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    passes = 1
    while passes * BUCKET < sum(len(row[4]) for row in rows):
        passes *= 2
    pairs, shared, held = [], [], 0
    lists: set[tuple[int, bytes]] = set()
    for number in range(passes):
        cls, key, kind = _part(rows, number, passes)
        fresh = np.ones(len(cls), bool)
        fresh[1:] = (cls[1:] != cls[:-1]) | (key[1:] != key[:-1])
        cls, key, kind = cls[fresh], key[fresh], kind[fresh]
        if not len(cls):
            continue
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.append(start, len(key)))
        whole = np.add.reduceat((kind & 1) == 0, start, dtype=np.int64)  # segments themselves, not deletions of them
        start, count = start[(count > 1) & (whole > 0)], count[(count > 1) & (whole > 0)]
        # large segments of like size are told apart by a hash, so that sets can leave out some of them
        part = np.where(count > 16, mix(key[start]) & _U(15), 0).astype(np.int64)
        levels = np.searchsorted(LEVELS, count, "left") * 16 + part
        for a, n, level in zip(start.tolist(), count.tolist(), levels.tolist(), strict=True):
            lists.add((level, cls[a : a + n].tobytes()))
        at = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        rest = np.ones(len(at), bool)
        rest[np.cumsum(count) - count] = False
        pairs.append((np.repeat(cls[start], count)[rest], cls[at][rest], np.ones(rest.sum(), np.int64)))
        mine = (kind[at] & 2) > 0
        shared.append((cls[at][mine], np.repeat(levels, count)[mine], 1 + (kind[at][mine] >> 2).astype(np.int64)))
        held += len(at)
        if held > HELD:
            yield from _summed(pairs, shared, lists)
            pairs, shared, held = [], [], 0
            lists.clear()
    yield from _summed(pairs, shared, lists)


def _part(rows: list[tuple], number: int, passes: int):
    """(set, signature, kind) of those signatures of a bucket whose first bits are this number, sorted."""
    found = [(np.zeros(0, np.int64), np.zeros(0, _U))]
    for bucket, classes, counts, high, low in rows:
        names, high = np.frombuffer(classes, np.int64), np.frombuffer(high, np.uint32)
        mine = (high.astype(_U) * _U(passes)) >> _U(32) == number
        cls = np.repeat(names, np.frombuffer(counts, np.uint16 if len(counts) == 2 * len(names) else np.uint32))[mine]
        sig = (np.uint64(bucket & 0xFFFF) << _U(48)) | (high[mine].astype(_U) << _U(16)) | np.frombuffer(low, np.uint8)[mine]
        found.append((cls, sig))
    cls, sig = (np.concatenate([x[i] for x in found]) for i in range(2))
    order = np.lexsort((sig & _U(1), cls, sig & ~_U(7)))
    cls, sig = cls[order], sig[order]
    return cls, sig & ~_U(7), (sig & _U(7)).astype(np.int8)


def _summed(pairs: list[tuple], shared: list[tuple], lists: set[tuple[int, bytes]]):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("weight", pa.int64()), ("level", pa.int32()), ("members", pa.binary())])

    def batch(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    for parts, second in ((pairs, "b"), (shared, "level")):
        if not parts:
            continue
        first, other, weight = (np.concatenate([x[i] for x in parts]) for i in range(3))
        order = np.lexsort((other, first))
        first, other, weight = first[order], other[order], weight[order]
        at = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (other[1:] != other[:-1])]) if len(first) else np.zeros(0, np.int64)
        weight = np.add.reduceat(weight, at) if len(at) else weight
        for i in range(0, len(at), 10_000):
            some = at[i : i + 10_000]
            yield batch(len(some), a=first[some], weight=weight[i : i + 10_000], **{second: other[some]})
    listed = list(lists)
    for i in range(0, len(listed), 10_000):
        some = listed[i : i + 10_000]
        yield batch(len(some), level=[level for level, _ in some], members=[x for _, x in some])


def _unpacked(batches):
    for batch in batches:
        blobs, levels = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        if blobs:
            name = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8, key=b"%d" % n).digest(), "little", signed=True) for x, n in zip(blobs, levels, strict=True)])
            size = np.array([len(x) // 8 for x in blobs])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(name.astype(np.int64), size)),
                    pa.array(np.frombuffer(b"".join(blobs), np.int64)),
                    pa.array(np.repeat(levels.astype(np.int32), size)),
                ],
                ["g", "cls", "level"],
            )


def sketch(tokens: np.ndarray) -> bytes:
    """A bit for each value of some bits of a token, 1 where an odd number of the set's tokens has it.

    Two sets differ in at least as many tokens as their sketches do in bits. A sketch has as many bits as the set has
    tokens, about; folded once it is the one of half as many.
    """
    size = 64
    while size < min(len(tokens), SKETCH):
        size *= 2
    place = (mix(tokens) >> _U(20)) & _U(size - 1)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=size) & 1).astype(bool)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """In how many bits two sketches differ, at the shorter of both lengths."""
    a, b = (np.frombuffer(z, np.uint8)[None] for z in (x, y))
    size = min(len(x), len(y))
    return int(np.bitwise_count((_folded(a, size) ^ _folded(b, size)).view(_U)).sum())


def _folded(rows: np.ndarray, size: int) -> np.ndarray:
    while rows.shape[1] > size:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def open_pairs(n: np.ndarray, sketches: list[bytes], left: np.ndarray, right: np.ndarray, percent: int):
    """(x, y), places in n: those of the pairs of left and right that sizes and sketches leave open, right by right."""
    length = np.array([len(x) for x in sketches])
    rows = {k: np.frombuffer(b"".join(sketches[i] for i in np.flatnonzero(length == k)), np.uint8).reshape(-1, k) for k in np.unique(length).tolist()}
    place = np.zeros(len(n), np.int64)
    for k in rows:
        place[length == k] = np.arange((length == k).sum())
    left = left[np.argsort(n[left], kind="stable")]
    for k, mine in rows.items():  # left ones of a length against right ones, at the shorter of both lengths
        lefts = left[length[left] == k]
        for l, theirs in rows.items():
            rights = right[length[right] == l]
            if not len(lefts) or not len(rights):
                continue
            size = min(k, l)
            a, b = (np.ascontiguousarray(_folded(x, size)).view(_U) for x in (mine[place[lefts]], theirs[place[rights]]))
            low = np.searchsorted(n[lefts], -(-n[rights] * percent // 100), "left")
            high = np.searchsorted(n[lefts], n[rights] * 100 // percent, "right")
            for i in np.flatnonzero(low < high).tolist():
                some = lefts[low[i] : high[i]]
                apart = np.bitwise_count(a[low[i] : high[i]] ^ b[i]).sum(axis=1, dtype=np.int64)
                near = some[apart * (100 + percent) <= (n[some] + n[rights[i]]) * (100 - percent)]
                if len(near):
                    yield near, np.full(len(near), rights[i])


def _sets(batches, words: int, named: bool = True):
    """The sets of the texts, each once in a task; named: those whose name the set has."""
    seen: set[int] = set()
    for batch in batches:
        for row, end, w in words_of(batch.column(1), SPACES, lower=True):
            tokens, first = shingles(w, words)
            cls, keep = classes_of(tokens, first), []
            wanted = batch.column(0).slice(row, end - row).to_pylist() if named else cls.tolist()
            for i, c in enumerate(cls.tolist()):
                if wanted[i] == c and c not in seen:
                    keep.append(i)
                    seen.add(c)
            if len(seen) > BATCH:
                seen.clear()
            some = [tokens[first[i] : first[i + 1]] for i in keep]
            columns = [cls[keep], np.array([len(x) for x in some], np.int32), [x.tobytes() for x in some], [sketch(x) for x in some]]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], ["cls", "n", "tokens", "sketch"])


def _prefixes(batches, words: int, percent: int, least: int, most: int):
    for batch in batches:
        for _, _, w in words_of(batch.column(1), SPACES, lower=True):
            tokens, first = shingles(w, words)
            n = np.diff(first)
            cls = classes_of(tokens, first)
            for i in np.flatnonzero((n >= max(1, least)) & (n <= most)).tolist():
                some = tokens[first[i] : first[i] + n[i] - -(-n[i] * percent // 100) + 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), cls[i])), pa.array(some.view(np.int64))], ["cls", "token"]
                )


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches leave open."""

    def kept(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)
            yield batch.select([0, 1]).filter(pa.array([
                100 * min(m, n) >= percent * max(m, n) and apart(x, y) * (100 + percent) <= (m + n) * (100 - percent) for m, x, n, y in rows
            ], pa.bool_()))

    both = pairs.join(sketches.toDF("a", "m", "x"), "a").join(sketches.toDF("b", "n", "y"), "b")
    return both.select("a", "b", "m", "x", "n", "y").mapInArrow(kept, "a long, b long")


def _with_heads(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of pairs (a, b), where many b may share an a: these are dealt to several tasks, each with a's set."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = pairs.join(counts, "a")
    tails = dealt.select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("cls"))
    heads = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("cls"))
    rows = tails.union(heads).join(sets, "cls")

    def compared(table: pa.Table) -> pa.Table:
        a, cls = table.column("a")[0].as_py(), table.column("cls").to_numpy()
        tokens = table.column("tokens")
        head = np.frombuffer(tokens[int(np.flatnonzero(cls == a)[0])].as_py(), _U)
        out = []
        for i, b in enumerate(cls.tolist()):
            other = np.frombuffer(tokens[i].as_py(), _U)
            if b != a and 100 * min(len(head), len(other)) >= percent * max(len(head), len(other)):
                common = np.intersect1d(head, other, assume_unique=True).size
                if 100 * common >= percent * (len(head) + len(other) - common):
                    out.append(b)
        return pa.table({"a": pa.array([a] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

    return rows.groupBy("a", "part").applyInArrow(compared, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each input row.

    A null or empty text has no shingles and stands alone, under its own id. Rows that repeat an id are rows of their
    own with the same id. A null id never names a component. Other columns of the input are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profiles = frames.cut(texts.mapInArrow(lambda it: _profiles(it, words, percent), PROFILE))
    classes = profiles.where("n_shingles > 0").groupBy("cls").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("safe").alias("safe"), F.first("slack").alias("slack")
    )
    total = profiles.agg(F.sum("n_shingles")).first()[0] or 0
    parallel = spark.sparkContext.defaultParallelism
    buckets = max(parallel, min(4 * parallel, -(-total // BUCKET)), -(-total // (BUCKET * PASSES)))
    blocks = texts.mapInArrow(lambda it: _blocks(it, words, percent, buckets), BLOCKS)
    found = frames.cut(blocks.repartitionById(buckets, F.col("bucket")).mapInArrow(_members, FOUND))

    # each set leaves out the levels of segments that most share, as long as that costs no more than it has to spare
    spent = found.where("a IS NOT NULL AND b IS NULL").groupBy(F.col("a").alias("cls"), "level").agg(F.sum("weight").alias("weight"))
    spent = spent.withColumn("spent", F.sum("weight").over(Window.partitionBy("cls").orderBy(F.desc("level"))))
    limits = spent.join(classes.select("cls", "slack", "safe"), "cls").where("NOT safe OR spent > slack")
    limits = frames.cut(limits.groupBy("cls").agg(F.max("level").alias("limit")))
    groups = found.where("members IS NOT NULL").select("members", "level").distinct().mapInArrow(_unpacked, "g long, cls long, level int")
    groups = groups.join(limits, "cls", "left").join(classes.select("cls", "n"), "cls")
    groups = groups.select("g", "cls", "n", F.coalesce(F.col("level") <= F.col("limit"), F.lit(False)).alias("active"))
    live = groups.groupBy("g").agg(F.max("active").alias("any")).where("any").select("g")
    groups = frames.cut(groups.join(live, "g", "left_semi"))

    extra = _rest(texts, classes, words, percent)
    alive = groups.where("active").select("cls").distinct()
    pairs = found.where("b IS NOT NULL").groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("weight", "a")).alias("a")).join(alive.toDF("b"), "b", "left_semi").select("a", "b")
    if extra is not None:
        best = best.union(extra).distinct()
    wanted = groups.select("cls").union(best.select("a")).union(best.select("b")).distinct()
    named = frames.cut(wanted.join(classes, "cls").select("cls", F.col("least").alias("doc_id")))
    # a repeated id with another text would answer for the wrong class, so names are checked
    sets = (
        frames.sifted(texts, "doc_id", frames.sieve(named.select("doc_id"))).join(named, "doc_id").select("cls", "text").mapInArrow(lambda it: _sets(it, words), SETS)
    )
    if not classes.groupBy("least").count().where("count > 1").isEmpty() or not classes.where("least IS NULL").isEmpty():
        sets = _sets_by_class(texts, wanted, words)
    sets = frames.cut(sets)  # a set may come from several tasks, if an id is repeated: once more in a comparison is no harm
    sketches = frames.cut(sets.select("cls", "n", "sketch").dropDuplicates(["cls"]))
    sets = sets.select("cls", "tokens")

    links = frames.cut(_with_heads(_near(best, sketches, percent), sets, percent))
    roots = frames.components(links)

    def still_open(groups: DataFrame) -> DataFrame:
        """Members of the segments that hold sets of several components, one of them active."""
        placed = groups.join(roots.toDF("cls", "root"), "cls", "left")
        placed = placed.select("g", "cls", "n", "active", F.coalesce("root", "cls").alias("root"))
        mixed = placed.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("active").alias("any"))
        return frames.cut(placed.join(mixed.where("lo < hi AND any").select("g"), "g", "left_semi"))

    left = still_open(groups)
    if not left.isEmpty():
        links = links.union(_in_blocks(left, sets, sketches, percent))
        roots = frames.components(links)

    named = classes.select("cls", "least").join(roots.toDF("cls", "root"), "cls", "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("cls", "component_id")
    return profiles.join(named, "cls", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _in_blocks(left: DataFrame, sets: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Links between all sets that segments still connect, in blocks; enough of them to join what belongs together.

    Each set goes to one task per block it has to meet, so no pair becomes a row unless it is linked: first its sketch, in
    large blocks, then its tokens, in those of the small blocks where sketches leave one of its pairs open.
    """
    heads = left.groupBy("g").agg(F.min("cls").alias("b"))
    areas = frames.components(left.join(heads, "g").select(F.col("cls").alias("a"), "b"))
    areas = areas.join(left.select(F.col("cls").alias("node"), "root", "active").groupBy("node").agg(F.max("root").alias("root2"), F.max("active").alias("active")), "node")
    areas = areas.select(F.col("root").alias("area"), F.col("node").alias("cls"), F.col("root2").alias("root"), "active")
    # the largest component of an area only has to meet the rest of it
    sizes = areas.groupBy("area", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("area").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("mains"), F.sum("n").alias("all"))
    many = [F.greatest(F.lit(1), F.ceil(n / SKETCHED)).cast("int").alias(c) for n, c in ((F.col("mains"), "mains"), (F.col("all") - F.col("mains"), "strays"))]
    areas = areas.join(main.select("area", "main", *many), "area")
    # blocks of the main component are those below 0
    spread, inside, small = F.xxhash64("cls"), F.col("root") == F.col("main"), max(1, SKETCHED // BLOCK)
    place = F.pmod(spread, F.when(inside, F.col("mains")).otherwise(F.col("strays"))).cast("int")
    fine = place * small + F.pmod(F.xxhash64(spread), F.lit(small)).cast("int")
    placed = [F.when(inside, -1 - at).otherwise(at).alias(name) for at, name in ((place, "own"), (fine, "fine"))]
    areas = frames.cut(areas.select("area", "cls", "root", "active", "mains", "strays", *placed))
    strays = F.sequence(F.lit(0), F.col("strays") - 1)
    met = F.when(F.col("own") < 0, strays).otherwise(F.concat(F.transform(F.sequence(F.lit(1), F.col("mains")), lambda i: -i), strays))
    rows = areas.join(sketches, "cls").withColumn("other", F.explode(met))
    rows = rows.select("area", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fine", "cls", "root", "active", "n", "sketch")
    opened = rows.groupBy("area", "i", "j").applyInArrow(lambda t: _opened(t, percent), "area long, i int, j int, cls long").distinct()
    members = opened.join(areas.select("cls", "root", "active"), "cls").join(sets, "cls")
    return members.groupBy("area", "i", "j").applyInArrow(lambda t: _compared(t, percent), "a long, b long")


def _opened(table: pa.Table, percent: int) -> pa.Table:
    """Of one large block against another, or itself: the small blocks (i, j) in which a set has to be compared, with the set."""
    cls, root, own, fine, n = (table.column(name).to_numpy() for name in ("cls", "root", "own", "fine", "n"))
    active = table.column("active").to_numpy(zero_copy_only=False)
    sides = [np.flatnonzero(own == table.column(name)[0].as_py()) for name in ("i", "j")]
    blocks, at = np.unique(fine, return_inverse=True)
    meets = np.zeros((len(cls), len(blocks)), bool)
    for x, y in open_pairs(n.astype(np.int64), table.column("sketch").to_pylist(), *sides, percent):
        mine = (root[x] != root[y]) & (active[x] | active[y])
        meets[x[mine], at[y[mine]]] = meets[y[mine], at[x[mine]]] = True
    who, where = np.nonzero(meets)
    low, high = np.minimum(fine[who], blocks[where]), np.maximum(fine[who], blocks[where])
    area = np.full(len(who), table.column("area")[0].as_py(), np.int64)
    return pa.table({"area": area, "i": low.astype(np.int32), "j": high.astype(np.int32), "cls": cls[who]})


def _compared(table: pa.Table, percent: int) -> pa.Table:
    """Links of a block with another, or with itself, between different components; of these a spanning forest."""
    cls, root = table.column("cls").to_numpy(), table.column("root").to_numpy()
    active = table.column("active").to_numpy(zero_copy_only=False)
    order = np.argsort(cls, kind="stable")
    tokens = [np.frombuffer(table.column("tokens")[int(i)].as_py(), _U) for i in order]
    cls, root, active = cls[order], root[order], active[order]
    size = np.array([len(t) for t in tokens])
    owner = np.repeat(np.arange(len(cls)), size)
    number = np.unique(np.concatenate(tokens), return_inverse=True)[1] if len(cls) else np.zeros(0, np.int64)
    by = np.argsort(number, kind="stable")
    owners, edge = owner[by], np.searchsorted(number[by], np.arange(number.max(initial=-1) + 2))
    first = np.r_[0, np.cumsum(size)]
    parent = {r: r for r in root.tolist()}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x in range(len(cls)):
        mine = number[first[x] : first[x + 1]]
        low, high = edge[mine], edge[mine + 1]
        n = high - low
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        common = np.bincount(owners[at], minlength=len(cls))
        linked = 100 * common >= percent * (size[x] + size - common)
        linked &= (root != root[x]) & (active | active[x])
        for y in np.flatnonzero(linked[x + 1 :]).tolist():
            a, b = find(int(root[x])), find(int(root[x + 1 + y]))
            if a != b:
                parent[b] = a
                out.append((int(cls[x]), int(cls[x + 1 + y])))
    columns = list(zip(*out, strict=True)) or [[], []]
    return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64())})


def _sets_by_class(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """Sets of the wanted classes where ids do not name them: found again by their contents."""

    found = texts.select("doc_id", "text").mapInArrow(lambda it: _sets(it, words, named=False), SETS)
    return found.join(wanted, "cls", "left_semi").dropDuplicates(["cls"])


def _rest(texts: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame | None:
    """Candidate pairs of the sets that are not safe, by a join of prefixes in hash order; None where there are none."""
    weak = frames.cut(classes.where("NOT safe").select("cls", "n"))
    span = weak.agg(F.min("n"), F.max("n")).first()
    if span[0] is None:
        return None
    least, most = span[0] * percent // 100, span[1] * 100 // percent + 1
    tokens = texts.mapInArrow(lambda it: _prefixes(it, words, percent, least, most), "cls long, token long")
    mine = tokens.join(weak.select("cls"), "cls", "left_semi").distinct()
    pairs = mine.join(tokens.distinct().toDF("other", "token"), "token").where("cls != other")
    return pairs.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()

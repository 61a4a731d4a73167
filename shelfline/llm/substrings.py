"""Removal of repeated word spans, exact, with suffix automata of reference shards.

A window of `window` words that also starts earlier (smaller id, or earlier in the same document) is removed wherever it
stands. The corpus is its own reference, and an automaton of all of it would neither fit a broadcast nor be worth
streaming everything through. So windows are first sorted out by hashes: each window falls to its anchor, the smallest
hash of the five-word runs in it, and windows of one anchor meet in one bucket, where the earliest of equal ones is
found. This gives the *reference*: the spans of earliest occurrences of repeated windows, cut into shards of bounded
size, and for each document the shards it has to be held against. Each shard becomes a suffix automaton over words; the
pieces of documents dealt to it stream through, and their matching statistics decide, on the words themselves, which
spans also stand earlier. A shard that very many documents need is sent to several tasks, its documents dealt out
between them.

Before the buckets, a batch keeps only its own first window of each kind, so a window that stands in a third of all
documents reaches a bucket once per batch. Anchors that hold a large share of all runs are counted over the whole
corpus first; their windows are dealt out one by one instead of by anchor.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm import frames
from shelfline.llm.text import SPACES, Words, mix, words_of

_U = np.uint64
ANCHOR = 5  # words of an anchor
HEAVY = 1 << 12  # an anchor with more than one in so many runs is dealt out by window
SHARD = 1 << 16  # words of a document that fall to one reference shard together
BUCKET = 1 << 18  # runs of windows that meet in one task, about
BATCH = 1 << 19  # windows that a task sorts at once, about
STREAM = 1 << 19  # words that stream through one copy of a shard, about

_WORD = re.compile(rb"[^ \t-\r]+")

BLOCKS = "bucket int, header binary, runs binary, hashes binary"
FOUND = "doc_id long, start int, n int, ref_doc long, ref_start int"
_HEADER = np.dtype([("doc", "<i8"), ("count", "<i4")])
_RUN = np.dtype([("anchor", "<u8"), ("start", "<i4"), ("n", "<u1")])


def _windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows: text, start within the text, hash, anchor."""
    hashes = words.hashes()
    at, value = words.windows(hashes, window)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, value, value
    _, grams = words.windows(hashes, 1)
    size = min(ANCHOR, window)
    first, found = words.windows(hashes, size)
    grams = np.zeros(len(hashes), _U)
    grams[first] = found
    span, reach = window - size + 1, 1
    least = grams
    while reach < span:  # smallest over `span` neighbours, by doubling
        step = min(reach, span - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    owner = np.searchsorted(words.first, at, "right") - 1
    return owner, at - words.first[owner], value, least[at]


def _heavy(batches, window: int):
    """Counts of the anchors that hold a share of a batch that could make them heavy; -1 carries the number of runs."""
    def counted(parts):
        anchors, counts = np.unique(np.concatenate(parts), return_counts=True)
        total = int(counts.sum())
        keep = counts * 2 * HEAVY >= total
        return pa.RecordBatch.from_pydict(
            {
                "anchor": pa.array(np.append(anchors[keep].view(np.int64), 0)),
                "n": pa.array(np.append(counts[keep], total)),
                "total": pa.array(np.append(np.zeros(keep.sum(), bool), True)),
            }
        )

    parts, held = [], 0
    for batch in batches:
        for _, _, words in words_of(batch.column(1)):
            owner, _, _, anchor = _windows(words, window)
            if len(owner):
                parts.append(anchor[np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]])
                held += len(parts[-1])
            if held > BATCH:
                yield counted(parts)
                parts, held = [], 0
    if parts:
        yield counted(parts)


def heavy_anchors(texts: DataFrame, window: int) -> tuple[np.ndarray, int]:
    """Anchors of a large share of all runs, and the number of runs. At most 2 * HEAVY such anchors exist, so the driver
    can hold them."""
    counts = texts.mapInArrow(lambda it: _heavy(it, window), "anchor long, n long, total boolean")
    counts = frames.cut(counts.groupBy("total", "anchor").agg(F.sum("n").alias("n")))
    total = counts.where("total").agg(F.sum("n")).first()[0] or 0
    heavy = counts.where(~F.col("total") & (F.col("n") * 2 * HEAVY > total)).orderBy(F.desc("n"), "anchor").limit(2 * HEAVY)
    return np.sort(np.array([r.anchor for r in heavy.select("anchor").collect()], np.int64).view(_U)), total


def _blocks(batches, window: int, buckets: int, heavy: np.ndarray):
    parts, held = [], 0
    for batch in batches:
        ids = batch.column(0)
        for row, end, words in words_of(batch.column(1)):
            owner, start, value, anchor = _windows(words, window)
            if len(owner):
                doc = np.asarray(ids.slice(row, end - row).to_numpy(zero_copy_only=False), np.int64)
                parts.append((doc[owner], start, value, anchor))
                held += len(owner)
            if held > BATCH:
                yield from _dealt(parts, buckets, heavy)
                parts, held = [], 0
    if parts:
        yield from _dealt(parts, buckets, heavy)


def _dealt(parts: list[tuple], buckets: int, heavy: np.ndarray):
    doc, start, value, anchor = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((start, doc))
    doc, start, value, anchor = doc[order], start[order], value[order], anchor[order]
    # windows the batch has seen earlier need no bucket
    order = np.lexsort((start, doc, value))
    same = np.r_[False, value[order][1:] == value[order][:-1]]
    lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    earlier = same & ((doc[lead] != doc[order]) | (start[lead] != start[order]))
    yield from _found(doc[order][earlier], start[order][earlier], doc[lead][earlier], start[lead][earlier], local=True)
    keep = np.sort(order[~same])
    doc, start, value, anchor = doc[keep], start[keep], value[keep], anchor[keep]
    by = np.where(np.isin(anchor, heavy), value, anchor)
    bucket = ((mix(by) >> _U(32)).astype(np.int64) * buckets) >> 32
    head = np.r_[
        True, (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (bucket[1:] != bucket[:-1])
    ]
    at = np.flatnonzero(head)
    # a run is at most 255 windows
    runs = np.diff(np.append(at, len(doc)))
    if runs.max(initial=0) > 255:
        inside = np.arange(len(doc)) - np.repeat(at, runs)
        at = np.flatnonzero(head | (inside % 255 == 0))
        runs = np.diff(np.append(at, len(doc)))
    order = np.lexsort((start[at], doc[at], bucket[at]))
    at, runs = at[order], runs[order]
    low = (value & _U(0xFFFFFFFF)).astype(np.uint32)
    edges = np.flatnonzero(np.r_[True, bucket[at][1:] != bucket[at][:-1], True])
    rows = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        some, n = at[a:b], runs[a:b]
        record = np.zeros(b - a, _RUN)
        record["anchor"], record["start"], record["n"] = anchor[some], start[some], n
        first = np.flatnonzero(np.r_[True, doc[some][1:] != doc[some][:-1]])
        header = np.zeros(len(first), _HEADER)
        header["doc"], header["count"] = doc[some][first], np.diff(np.append(first, b - a))
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(some, n)
        rows.append((int(bucket[some[0]]), header.tobytes(), record.tobytes(), low[inside].tobytes()))
    yield _arrow(rows)


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    names = ["bucket", "header", "runs", "hashes"]
    schema = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in names[1:])])
    return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema)


def _runs(doc, start, ref_doc, ref_start):
    """Windows that follow each other, like what they repeat, as (doc, start, n, ref_doc, ref_start)."""
    order = np.lexsort((start, doc))
    doc, start, ref_doc, ref_start = doc[order], start[order], ref_doc[order], ref_start[order]
    head = np.ones(len(doc), bool)
    head[1:] = (
        (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (ref_doc[1:] != ref_doc[:-1]) | (ref_start[1:] != ref_start[:-1] + 1)
    )
    at = np.flatnonzero(head)
    return doc[at], start[at], np.diff(np.append(at, len(doc))), ref_doc[at], ref_start[at]


def _found(doc, start, ref_doc, ref_start, local: bool):
    if not len(doc):
        return
    doc, start, n, ref_doc, ref_start = _runs(doc, start, ref_doc, ref_start)
    if local:  # travels through the buckets as one more row, marked by a negative bucket
        record = np.zeros(len(doc), [("doc", "<i8"), ("start", "<i4"), ("n", "<i4"), ("ref", "<i8"), ("at", "<i4")])
        record["doc"], record["start"], record["n"], record["ref"], record["at"] = doc, start, n, ref_doc, ref_start
        yield _arrow([(-1 - int(doc[0] % 1024), b"", record.tobytes(), b"")])
    else:
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(ref_doc), pa.array(ref_start.astype(np.int32))],
            ["doc_id", "start", "n", "ref_doc", "ref_start"],
        )


def _repeats(batches):
    """Of one bucket: the windows that also start earlier, with the place of the earliest."""
    parts = []
    for batch in batches:
        for bucket, header, runs, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket < 0:
                r = np.frombuffer(runs, [("doc", "<i8"), ("start", "<i4"), ("n", "<i4"), ("ref", "<i8"), ("at", "<i4")])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r[c].copy()) for c in ("doc", "start", "n", "ref", "at")], ["doc_id", "start", "n", "ref_doc", "ref_start"]
                )
                continue
            header, runs = np.frombuffer(header, _HEADER), np.frombuffer(runs, _RUN)
            parts.append((np.repeat(header["doc"], header["count"]), runs, np.frombuffer(hashes, np.uint32)))
    if not parts:
        return
    doc, runs, low = (np.concatenate([p[i] for p in parts]) for i in range(3))
    del parts
    n = runs["n"].astype(np.int64)
    # most anchors stand once: drop their windows before anything is sorted by window
    _, inverse, count = np.unique(runs["anchor"], return_inverse=True, return_counts=True)
    several = count[inverse] > 1
    low = low[np.repeat(several, n)]
    doc, runs, n, inverse = doc[several], runs[several], n[several], inverse[several]
    if not len(doc):
        return
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    doc, anchor = np.repeat(doc, n), np.repeat(inverse, n)
    start = np.repeat(runs["start"].astype(np.int64), n) + within
    order = np.lexsort((start, doc, low, anchor))
    same = np.r_[False, (low[order][1:] == low[order][:-1]) & (anchor[order][1:] == anchor[order][:-1])]
    lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    later = same & ((doc[lead] != doc[order]) | (start[lead] != start[order]))
    yield from _found(doc[order][later], start[order][later], doc[lead][later], start[lead][later], local=False)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def _pieces(batches, window: int):
    """Cuts the words that reference shards need, and those to be held against them, out of each document."""
    for batch in batches:
        out: list[tuple] = []
        for doc, text, needs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            by: dict[tuple[int, bool], list[tuple[int, int]]] = {}
            for need in needs:
                by.setdefault((need["shard"], need["reference"]), []).append((need["start"], need["start"] + need["n"] + window - 1))
            for (shard, reference), spans in by.items():
                for a, b in _union(spans):
                    out.append((shard, reference, doc, a, min(b, len(words)) - a, b" ".join(words[a:b])))
        if out:
            yield pa.RecordBatch.from_pydict(
                dict(zip(["shard", "reference", "doc_id", "start", "n_words", "words"], map(list, zip(*out, strict=True)), strict=True)),
                pa.schema([("shard", pa.int64()), ("reference", pa.bool_()), ("doc_id", pa.int64()), ("start", pa.int32()), ("n_words", pa.int32()), ("words", pa.binary())]),
            )


class Automaton:
    """Suffix automaton of several word sequences, inserted in order; each state knows where it ended first.

    `step` moves along a stream and keeps the longest suffix, at most `cap` words, that some sequence contains.
    """

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.place: list[tuple[int, int]] = [(0, 0)]

    def insert(self, words: list, doc: int, start: int) -> None:
        last = 0
        for i, word in enumerate(words):
            last = self._extend(last, word, (doc, start + i))

    def _extend(self, last: int, word, place: tuple[int, int]) -> int:
        nexts, link, length, places = self.next, self.link, self.length, self.place
        have = nexts[last].get(word)
        if have is not None and length[have] == length[last] + 1:
            return have
        if have is not None:  # an earlier sequence went on like this; only its state has to be split
            return self._clone(last, have, word)
        state = len(nexts)
        nexts.append({}), link.append(0), length.append(length[last] + 1), places.append(place)
        p = last
        while p >= 0 and word not in nexts[p]:
            nexts[p][word] = state
            p = link[p]
        if p >= 0:
            q = nexts[p][word]
            link[state] = q if length[q] == length[p] + 1 else self._clone(p, q, word)
        return state

    def _clone(self, p: int, q: int, word) -> int:
        nexts, link, length = self.next, self.link, self.length
        copy = len(nexts)
        nexts.append(dict(nexts[q])), link.append(link[q]), length.append(length[p] + 1), self.place.append(self.place[q])
        while p >= 0 and nexts[p].get(word) == q:
            nexts[p][word] = copy
            p = link[p]
        link[q] = copy
        return copy

    def earlier(self, words: list, doc: int, start: int, cap: int) -> list[tuple[int, int]]:
        """Maximal spans of `words` whose every window of `cap` words also ended at an earlier place."""
        nexts, link, length, places = self.next, self.link, self.length, self.place
        spans: list[list[int]] = []
        state = matched = 0
        for i, word in enumerate(words):
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            following = nexts[state].get(word)
            if following is None:
                state = matched = 0
                continue
            state, matched = following, matched + 1
            while length[link[state]] >= cap:
                state = link[state]
            if matched >= cap:
                matched = cap
                if places[state] < (doc, start + i):
                    a, b = start + i - cap + 1, start + i + 1
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = b
                    else:
                        spans.append([a, b])
        return [(a, b) for a, b in spans]


def _streamed(group: pa.Table, window: int) -> pa.Table:
    """One shard: the automaton of its reference pieces, and the spans of the other pieces that stand earlier there."""
    doc, start, reference = (group.column(c).to_numpy() for c in ("doc_id", "start", "reference"))
    words = group.column("words")
    numbers: dict[bytes, int] = {}
    automaton = Automaton()
    for i in np.lexsort((start, doc)).tolist():
        if reference[i]:
            piece = [numbers.setdefault(w, len(numbers)) for w in words[i].as_py().split()]
            automaton.insert(piece, int(doc[i]), int(start[i]))
    out = []
    for i in np.flatnonzero(~reference).tolist():
        piece = [numbers.get(w, -1) for w in words[i].as_py().split()]
        out += [(int(doc[i]), a, b) for a, b in automaton.earlier(piece, int(doc[i]), int(start[i]), window)]
    columns = list(zip(*out, strict=True)) or [[], [], []]
    return pa.table({"doc_id": pa.array(columns[0], pa.int64()), "start": pa.array(columns[1], pa.int32()), "end": pa.array(columns[2], pa.int32())})


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """(doc_id, spans): word spans [start, end) of each document that also stand earlier, disjoint and in order.

    Documents without such a span, and null ids, have no row. Rows that repeat an id have to repeat its text.
    """
    spark = docs.sparkSession
    texts = _prepared(docs, id_col, text_col).where("doc_id IS NOT NULL")
    heavy, total = heavy_anchors(texts, window)
    buckets = max(spark.sparkContext.defaultParallelism, -(-total // BUCKET))
    blocks = texts.mapInArrow(lambda it: _blocks(it, window, buckets, heavy), BLOCKS)
    runs = frames.cut(blocks.repartitionById(buckets, F.pmod("bucket", F.lit(buckets))).mapInArrow(_repeats, FOUND))

    # copies of a whole text are repeated from end to end: only its first document has to be looked at
    digests = texts.select("doc_id", F.sha2("text", 256).alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    copies = texts.select("doc_id", F.sha2("text", 256).alias("digest"), F.lit(0).alias("z")).join(digests.where("n > 1"), "digest")
    copies = frames.cut(copies.where("doc_id != least").select("doc_id").distinct())
    some = frames.cut(runs.join(copies, "doc_id", "left_anti"))

    shards = F.lit(buckets * 4)
    shard = F.pmod(F.xxhash64("ref_doc", F.floor(F.col("ref_start") / SHARD)), shards)
    query = some.select("doc_id", F.struct(shard.alias("shard"), F.lit(False).alias("reference"), "start", "n").alias("need"))
    reference = some.select(F.col("ref_doc").alias("doc_id"), F.struct(shard.alias("shard"), F.lit(True).alias("reference"), F.col("ref_start").alias("start"), "n").alias("need"))
    needs = query.union(reference).distinct().groupBy("doc_id").agg(F.collect_list("need").alias("needs"))
    pieces = texts.dropDuplicates(["doc_id"]) if _repeats_ids(texts) else texts
    pieces = pieces.join(needs, "doc_id").mapInArrow(
        lambda it: _pieces(it, window), "shard long, reference boolean, doc_id long, start int, n_words int, words binary"
    )
    pieces = frames.cut(pieces)
    sizes = pieces.where("NOT reference").groupBy("shard").agg(F.ceil(F.sum("n_words") / STREAM).cast("int").alias("copies"))
    dealt = pieces.join(sizes, "shard").withColumn(
        "copy",
        F.explode(F.when(F.col("reference"), F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("copies")).cast("int")))),
    )
    spans = dealt.groupBy("shard", "copy").applyInArrow(lambda g: _streamed(g, window), "doc_id long, start int, end int")
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    whole = copies.select("doc_id", F.array(F.struct(F.lit(0).alias("start"), F.lit(-1).alias("end"))).alias("spans"))
    return frames.cut(spans.union(whole))


def _repeats_ids(texts: DataFrame) -> bool:
    return not texts.groupBy("doc_id").count().where("count > 1").isEmpty()


def _numbered(texts: DataFrame) -> DataFrame:
    """The rows with a number in `own` for each pair of id and text, in the order of ids; null for a null id."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    pairs = texts.where("doc_id IS NOT NULL").select("doc_id", digest.alias("digest")).distinct().orderBy("doc_id", "digest")
    pairs = frames.cut(pairs.withColumn("own", F.monotonically_increasing_id()))
    return texts.withColumn("digest", digest).join(pairs, ["doc_id", "digest"], "left").select("doc_id", "text", "own")


def _kept(batches, window: int):
    for batch in batches:
        out = []
        for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            n = len(words)
            if any(s["end"] < 0 for s in spans or ()):  # a copy of a whole text
                spans = [{"start": 0, "end": n}] if n >= window else []
            kept, last = [], 0
            for a, b in _union([(s["start"], s["end"]) for s in spans or ()]):
                kept += words[last:a]
                last = b
            kept += words[last:]
            out.append((doc, n, n - len(kept), b" ".join(kept)))
        if out:
            yield pa.RecordBatch.from_pydict(
                dict(zip(["doc_id", "n_words", "n_removed", "kept"], map(list, zip(*out, strict=True)), strict=True)),
                pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())]),
            )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept holds the words that stay, joined by one space.

    One row for each input row. A null or empty text has no words; a text shorter than the window loses nothing; rows
    that repeat an id and its text are one document, other texts of an id are documents of their own, in the order of
    their digests; a null id is returned as it is and takes nothing from others. Texts of any length are read whole. An
    empty table gives an empty one. Other columns of the input are ignored.
    """
    texts = _prepared(docs, id_col, text_col)
    if _repeats_ids(texts.where("doc_id IS NOT NULL")):
        texts = _numbered(texts)
    else:
        texts = texts.withColumn("own", F.col("doc_id"))
    spans = repeated_spans(texts, "own", "text", window).withColumnRenamed("doc_id", "own")
    rows = texts.join(spans, "own", "left").drop("own").mapInArrow(
        lambda it: _kept(it, window), "doc_id long, n_words long, n_removed long, kept binary"
    )
    return rows.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))


def cut_out(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """The rows without their repeated spans (of `repeated_spans`); line breaks between the words that stay are kept.

    All columns are returned as they are, whatever their names.
    """

    def rest(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for body, cuts in zip(text, spans, strict=True):
            if not isinstance(body, str) or cuts is None or not len(cuts):
                out.append(body)
                continue
            raw = body.encode("utf-8", "surrogatepass")
            words = [m.span() for m in _WORD.finditer(raw)]
            if any(s["end"] < 0 for s in cuts):
                out.append("" if len(words) >= window else body)
                continue
            kept, last = [], 0
            for a, b in _union([(s["start"], s["end"]) for s in cuts]):
                kept.append(raw[words[last][0] : words[a][0]] if a > last else b"")
                last = b
            kept.append(raw[words[last][0] :] if last < len(words) else b"")
            out.append(b"".join(kept).decode("utf-8", "surrogatepass").strip())
        return pd.Series(out, dtype="object")

    rest.__annotations__ = {"text": pd.Series, "spans": pd.Series, "return": pd.Series}
    columns = docs.columns
    taken, mark = {c.lower() for c in columns}, "_"
    while {f"{mark}id", f"{mark}spans"} & taken:
        mark += "_"
    found = spans.select(F.col("doc_id").alias(f"{mark}id"), F.col("spans").alias(f"{mark}spans"))
    joined = docs.join(found, F.col(id_col).cast("long") == F.col(f"{mark}id"), "left")
    return joined.withColumn(text_col, F.pandas_udf(rest, "string")(F.col(text_col), F.col(f"{mark}spans"))).select(*columns)

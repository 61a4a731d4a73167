"""Alignment of two tokenizers over the same bytes: groups of tokens, links, and how well corpus-wide counts back them.

Both tokenizers read a space and the text. Ends of the A tokens and of the B tokens of some documents stand in two
ascending lists. Merging these is cut along diagonals of equal distance: a binary search on each diagonal finds how much
of either list lies before it, so pieces of equal work are independent of each other and of where a document ends. A
piece gives the overlaps it closes; where a shared end falls on a diagonal, the piece before learns of it when the pieces
are stitched. Overlaps that close both tokens end a group and link the two.

Counts of linked id pairs are summed per task first. The most frequent pairs, at most COMMON of them, go to all tasks;
the links of all other pairs, each of which is rare, meet their counts in a join.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.frames import cut
from shelfline.session import stored

STEP = 1 << 13  # merged ends in a piece
BLOCK = 1 << 20  # bytes of text that are aligned at once, about; a longer text is a block of its own
PART = 1 << 16  # characters that the tokenizers read at once, about
COMMON = 1 << 20  # pairs whose counts are sent to all tasks, at most
HELD = 1 << 21  # links that a task counts at once

# Both tokenizers part a text before a single space between other characters
_SPACE = re.compile(r"(?<=\S) (?=\S)")


def diagonals(a: np.ndarray, b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): of the first d merged ends, i are of `a` and j of `b`, for every multiple d of the step and for all.

    Of equal ends that of `a` comes first.
    """
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, step), total)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while True:
        some = np.flatnonzero(low < high)
        if not len(some):
            return low, d - low
        middle = (low[some] + high[some]) // 2
        before = a[middle] <= b[d[some] - middle - 1]
        low[some[before]] = middle[before] + 1
        high[some[~before]] = middle[~before]


def overlaps(a: np.ndarray, b: np.ndarray, i: int, j: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """Of one piece, its ends in `a` and `b`, whose tokens before are i and j and whose bytes begin at `start`:

    (A token, B token, end, does it close both) of the overlaps that end here, and whether its first end is the second
    half of an end shared with the piece before.
    """
    ends = np.empty(len(a) + len(b), np.int64)
    of_b = np.ones(len(ends), bool)
    at = np.arange(len(a)) + np.searchsorted(b, a, "left")
    of_b[at] = False
    ends[at], ends[of_b] = a, b
    done_b = np.cumsum(of_b)
    token_b = j + done_b - of_b
    token_a = i + np.arange(len(ends)) - (done_b - of_b)
    fresh = ends > np.append(start, ends[:-1])
    closes = fresh & np.append(~fresh[1:], False)  # the same end once more, of the other list
    return token_a[fresh], token_b[fresh], ends[fresh], closes[fresh], bool(len(fresh) and not fresh[0])


def merged(a: np.ndarray, b: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, end, does it close both) of all overlaps of two ascending lists of ends, piece by piece."""
    i, j = diagonals(a, b, step)
    pieces = []
    for k in range(len(i) - 1):
        start = max(a[i[k] - 1] if i[k] else 0, b[j[k] - 1] if j[k] else 0)
        *piece, shared = overlaps(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]], i[k], j[k], start)
        if shared:  # the end before this diagonal was that of `a`: its overlap closes both
            before = next(p for p in reversed(pieces) if len(p[3]))
            before[3][-1] = True
        pieces.append(piece)
    kinds = (np.int64, np.int64, np.int64, bool)
    return tuple(np.concatenate([p[n] for p in pieces]) if pieces else np.zeros(0, t) for n, t in enumerate(kinds))


class Pair:
    """The two tokenizers: ids of a text, and the bytes that each id stands for."""

    def __init__(self, a_name: str, b_name: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(public_tokenizers.path(a_name.removesuffix(".json") + ".tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        # strings of special tokens are plain text here
        self.a = tiktoken.Encoding("aligned", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b_name))
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes = np.array([len(x) for x in self.a_bytes])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        self.parts = not any("▁" in p.lstrip("▁") for p in pieces)  # no piece reaches over the start of a word
        self.code = np.dtype("<u4" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "<u8")  # of a linked pair
        self.shift = self.code.itemsize * 4
        top = max(len(self.a_bytes), len(self.b_bytes))
        self.written = [f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(top)]
        self.top = top

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """(A ids, B ids, do both stand for the same bytes) of a space and the text."""
        a, b = self.a.encode_ordinary(" " + text), self.b.encode(text)
        body = (" " + text).encode()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == body == b"".join(map(self.b_bytes.__getitem__, b))
        return np.array(a, "<u4"), np.array(b, "<u4"), same


@lru_cache(maxsize=1)
def pair(a_name: str, b_name: str) -> Pair:
    return Pair(a_name, b_name)


def parts_of(text: str, size: int) -> list[str]:
    """The text in parts of about `size` characters, cut at spaces where both tokenizers part it; the space is left out,
    as each part is read with one before it."""
    parts, start = [], 0
    while len(text) - start > size:
        at = _SPACE.search(text, start + size)
        if at is None:
            break
        parts.append(text[start : at.start()])
        start = at.end()
    return [*parts, text[start:]]


def ids_of(both: Pair, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A and B ids; none for a null or empty text, or where the two stand for different bytes."""
    none = np.zeros(0, "<u4")
    if not text:
        return none, none
    parts = [both.read(part) for part in (parts_of(text, PART) if both.parts else [text])]
    a, b = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:2])
    if not all(same for _, _, same in parts):
        body = (" " + text).encode()
        if b"".join(map(both.a_bytes.__getitem__, a)) != body or b"".join(map(both.b_bytes.__getitem__, b)) != body:
            return none, none
    return a, b


_ALIGNED = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary()), ("groups", pa.string())]


def _block(both: Pair, tokens: list[tuple[np.ndarray, np.ndarray]], with_groups: bool) -> list[tuple]:
    """What `_ALIGNED` names, for some documents whose ends are merged as one list each."""
    a, b = (np.concatenate(x) if x else np.zeros(0, "<u4") for x in list(zip(*tokens, strict=True)) or [[], []])
    token_a, token_b, _, closes = merged(np.cumsum(both.a_sizes[a]), np.cumsum(both.b_sizes[b]))
    last_a, last_b = token_a[closes], token_b[closes]  # of each group
    codes = (a[last_a].astype(both.code) << both.code.type(both.shift)) | b[last_b].astype(both.code)
    # every token with the mark that follows it, in the order of the groups
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[last_a], mark_b[last_b] = 1, 2
    ends_a, ends_b = (np.cumsum([len(x[n]) for x in tokens], dtype=np.int64) for n in (0, 1))
    full = np.array([len(x[1]) > 0 for x in tokens], bool)
    mark_b[ends_b[full] - 1] = 3
    group_a, group_b = np.cumsum(np.append(0, mark_a > 0))[:-1], np.cumsum(np.append(0, mark_b > 0))[:-1]
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + np.append(0, last_b + 1)[group_a]] = mark_a * both.top + a
    order[np.arange(len(b)) + (last_a + 1)[group_b]] = mark_b * both.top + b
    out, places = [], np.searchsorted(last_a, np.append(0, ends_a), "left")
    for k, (end_a, end_b) in enumerate(zip(ends_a.tolist(), ends_b.tolist(), strict=True)):
        n_a, n_b = len(tokens[k][0]), len(tokens[k][1])
        first, after = places[k], places[k + 1]
        written = "".join(map(both.written.__getitem__, order[end_a + end_b - n_a - n_b : end_a + end_b].tolist()))
        digest = hashlib.sha256(written.encode()).hexdigest() if n_a else ""
        out.append((n_a, n_b, int(after - first), digest, codes[first:after].tobytes(), written if with_groups else None))
    return out


def _aligned(batches, a_name: str, b_name: str, with_groups: bool):
    both = pair(a_name, b_name)
    for batch in batches:
        texts, row = batch.column(batch.num_columns - 1), 0
        while row < batch.num_rows:
            tokens, size = [], 0
            while row + len(tokens) < batch.num_rows and size < BLOCK:
                tokens.append(ids_of(both, texts[row + len(tokens)].as_py()))
                size += int(both.a_sizes[tokens[-1][0]].sum())
            columns = list(zip(*_block(both, tokens, with_groups), strict=True))
            kept = batch.slice(row, len(tokens)).columns[:-1]
            made = [pa.array(c, t) for c, (_, t) in zip(columns, _ALIGNED, strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*batch.schema.names[:-1], *(n for n, _ in _ALIGNED)])
            row += len(tokens)


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model", with_groups: bool = False
) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, groups_sha256, links), and `groups` as text if asked for; one row per document.

    `groups` is `a1,a2|b1;a3|b2,b3`: the ids between shared ends, in order. `links` holds the pairs of tokens that end
    together, in order, as unsigned integers with the A id in the upper half of the bits. Texts that are null or empty,
    or whose tokens do not stand for the same bytes, have no tokens, no links and an empty digest. Rows count one by one,
    whether or not their ids repeat or are null; `row` tells them apart. Very long texts are read in stretches between
    spaces and merged in pieces. An empty table gives an empty one; other columns are ignored.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, groups string"
    found = texts.mapInArrow(lambda it: _aligned(it, a_name, b_name, with_groups), schema)
    return found if with_groups else found.drop("groups")


def _counted(batches, code: np.dtype):
    """(code, n) over the links of a task, summed as far as memory allows."""

    def summed(codes: list[np.ndarray], numbers: list[np.ndarray]):
        values, place = np.unique(np.concatenate(codes), return_inverse=True)
        return values, np.bincount(place, np.concatenate(numbers), len(values)).astype(np.int64)

    def sent(values, numbers):
        return pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(numbers)], ["code", "n"])

    codes, numbers, held = [], [], 0
    for batch in batches:
        for links in batch.column(0):
            links = np.frombuffer(links.as_py(), code)
            for at in range(0, len(links), HELD):
                codes.append(links[at : at + HELD]), numbers.append(np.ones(len(codes[-1]), np.int64))
                held += len(codes[-1])
                if held >= HELD:
                    values, sums = summed(codes, numbers)
                    if len(values) > HELD // 2:
                        yield sent(values, sums)
                        values, sums = values[:0], sums[:0]
                    codes, numbers, held = [values], [sums], len(values)
    if held:
        yield sent(*summed(codes, numbers))


def pair_counts(aligned: DataFrame, a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model") -> DataFrame:
    """(code, n, best): how many links of the corpus hold a pair of ids, and whether no other A id has more with its B id."""
    both = pair(a_name, b_name)
    code, shift = both.code, both.shift
    counts = aligned.select("links").mapInArrow(lambda it: _counted(it, code), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = cut(counts.withColumn("b", F.col("code").bitwiseAND((1 << shift) - 1)))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return cut(counts.join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best")))


def _common(counts: DataFrame) -> int:
    """The least count, a power of two, from which on there are at most COMMON pairs."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect()  # one row per power
    least, held = 64, 0
    for power, number in sorted(((r[0], r[1]) for r in sizes), reverse=True):
        held += number
        if held > COMMON:
            break
        least = power
    return 1 << min(least, 62)


def _looked_up(batches, code: np.dtype, send):
    codes, numbers, best = send.value
    for batch in batches:
        sums, tops, left = [], [], []
        for links in batch.column(batch.num_columns - 1):
            links = np.frombuffer(links.as_py(), code).astype(np.int64)
            place = np.minimum(np.searchsorted(codes, links), max(0, len(codes) - 1))
            known = codes[place] == links if len(codes) else np.zeros(len(links), bool)
            sums.append(int(numbers[place[known]].sum()))
            tops.append(int(best[place[known]].sum()))
            left.append(links[~known])
        lists = pa.ListArray.from_arrays(
            pa.array(np.cumsum([0] + [len(x) for x in left]), pa.int32()), pa.array(np.concatenate(left) if left else np.zeros(0, np.int64))
        )
        made = [pa.array(tops, pa.int64()), pa.array(sums, pa.int64()), lists]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "n_best", "count_sum", "rare"])


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model") -> DataFrame:
    """`align`, with n_links, n_best (links whose pair is the most frequent one of their B id) and count_sum (of the
    corpus-wide counts of the pairs linked), one row per document. Odd rows are as `align` says: without tokens all are 0.
    """
    aligned = stored(align(docs, id_col, text_col, a_name, b_name), "aligned")
    counts = pair_counts(aligned, a_name, b_name)
    least = _common(counts)
    common = counts.where(F.col("n") >= least).orderBy("code").toArrow()  # at most COMMON rows
    code = pair(a_name, b_name).code
    send = docs.sparkSession.sparkContext.broadcast(tuple(common.column(c).to_numpy() for c in ("code", "n", "best")))
    columns = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    linked = aligned.select(*columns[:-2], (F.octet_length("links") / code.itemsize).cast("long").alias("n_links"), "groups_sha256", "links")
    schema = ", ".join(f"{c} {t}" for c, t in linked.drop("links").dtypes) + ", n_best long, count_sum long, rare array<long>"
    found = linked.mapInArrow(lambda it: _looked_up(it, code, send), schema)
    rare = counts.where(F.col("n") < least)
    if rare.isEmpty():
        return found.drop("row", "rare")
    found = stored(found, "looked-up")
    links = found.select("row", F.explode("rare").alias("code")).groupBy("row", "code").agg(F.count("*").alias("times"))
    more = links.join(rare, "code").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum")
    )
    whole = found.join(more, "row", "left")
    for name, extra in (("n_best", "more_best"), ("count_sum", "more_sum")):
        whole = whole.withColumn(name, F.col(name) + F.coalesce(extra, F.lit(0)))
    return whole.select(*columns[1:], "n_best", "count_sum")

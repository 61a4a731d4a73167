"""Packing of token sequences: overlong documents are cut into full windows, the rest is packed best fit, decreasing.

Documents become token ids, with a separator at the end. A document of a window or more gives full windows, which are
sequences of their own; what is left of it, like every shorter document, is a piece of less than a window. Pieces are
dealt out evenly, and each task packs its own, longest first, each into the tightest open sequence: a segment tree over
remaining capacities finds it in a few steps. A task ends with at most a few loose sequences, so dealing out costs next
to no padding as long as each gets some thousand pieces.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm import frames

WINDOW = 1024
SEPARATOR = 0
CACHE = 100_000  # words whose ids a task remembers
PIECES = 1 << 16  # pieces that are packed together, about

# Code points for which the classes below are those of the vocabulary: ASCII, letters of Latin-1, common punctuation
_PLAIN = re.compile("[\x00-\x1b\x20-\xa0À-ÖØ-öø-ÿ\u2010-\u2027]*")
# How the vocabulary parts a text, over those code points
_PARTS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÿ]+| ?[0-9]+"
    r"| ?[^\s0-9A-Za-zÀ-ÿ]+|\s+(?!\S)|\s+"
)


class Encoder:
    """Ids of a byte-level BPE vocabulary, equal to those of its tokenizer file with add_special_tokens=False.

    Words are looked up once and remembered; a text with letters beyond Latin-1 goes through the vocabulary's own
    pattern, one that spells out a special token through the tokenizer itself.
    """

    def __init__(self, name: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name.removesuffix(".json") + ".tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("documents", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.file = public_tokenizers.path(name)
        with open(self.file, encoding="utf-8") as entry:
            self.special = [t["content"] for t in json.load(entry).get("added_tokens", [])]
        self.known: dict[str, bytes] = {}

    @cached_property
    def tokenizer(self):
        """The tokenizer itself, which few texts need."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _PLAIN.fullmatch(text) is None:
            return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()
        words = _PARTS.findall(text)
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > CACHE:
                self.known.clear()
            return b"".join(map(self._word, words))

    def _word(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = np.array(self.encoding.encode_ordinary(word), "<u4").tobytes()
            if len(word) <= 40:
                self.known[word] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(name)


class Sequences:
    """Open sequences by remaining capacity, with a segment tree over the capacities that finds the tightest fit."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.window = window
        self.filled = bytearray(2 * self.leaves)  # does a node hold any open sequence?
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]
        self.count = 0

    def _mark(self, capacity: int, filled: int) -> None:
        node = self.leaves + capacity
        self.filled[node] = filled
        while node > 1:
            node >>= 1
            now = self.filled[2 * node] | self.filled[2 * node + 1]
            if self.filled[node] == now:
                return
            self.filled[node] = now

    def _tightest(self, need: int) -> int:
        """Smallest capacity of at least `need` with an open sequence; -1 if there is none."""
        node = self.leaves + need
        if self.filled[node]:
            return need
        while node > 1:
            if not node & 1 and self.filled[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node + (not self.filled[2 * node])
                return node - self.leaves
            node >>= 1
        return -1

    def put(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece."""
        capacity = self._tightest(length)
        if capacity < 0:
            capacity, sequence = self.window, self.count
            self.count += 1
        else:
            sequence = self.open[capacity].pop()
            if not self.open[capacity]:
                self._mark(capacity, 0)
        left = capacity - length
        if left:
            self.open[left].append(sequence)
            if len(self.open[left]) == 1:
                self._mark(left, 1)
        return sequence, self.window - capacity


_CUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def _cut(batches, tokenizer: str, window: int, with_ids: bool):
    reading = encoder(tokenizer)
    encode = reading.ids
    end = np.array([SEPARATOR], "<u4").tobytes()
    for batch in batches:
        rows, held = [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = encode(text.as_py() or "") + end
            n = len(ids) // 4
            for a in range(0, n, window):
                piece = ids[4 * a : 4 * (a + window)]
                rows.append((doc, a, len(piece) // 4, zlib.crc32(piece), n, piece if with_ids else None))
                held += len(piece) * with_ids
            if len(rows) >= 20_000 or held > 1 << 25:
                yield pa.RecordBatch.from_pydict(dict(zip(_CUT.names, map(list, zip(*rows, strict=True)), strict=True)), _CUT)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(_CUT.names, map(list, zip(*rows, strict=True)), strict=True)), _CUT)
    reading.known.clear()  # the words, not the vocabulary: workers outlive a task


def _placed(batches, window: int):
    """Best fit over the pieces of one task, which come longest first."""
    sequences = Sequences(window)
    for batch in batches:
        share = batch.column(0).to_pylist()
        placed = [sequences.put(n) for n in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[1:],
                pa.array([(s << 40) | q for s, (q, _) in zip(share, placed, strict=True)], pa.int64()),
                pa.array([o for _, o in placed], pa.int64()),
            ],
            [*batch.schema.names[1:], "sequence_id", "offset"],
        )


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", window: int = WINDOW, with_ids: bool = False
) -> DataFrame:
    """Pieces: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and `ids` if asked for.

    `start` counts the ids of the document before the piece, `offset` those of its sequence; no sequence has a gap. A
    null text is packed like an empty one, as its separator alone; rows that repeat an id, and null ids, are packed like
    any other row. Other columns of the input are ignored.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary"
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = texts.mapInArrow(lambda it: _cut(it, tokenizer, window, with_ids), schema)
    if not with_ids:
        pieces = pieces.drop("ids")
    pieces = frames.cut(pieces)
    columns = pieces.columns
    full = pieces.where(F.col("length") == window)
    full = full.select(*columns, (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose = pieces.where(F.col("length") < window)
    shares = max(1, min(-(-loose.count() // PIECES), 1 << 21))
    share = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(shares)).cast("int")
    rest = [c for c in columns if c != "length"]
    dealt = loose.select(share.alias("share"), "length", *rest).repartitionById(shares, F.col("share"))
    dealt = dealt.sortWithinPartitions(F.desc("length"), "doc_id", "start")
    kinds = dict(pieces.dtypes)
    out = ", ".join(f"{c} {kinds[c]}" for c in ["length", *rest]) + ", sequence_id long, offset long"
    placed = dealt.mapInArrow(lambda it: _placed(it, window), out).select(*columns, "sequence_id", "offset")
    return full.union(placed)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences of `pack(..., with_ids=True)`, ids as little-endian unsigned 32-bit."""
    return pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select(
        "sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids")
    )

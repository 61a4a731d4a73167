"""Packing into few sequences: a first packing, improved by moves and exchanges until sequences come empty.

Documents become token ids with a separator at the end; longer ones give full pieces, which are sequences of their own,
and a shorter first piece. Short pieces are dealt out evenly, and each task packs its own best fit, decreasing. Then a
local search works on the sequences that are not full, fullest first: a piece moves over from an emptier one, or is
exchanged one for one, two for one or one for two, so that the sum of squared fills grows. What does not fit together so
drains the emptiest sequences, until they hold nothing and are gone. Sequences that no task could fill go on to the next
round, in fewer tasks, with the pieces they hold.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm import frames
from shelfline.llm.packing import SEPARATOR, Encoder, encoder

WINDOW = 2048
PIECES = 1 << 16  # pieces that are packed together, about


def best_fit(lengths: list[int], window: int) -> list[list[int]]:
    """Sequences of piece numbers, by best fit over falling lengths: the first packing that the search improves."""
    free: list[int] = []  # room of open sequences, ascending; the pieces of each room wait in `open_`
    open_: dict[int, list[list[int]]] = defaultdict(list)
    out: list[list[int]] = []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[piece]
        at = bisect_left(free, need)
        if at == len(free):
            room, sequence = window, []
            out.append(sequence)
        else:
            room = free[at]
            sequence = open_[room].pop()
            if not open_[room]:
                free.pop(at)
        sequence.append(piece)
        room -= need
        if room:
            if not open_[room]:
                insort(free, room)
            open_[room].append(sequence)
    return out


class Offers:
    """What sequences hold, by length: of each length the emptiest holder first."""

    def __init__(self) -> None:
        self.sizes: list[int] = []  # lengths at hand, ascending
        self.places: dict[int, list[tuple]] = defaultdict(list)  # length: heap of (fill, bin, *pieces)

    def add(self, length: int, entry: tuple) -> None:
        at = self.places[length]
        if not at:
            insort(self.sizes, length)
        heapq.heappush(at, entry)

    def drop(self, length: int) -> None:
        del self.places[length]
        self.sizes.pop(bisect_left(self.sizes, length))


class Search:
    """Local search over sequences that are not full. `bins` lists the pieces of each, by number into `lengths`.

    Single pieces and pairs of pieces of one sequence are offered by length, so that a place is held against all other
    sequences at once. A window bounds the pairs of a sequence: there are no more sums of two lengths than tokens in it.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], window: int) -> None:
        self.bins, self.lengths, self.window = bins, lengths, window
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.singles, self.pairs = Offers(), Offers()
        self.home = {i: n for n, b in enumerate(bins) for i in b}
        for n in range(len(bins)):
            self._offer(n)

    def _offer(self, place: int) -> None:
        """Lets the others take pieces of a sequence; entries from before it changed are passed over."""
        fill, by_length = self.fill[place], defaultdict(list)
        for i in self.bins[place]:
            self.singles.add(self.lengths[i], (fill, place, i))
            by_length[self.lengths[i]].append(i)
        sizes = sorted(by_length)
        sums = {2 * n: tuple(by_length[n][:2]) for n in sizes if len(by_length[n]) > 1}
        sums |= {n + m: (by_length[n][0], by_length[m][0]) for x, n in enumerate(sizes) for m in sizes[x + 1 :]}
        for both, pieces in sums.items():
            self.pairs.add(both, (fill, place, *pieces))

    def _emptiest(self, offers: Offers, length: int, target: int, below: int) -> tuple[int, ...] | None:
        """Pieces of this length in the emptiest sequence with a fill of less than `below`, other than the target."""
        at, kept, found = offers.places[length], [], None
        while at:
            fill, place, *pieces = at[0]
            if self.fill[place] != fill or any(self.home.get(i) != place for i in pieces):
                heapq.heappop(at)
            elif fill >= below:
                break
            elif place == target:
                kept.append(heapq.heappop(at))
            else:
                found = tuple(pieces)
                break
        for entry in kept:
            heapq.heappush(at, entry)
        if not at:
            offers.drop(length)
        return found

    def _largest(self, offers: Offers, target: int, least: int, most: int, gives: int) -> tuple[int, ...] | None:
        """The offer of more than `least` up to `most` tokens, the longest, whose taking, for `gives` tokens in return, pays."""
        at = bisect_left(offers.sizes, most + 1) - 1
        while at >= 0 and offers.sizes[at] > least:
            length = offers.sizes[at]
            # squares grow by 2d(fill - other + d) for d tokens that come in more than go out
            pieces = self._emptiest(offers, length, target, self.fill[target] + length - gives)
            if pieces is not None:
                return pieces
            at = min(at, len(offers.sizes)) - 1
        return None

    def _swap(self, target: int, out: tuple[int, ...], source: int, come: tuple[int, ...]) -> None:
        for pieces, a, b in ((out, target, source), (come, source, target)):
            for i in pieces:
                self.bins[a].remove(i)
                self.bins[b].append(i)
                self.home[i] = b
        gain = sum(self.lengths[i] for i in come) - sum(self.lengths[i] for i in out)
        self.fill[target] += gain
        self.fill[source] -= gain
        for n in (target, source):
            if self.fill[n] < self.window:
                self._offer(n)
            else:
                for i in self.bins[n]:
                    self.home.pop(i)

    def _step(self, target: int) -> bool:
        """The change that fills the target most: a move, else an exchange of one for one, two for one, one for two."""
        room, lengths = self.window - self.fill[target], self.lengths
        best: tuple[int, tuple[int, ...], tuple[int, ...]] | None = None  # gain, what goes, what comes
        mine = sorted({lengths[i]: i for i in self.bins[target]}.items())  # one piece of each length is enough
        ones = [(n, (i,)) for n, i in mine]
        twos = {n + m: (i, j) for x, (n, i) in enumerate(mine) for m, j in mine[x + 1 :]}
        for offers, places in ((self.singles, [(0, ()), *ones, *twos.items()]), (self.pairs, ones)):
            for length, out in places:
                gain = best[0] if best else 0
                if gain == room:
                    break
                come = self._largest(offers, target, length + gain, length + room, length)
                if come is not None:
                    best = sum(lengths[i] for i in come) - length, out, come
        if best is None:
            return False
        self._swap(target, best[1], self.home[best[2][0]], best[2])
        return True

    def run(self) -> list[list[int]]:
        """The sequences that are left. Every change makes the sum of squared fills grow, so the search ends."""
        while True:
            before = sum(f * f for f in self.fill)
            order = sorted((n for n, b in enumerate(self.bins) if b and self.fill[n] < self.window), key=lambda n: (-self.fill[n], n))
            for target in order:
                while self.bins[target] and self.fill[target] < self.window and self._step(target):
                    pass
            if sum(f * f for f in self.fill) == before:
                return [b for b in self.bins if b]


_CUT = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]


def _cut(batches, tokenizer: str, window: int, with_ids: bool):
    schema = pa.schema(_CUT)
    reading: Encoder = encoder(tokenizer)
    end = np.array([SEPARATOR], "<u4").tobytes()
    for batch in batches:
        rows, held = [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = reading.ids(text.as_py() or "") + end
            n = len(ids) // 4
            edges = [0, *range(n % window or min(n, window), n + 1, window)]
            for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                part = ids[4 * a : 4 * b]
                rows.append((doc, k, a, b - a, zlib.crc32(part), part if with_ids else None))
                held += len(part) * with_ids
            if len(rows) >= 20_000 or held > 1 << 25:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema)
    reading.known.clear()  # the words, not the vocabulary: workers outlive a task


def packed(lengths: list[int], homes: list[int | None], window: int = WINDOW) -> list[list[int]]:
    """Sequences of piece numbers. Pieces with a home start in that sequence, the others are packed best fit first."""
    given: dict[int, list[int]] = defaultdict(list)
    for i, home in enumerate(homes):
        if home is not None:
            given[home].append(i)
    fresh = [i for i, home in enumerate(homes) if home is None]
    bins = [*given.values(), *([fresh[i] for i in b] for b in best_fit([lengths[i] for i in fresh], window))]
    full = [b for b in bins if sum(lengths[i] for i in b) == window]
    open_ = [b for b in bins if sum(lengths[i] for i in b) < window]
    return full + Search(open_, lengths, window).run()


def _packed(batches, window: int):
    """The pieces of one task, in its sequences: number, offset, and whether the sequence is full."""
    batches = list(batches)  # numbers only, of about PIECES pieces
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    share = table.column("share").to_numpy()
    keys, lengths, homes = (table.column(c).to_pylist() for c in ("key", "length", "home"))
    for one in np.unique(share).tolist():
        mine = np.flatnonzero(share == one).tolist()
        mine.sort(key=lambda i: (-lengths[i], keys[i]))
        rows = []
        for n, sequence in enumerate(packed([lengths[i] for i in mine], [homes[i] for i in mine], window)):
            offset, pieces = 0, [mine[i] for i in sequence]
            total = sum(lengths[i] for i in pieces)
            for i in pieces:
                rows.append((keys[i], lengths[i], (one << 24) | n, offset, total == window))
                offset += lengths[i]
        names = ["key", "length", "home", "offset", "full"]
        kinds = pa.schema([("key", pa.int64()), ("length", pa.int64()), ("home", pa.int64()), ("offset", pa.int64()), ("full", pa.bool_())])
        for at in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows[at : at + 20_000], strict=True)), strict=True)), kinds)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", window: int = WINDOW, with_ids: bool = False
) -> DataFrame:
    """Pieces: (doc_id, piece, start, length, ids_crc32, sequence_id, offset), and `ids` if asked for.

    Only documents of more than a window are cut, into full pieces after a first one that may be shorter. `start` counts
    the ids of the document before the piece, `offset` those of its sequence; no sequence has a gap. A null text is packed
    like an empty one, as its separator alone; rows that repeat an id, and null ids, are packed like any other row. An
    empty table gives no pieces. Other columns of the input are ignored.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = texts.mapInArrow(lambda it: _cut(it, tokenizer, window, with_ids), schema)
    if not with_ids:
        pieces = pieces.drop("ids")
    pieces = frames.cut(pieces.withColumn("key", F.monotonically_increasing_id()))
    columns = [c for c in pieces.columns if c != "key"]
    full = pieces.where(F.col("length") == window)
    full = full.select(*columns, (F.lit(-1) - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = pieces.where(F.col("length") < window)
    left = short.select("key", "length", F.lit(None).cast("long").alias("home"))
    number, rounds, done = left.count(), 0, []
    while True:
        shares = max(1, -(-number // PIECES))
        # whole sequences go to one task, pieces without one anywhere
        share = F.pmod(F.xxhash64(F.coalesce("home", "key"), F.lit(rounds)), F.lit(shares)).cast("int")
        dealt = left.select(share.alias("share"), "key", "length", "home").repartitionById(shares, F.col("share"))
        found = frames.cut(dealt.mapInArrow(lambda it: _packed(it, window), "key long, length long, home long, offset long, full boolean"))
        again = found.where("NOT full")
        still = again.count()
        settled = shares == 1 or 2 * still > number
        done.append((found if settled else found.where("full")).withColumn("round", F.lit(rounds).cast("long")))
        if settled:
            break
        left, number, rounds = again.select("key", "length", "home"), still, rounds + 1
    places = done[0]
    for more in done[1:]:
        places = places.union(more)
    places = places.select("key", (F.col("home") * 64 + F.col("round")).alias("sequence_id"), "offset")
    placed = short.join(places, "key").select(*columns, "sequence_id", "offset")
    return full.union(placed)


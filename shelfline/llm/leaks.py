"""Benchmark passages in documents, up to an edit distance in words.

An item of n words may have k = tolerance * n edits. The CGK random walk turns edit distance into Hamming distance: in
step j the walk writes the word it stands at and moves on or stays, as a hash of the step and the word says. Bit sampling
keeps a few steps of the walk, in as many repetitions as the wanted recall needs: for each size of items there is a table
from the sampled steps to the items that have them. Windows of that size are walked, their steps are looked up in the
table, and the items found are verified by exact edit distance.

Walking every window of every document would cost thousands of steps a word. Cut into k + 1 pieces, an item that is there
with k edits has one piece unchanged, so windows of a size are walked only where a piece of an item of that size stands;
this loses nothing, and it says where to look, not what is found.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.text import NOT_ALNUM, mix, words_of

_U = np.uint64
TOLERANCE = 0.2
RECALL = 0.999
BLOCK_WORDS = 1 << 18  # words of the windows that are walked at once, about
SAMPLED = 3  # steps of the walk that one repetition compares
AGREE = 0.55  # least share of steps in which the walks of a leaked copy and its item agree
ITEM_WORDS = 2_000_000  # words of the benchmark that are sent to the tasks at once; more are taken in blocks

FOUND = "doc_id long, item_id long, start long, end long, distance long"


def repetitions(recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - AGREE**SAMPLED))


def embed(windows: np.ndarray, seeds: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """What CGK walks meet at some steps: (window, seed, sample), for steps (seed, sample) and windows of equal size.

    Windows are given as word hashes; 0 stands for the end. Of a walk of three times the window's size only these steps
    are held.
    """
    count, size = windows.shape
    padded = np.concatenate([windows, np.zeros((count, 1), _U)], axis=1)
    at = np.zeros((count, len(seeds)), np.int64)
    rows = np.arange(count)[:, None]
    out = np.empty((count, *steps.shape), _U)
    for j in range(3 * size):
        word = padded[rows, at]
        seed, sample = np.nonzero(steps == j)
        out[:, seed, sample] = word[:, seed]
        move = (mix(word + seeds[None, :] + _U(j * 0x9E3779B97F4A7C15 % (1 << 64))) & _U(1)).astype(np.int64)
        at = np.minimum(at + move, size)
    return out


class Items:
    """Benchmark items as word hashes, with their pieces and the sampled steps of their walks."""

    def __init__(self, ids: list[int], texts: list[str], tolerance: float, recall: float, seed: int = 7) -> None:
        self.ids, self.words, self.edits = [], [], []
        for row, end, words in words_of(pa.array(texts, pa.string()), NOT_ALNUM, lower=True):
            hashes = words.hashes()
            for i in range(end - row):
                item = hashes[words.first[i] : words.first[i + 1]]
                if len(item):
                    self.ids.append(ids[row + i]), self.words.append(item), self.edits.append(int(tolerance * len(item)))
        random = np.random.default_rng(seed)
        turns = repetitions(recall)
        self.seeds = random.integers(1, 1 << 63, turns, dtype=np.uint64)
        self.steps = random.random((turns, SAMPLED))
        # pieces by length: hash, size of the item, place of the piece in the item; items of one size share a piece
        pieces: dict[int, list[tuple[int, int]]] = {}
        for i, (item, k) in enumerate(zip(self.words, self.edits, strict=True)):
            size = len(item) // (k + 1)
            pieces.setdefault(size, []).extend((i, j * size) for j in range(k + 1))
        self.pieces = {}
        for size, places in pieces.items():
            value = _grams(np.concatenate([self.words[i][a : a + size] for i, a in places]).reshape(-1, size))
            of, at = (np.array(x, np.int64) for x in zip(*[(len(self.words[i]), a) for i, a in places], strict=True))
            order = np.lexsort((at, of, value))
            first = np.append(True, (np.diff(value[order]) != 0) | (np.diff(of[order]) != 0) | (np.diff(at[order]) != 0))
            self.pieces[size] = tuple(x[order][first] for x in (value, of, at))
        # tables by size of the items: keys of the sampled steps, ascending, and the items that have them
        sizes = np.array([len(item) for item in self.words], np.int64)
        self.tables = {}
        for size in np.unique(sizes).tolist():
            which = np.flatnonzero(sizes == size)
            keys = np.concatenate([self.keys(self.words[i][None, :]) for i in which])
            order = np.argsort(keys, axis=None, kind="stable")
            self.tables[size] = (keys.ravel()[order], np.repeat(which, keys.shape[1])[order])

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """(window, repetition): what the sampled steps of each repetition amount to."""
        sampled = self.sampled(windows)
        keys = _grams(sampled.reshape(-1, sampled.shape[2])).reshape(sampled.shape[:2])
        return mix(keys + self.seeds[None, :])

    def found(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) wherever an item of the windows' size has the same sampled steps in a repetition."""
        value, which = self.tables[windows.shape[1]]
        keys = self.keys(windows)
        left, right = (np.searchsorted(value, keys.ravel(), side) for side in ("left", "right"))
        some = np.flatnonzero(left < right)
        window, times = some // keys.shape[1], (right - left)[some]
        pick = np.repeat(left[some], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        pairs = np.unique(np.repeat(window, times) + which[pick] * len(windows))
        return pairs % len(windows), pairs // len(windows)

    def sampled(self, windows: np.ndarray) -> np.ndarray:
        return embed(windows, self.seeds, (self.steps * (3 * windows.shape[1])).astype(np.int64))


def _grams(rows: np.ndarray) -> np.ndarray:
    value = np.zeros(len(rows), _U)
    for j in range(rows.shape[1]):
        value = mix(value * _U(0xC2B2AE3D27D4EB4F) + rows[:, j] + _U(1))
    return value


def edit_distance(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end): least edits between the item and any stretch of the words; the earliest end wins, then
    the shortest stretch."""
    n = len(words)
    cost, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    at = np.arange(n + 1)
    for i, word in enumerate(item, 1):
        swap = cost[:-1] + (words != word)
        drop = cost[1:] + 1
        step = np.append(i, np.minimum(swap, drop))
        came = np.append(0, np.where(swap <= drop, origin[:-1], origin[1:]))
        # going right costs one each: the running minimum of (cost - place) tells from where
        lead = np.minimum.accumulate((step - at) * (n + 2) + (n - at))
        place = n - lead % (n + 2)
        place = np.where((place < 0) | (place > at), at, place)
        cost = step[place] + at - place
        origin = came[place]
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


def _search(batches, items: Items):
    for batch in batches:
        out = []
        for row, end, words in words_of(batch.column(1), NOT_ALNUM, lower=True):
            hashes = words.hashes()
            ids = batch.column(0).slice(row, end - row).to_pylist()
            owner = np.repeat(np.arange(end - row), np.diff(words.first))
            hits = []
            for size, (value, of, at) in items.pieces.items():
                starts = np.arange(max(0, len(hashes) - size + 1))
                starts = starts[owner[starts] == owner[starts + size - 1]] if len(starts) else starts
                if not len(starts):
                    continue
                grams = np.zeros(len(starts), _U)
                for j in range(size):
                    grams = mix(grams * _U(0xC2B2AE3D27D4EB4F) + hashes[starts + j] + _U(1))
                left, right = np.searchsorted(value, grams, "left"), np.searchsorted(value, grams, "right")
                some = np.flatnonzero(left < right)
                times = (right - left)[some]
                pick = np.repeat(left[some], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                hits.append(np.stack([of[pick], owner[np.repeat(starts[some], times)], np.repeat(starts[some], times) - at[pick]]))
            if not hits:
                continue
            hits = np.unique(np.concatenate(hits, axis=1), axis=1)
            for size in np.unique(hits[0]).tolist():
                mine = hits[:, hits[0] == size]
                out += _verified(items, size, mine[1], mine[2], hashes, words.first, ids)
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), pa.int64()) for c in columns], ["doc_id", "item_id", "start", "end", "distance"]
        )


def _verified(items: Items, size: int, owner, starts, hashes, first, ids) -> list[tuple]:
    """Leaks of items of one size among windows that start at these places (indices of all words; they may hang over)."""
    out, last = [], {}
    block = max(1, min(512, BLOCK_WORDS // size))
    for a in range(0, len(starts), block):
        who, begin = owner[a : a + block], starts[a : a + block]
        at = begin[:, None] + np.arange(size)
        inside = (at >= first[who][:, None]) & (at < first[who + 1][:, None])
        windows = np.where(inside, hashes[np.clip(at, 0, len(hashes) - 1)], _U(1))
        for j, i in zip(*(x.tolist() for x in items.found(windows)), strict=True):
            item, k, d, s = items.words[i], items.edits[i], int(who[j]), int(begin[j])
            if last.get(i, (-1, -1)) > (d, s):  # inside a leak that is known
                continue
            lo, hi = max(int(first[d]), s - k), min(int(first[d + 1]), s + size + k)
            distance, x, y = (0, s - lo, s - lo + size) if (windows[j] == item).all() else edit_distance(item, hashes[lo:hi])
            if distance <= k:
                out.append((ids[d], items.ids[i], lo + x - int(first[d]), lo + y - int(first[d]), distance))
                last[i] = (d, lo + y)
    return out


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    tolerance: float = TOLERANCE, recall: float = RECALL,
) -> DataFrame:
    """(doc_id, item_id, start, end, distance): where documents hold an item, in words, from 0.

    Words are runs of letters and digits, lower-cased. Items without a word, null texts and empty tables find nothing; a
    null document id is reported as null. An item that is repeated under two ids is found under both, and repeated
    documents have their leaks each. Texts of any length are searched whole. Other columns of the inputs are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * ITEM_WORDS)))
    found = None
    for block in range(blocks):
        some: pd.DataFrame = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").toPandas()
        known = Items(some["item_id"].tolist(), some["text"].tolist(), tolerance, recall)
        rows = texts.mapInArrow(lambda it, known=known: _search(it, known), FOUND)
        found = rows if found is None else found.union(rows)
    return found

"""Text quality by support vectors on naive Bayes features.

Features are indicators of n-grams: of words, and of word shapes (case, digits, final signs, length, repetition), with
the share of each shape in coarse steps. Every indicator is scaled by its log-count ratio between the classes, a row by
the root of its number of features, and a linear hinge-loss model is fitted by dual coordinate descent. Margins become
scores by a logistic curve fitted to margins of rows the curve has not been trained on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm import frames
from shelfline.llm.text import SPACES, Words, mix, words_of

_U = np.uint64
LEARNED_ROWS = 6_000  # labelled rows a model learns from, about: those with the smallest hashes of their ids
SHAPES = 1 << 15  # places for features of shapes
PLACES = 1 << 17  # all places
STEPS = np.array([0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])  # shares of a shape among a text's words


def _classes() -> np.ndarray:
    kind = np.full(256, 5, np.uint8)  # other signs
    kind[ord("a") : ord("z") + 1] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[128:] = 3
    kind[[ord(c) for c in ".,;:"]] = 4
    return kind


_KIND = _classes()


def _shapes(words: Words, hashes: np.ndarray) -> np.ndarray:
    """A small number for each word: its case, digits, signs at the end, length, and whether it repeats the word before."""
    kind = _KIND[words.data]
    size = words.ends - words.starts

    def count(which: int) -> np.ndarray:
        sums = np.zeros(len(kind) + 1, np.int32)
        np.cumsum(kind == which, out=sums[1:])
        return sums[words.ends] - sums[words.starts]

    upper, digits, stops, signs = count(1), count(2), count(4), count(5)
    case = np.where(upper == 0, 0, np.where((upper == 1) & (kind[words.starts] == 1), 1, np.where(upper * 2 > size, 3, 2)))
    length = np.searchsorted([1, 3, 6, 10, 16], size)
    again = np.zeros(len(size), np.int64)
    again[1:] = hashes[1:] == hashes[:-1]
    again[words.first[:-1][words.first[:-1] < len(size)]] = 0
    last = kind[words.ends - 1].astype(np.int64)
    code = case
    for value, base in ((length, 6), (again, 2), (np.minimum(digits, 2), 3), (np.minimum(stops, 2), 3), (np.minimum(signs, 3), 4), (last, 6)):
        code = code * base + value
    return code


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature places of each text, and the index of each text's first one."""
    texts = len(words.first) - 1
    hashes = words.hashes()
    owner = np.repeat(np.arange(texts), np.diff(words.first))
    shape = _shapes(words, hashes) if len(hashes) else np.zeros(0, np.int64)
    spread = mix(shape.astype(_U) + _U(1))
    found = [(np.arange(texts), np.full(texts, 1, np.int64))]  # of every text, so that an empty one has a feature

    def add(at: np.ndarray, value: np.ndarray, kind: int, low: int, places: int) -> None:
        found.append((at, low + (mix(value + _U(kind)) % _U(places)).astype(np.int64)))

    for n in (1, 2, 3):
        at, value = words.windows(spread, n)
        add(owner[at], value, n, 2, SHAPES - 2)
    for n in (1, 2):
        at, value = words.windows(hashes, n)
        add(owner[at], value, 10 + n, SHAPES, PLACES - SHAPES)
    if len(hashes):
        key, count = np.unique(owner * (1 << 40) + shape, return_counts=True)
        who = key >> 40
        step = np.searchsorted(STEPS, count / np.diff(words.first)[who])
        for level in range(1, len(STEPS) + 1):  # at least this share
            some = step >= level
            add(who[some], mix((key[some] & ((1 << 40) - 1)).astype(_U) * _U(64) + _U(level)), 20, 2, SHAPES - 2)
    size = np.searchsorted([0, 5, 20, 50, 100, 200, 500, 2000], np.diff(words.first))
    add(np.arange(texts), size.astype(_U), 30, 2, SHAPES - 2)
    who, place = (np.concatenate([f[i] for f in found]) for i in range(2))
    key = np.unique(who * PLACES + place)
    return key % PLACES, np.searchsorted(key // PLACES, np.arange(texts + 1))


@dataclass
class Model:
    weights: np.ndarray  # of the indicators, log-count ratios included
    bias: float
    slope: float
    shift: float

    def scores(self, places: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(places) + 1)
        np.cumsum(self.weights[places], out=sums[1:])
        count = np.diff(first)
        margin = (sums[first[1:]] - sums[first[:-1]]) / np.sqrt(np.maximum(count, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def ratios(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log-count ratio of each place between the classes."""
    logs = []
    for value in (1, 0):
        mine = [r for r, y in zip(rows, labels, strict=True) if y == value]
        counts = np.bincount(np.concatenate(mine), minlength=PLACES) if mine else np.zeros(PLACES)
        logs.append(np.log((counts + smooth) / (len(mine) + 2 * smooth)))
    return logs[0] - logs[1]


def descend(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear hinge-loss model, by dual coordinate descent; both classes weigh the same."""
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.where(labels == 1, len(labels) / (2 * max(1, (labels == 1).sum())), len(labels) / (2 * max(1, (labels == 0).sum())))
    values = [scale[r] / np.sqrt(len(r)) for r in rows]
    norm = np.array([v @ v + 1.0 for v in values])  # the bias is one more feature of value 1
    dual, weights, bias = np.zeros(len(rows)), np.zeros(PLACES), 0.0
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            slack = sign[i] * (weights[rows[i]] @ values[i] + bias) - 1
            now = min(max(dual[i] - slack / norm[i], 0.0), cost * share[i])
            if now != dual[i]:
                step = (now - dual[i]) * sign[i]
                weights[rows[i]] += step * values[i]
                bias += step
                dual[i] = now
    return weights, bias


def curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to the share of label 1, by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((labels - p) * margins).sum() - 1e-3 * a, (labels - p).sum()])
        h = np.array([[(w * margins**2).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return a, b


def _fitted(table: pa.Table) -> Model:
    order = np.argsort(table.column("h").to_numpy(), kind="stable")
    labels = table.column("label").to_numpy()[order]
    blobs = table.column("places")
    rows = [np.frombuffer(blobs[int(i)].as_py(), np.int32) for i in order]
    if len(set(labels.tolist())) < 2:  # nothing to tell apart: the share of label 1, or even odds
        return Model(np.zeros(PLACES), 0.0, 0.0, 4.0 if len(labels) and labels[0] == 1 else -4.0 if len(labels) else 0.0)
    part = np.arange(len(rows)) % 3
    margins = np.zeros(len(rows))
    for turn in range(3):  # margins for the curve come from models that have not seen the row
        seen = [i for i in range(len(rows)) if part[i] != turn]
        if len(set(labels[seen].tolist())) < 2:
            continue
        scale = ratios([rows[i] for i in seen], labels[seen])
        weights, bias = descend([rows[i] for i in seen], labels[seen], scale, epochs=6)
        for i in np.flatnonzero(part == turn):
            margins[i] = (weights[rows[i]] * scale[rows[i]]).sum() / np.sqrt(len(rows[i])) + bias
    scale = ratios(rows, labels)
    weights, bias = descend(rows, labels, scale)
    return Model(weights * scale, bias, *curve(margins, labels.astype(float)))


def _featured(batches):
    for batch in batches:
        for row, end, words in words_of(batch.column(2), SPACES):
            places, first = features(words)
            blobs = [places[a:b].astype(np.int32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.array(blobs, pa.binary())], ["h", "label", "places"]
            )


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = LEARNED_ROWS
) -> Model:
    """A model of label 1, learned from about `rows` labelled texts, which a single task can hold.

    Labels other than 0 and 1, null labels and null texts teach nothing, nor do ids with both labels; a label that is
    given twice counts once. Without a label of either kind every score is 0.5. Texts of any length count whole.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("label IN (0, 1) AND _id IS NOT NULL").groupBy("_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    known = known.where("label = other").drop("other").withColumn("h", F.xxhash64("_id"))
    known = frames.cut(known)
    total = max(1, known.count())
    if total > rows:
        known = known.where(F.pmod("h", F.lit(1 << 40)) < int(rows / total * (1 << 40)))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    joined = texts.join(F.broadcast(known), "_id").select("h", "label", "text")  # about `rows` rows of three numbers
    table = joined.mapInArrow(_featured, "h long, label int, places binary").toArrow()
    return _fitted(table)


def _scored(batches, model: Model):
    for batch in batches:
        scores = [np.zeros(0)]
        for _, _, words in words_of(batch.column(1), SPACES):
            scores.append(model.scores(*features(words)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores))], ["doc_id", "score"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score), one row for each input row: the higher, the likelier label 1.

    A null text is scored like an empty one. Rows are independent of each other; other columns are ignored.
    """
    send = docs.sparkSession.sparkContext.broadcast(model)  # PLACES numbers
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(lambda it: _scored(it, send.value), "doc_id long, score double")

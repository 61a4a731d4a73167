"""Language of texts and of their spans: script ranges, per-word scores, and a Viterbi path with a switching penalty.

A model holds, per language, log probabilities of the character n-grams of words, and the scripts its words use. A word
is scored only for languages that use its script. The path through the words of a text pays a penalty for each change of
language, so single borrowed words do not split a span, and longer foreign passages do.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.llm import frames

UNKNOWN = "und"
GRAMS = (1, 2, 3)
LEARNED_ROWS = 5_000  # labelled texts a model learns from, about: those with the smallest hashes of their ids
PENALTY = 12.0  # of a change of language, in units of log probability
FLOOR = 1.5 * PENALTY  # lowest score of a word: less than two changes cost, so no single word pays for them
SCORED = 1 << 14  # words that are scored at once
SLOTS = 1 << 21  # of the table in which n-grams are looked up first
BLOCK = 1 << 20  # characters of text that are read at once, about; a longer text is a block of its own

# First and last code points of scripts
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x531, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)],
}

LONG = 40  # characters of a word whose n-grams count; the words of unspaced scripts are cut at this length
_U = np.uint64


WORD = re.compile(r"[^\W\d_]+")


def script_of(word: str) -> str:
    at = ord(word[0])
    return next((name for name, spans in SCRIPTS.items() if any(a <= at <= b for a, b in spans)), "other")


def words_in(text: str | None) -> list[str]:
    found = WORD.findall((text or "").lower())
    if not "".join(found).isalpha() and found:  # numbers such as ² and Ⅷ are no letters
        found = [w for x in found for w in ("".join(c if c.isalpha() else " " for c in x).split() if not x.isalpha() else [x])]
    if any(len(w) > LONG for w in found):
        found = [w[i : i + LONG] for w in found for i in range(0, len(w), LONG)]
    return found


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first): the character n-grams of all words, a blank at either end, each as one number; those of word i are
    codes[first[i]:first[i + 1]]. A code holds the characters of its n-gram, so different n-grams have different codes."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    if not len(sizes):
        return np.zeros(0, _U), np.zeros(1, np.int64)
    points = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), "<u4").astype(_U)
    last = np.cumsum(sizes)
    left = np.repeat(last, sizes) - np.arange(len(points))  # characters up to the end of the word
    found, of = [], []
    owner = np.repeat(np.arange(len(words)), sizes)
    code = points.copy()
    for n in range(1, max(GRAMS) + 1):
        if n > 1:
            code = (code[:-1] << _U(21)) | points[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(left[: len(code)] >= n)
            found.append(code[at]), of.append(owner[at])
    order = np.argsort(np.concatenate(of), kind="stable")
    counts = np.bincount(np.concatenate(of), minlength=len(words))
    return np.concatenate(found)[order], np.append(0, np.cumsum(counts))


_COUNTS = pa.schema([("lang", pa.string()), ("script", pa.string()), ("code", pa.int64()), ("n", pa.int64())])


def _counted(batches):
    """Words per script, and n-grams, of each language in a task."""
    for batch in batches:
        words: dict[str, Counter] = {}
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(words_in(text.as_py()))
        for lang, counts in words.items():
            scripts: Counter = Counter()
            for word, n in counts.items():
                scripts[script_of(word)] += n
            found, first = codes(list(counts))
            values, place = np.unique(found, return_inverse=True)
            weights = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), np.diff(first))
            sums = np.bincount(place, weights, len(values)).astype(np.int64)
            k = len(scripts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (k + len(values)), pa.string()),
                    pa.array([*scripts, *[None] * len(values)], pa.string()),
                    pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(values.astype(np.int64))]),
                    pa.concat_arrays([pa.array(list(scripts.values()), pa.int64()), pa.array(sums)]),
                ],
                schema=_COUNTS,
            )


@dataclass
class Model:
    languages: list[str]
    index: np.ndarray  # codes of the n-grams, ascending
    logs: np.ndarray  # log probability of each per language; the last row is that of an unseen n-gram
    scripts: dict[str, np.ndarray]  # script: which languages use it

    def __post_init__(self) -> None:
        self.usable: dict[str, np.ndarray] = {}  # by first letter of a word
        # most n-grams are found in the slot of their hash, those that share a slot by search
        slots = self._slot(self.index)
        self.slots = np.full(SLOTS, len(self.index), np.int32)
        self.slots[slots] = np.arange(len(self.index))
        self.shared = np.zeros(SLOTS, bool)
        self.shared[slots[self.slots[slots] != np.arange(len(self.index))]] = True
        self.padded = np.append(self.index, _U(0))

    @staticmethod
    def _slot(found: np.ndarray) -> np.ndarray:
        return ((found * _U(0x9E3779B97F4A7C15)) >> _U(43)).astype(np.int64)

    def places(self, found: np.ndarray) -> np.ndarray:
        """Rows of `logs` for some codes."""
        slots = self._slot(found)
        at = self.slots[slots].astype(np.int64)
        missed = self.padded[at] != found
        again = np.flatnonzero(missed & self.shared[slots])
        at[missed] = len(self.index)
        if len(again):
            searched = np.searchsorted(self.index, found[again])
            at[again] = np.where(self.padded[searched] == found[again], searched, len(self.index))
        return at

    def score(self, words: list[str]) -> np.ndarray:
        """Scores of words, 0 for the best language of each, not below -FLOOR."""
        if len(words) > SCORED:
            return np.concatenate([self.score(words[i : i + SCORED]) for i in range(0, len(words), SCORED)])
        found, first = codes(words)
        total = np.add.reduceat(self.logs[self.places(found)], first[:-1], axis=0)
        total -= total.max(axis=1, keepdims=True)
        usable = np.stack([self._usable(word[0]) for word in words])
        if not usable.all():
            total = np.where(usable, total, -FLOOR)
            total -= total.max(axis=1, keepdims=True)
        return np.maximum(total, -FLOOR)

    def _usable(self, letter: str) -> np.ndarray:
        """Languages that use the script of the letter; all of them for a script that none of them uses."""
        have = self.usable.get(letter)
        if have is None:
            have = self.scripts.get(script_of(letter), np.ones(len(self.languages), bool))
            self.usable[letter] = have
        return have


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = LEARNED_ROWS) -> Model:
    """A model of the languages in `lang_col`, learned from all n-grams of about `rows` texts.

    Rows without a text or a language teach nothing; without any row the model knows no language.
    """
    some = labelled.select(F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    some = some.where("text IS NOT NULL AND lang IS NOT NULL")
    total = max(1, some.select("lang").count())
    if total > rows:
        some = some.where(F.pmod("h", F.lit(1 << 40)) < int(rows / total * (1 << 40)))
    some = some.repartition(32, "h")
    counts = some.select("text", "lang").mapInArrow(_counted, "lang string, script string, code long, n long")
    counts = frames.cut(counts.groupBy("lang", "script", "code").agg(F.sum("n").alias("n")))
    table = counts.where("script IS NULL").select("lang", "code", "n").toPandas()
    used = counts.where("script IS NOT NULL").select("lang", F.col("script").alias("value"), "n").toPandas()
    languages = sorted(set(table["lang"]) | set(used["lang"]))
    index, place = np.unique(table["code"].to_numpy(np.int64), return_inverse=True)
    values = np.full((len(index), len(languages)), 0.5)
    if languages:
        np.add.at(values, (place, np.searchsorted(languages, table["lang"].to_numpy(str))), table["n"].to_numpy(float))
    totals = values.sum(axis=0, keepdims=True) if len(values) else np.ones((1, len(languages)))
    logs = np.log(values / totals)
    scripts = {}
    for name in SCRIPTS:
        share = used[used["value"] == name].set_index("lang")["n"].reindex(languages).fillna(0) / used.groupby("lang")["n"].sum().reindex(languages)
        flags = (share >= 0.01).to_numpy()
        if flags.any():
            scripts[name] = flags
    return Model(languages, index.astype(_U), np.concatenate([logs, np.log(0.5 / totals)]), scripts)


def path(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best language of each word: the path that maximises the sum of scores less a penalty for each change."""
    n, k = scores.shape
    best = int(scores.sum(axis=0).argmax())
    gain = np.zeros((n + 1, k))
    np.cumsum(scores - scores[:, best : best + 1], axis=0, out=gain[1:])
    # no stretch gains half a penalty over the best single language: no change can pay
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty / 2:
        return np.full(n, best)
    value = [0.0] * k
    back = np.empty((n, k), np.int32)
    for i, row in enumerate(scores.tolist()):
        top = max(range(k), key=value.__getitem__)
        floor = value[top] - penalty
        for j in range(k):
            if value[j] >= floor:
                back[i, j] = j
                value[j] += row[j]
            else:
                back[i, j] = top
                value[j] = floor + row[j]
    out = np.empty(n, np.int64)
    at = max(range(k), key=value.__getitem__)
    for i in range(n - 1, -1, -1):
        out[i] = at
        at = back[i, at]
    return out


def paths(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """What `path` gives for several texts, one after another: text i has the rows from starts[i] on, sizes[i] of them.

    The texts, longest first, take each step together.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    steps, k = int(sizes.max(initial=0)), scores.shape[1]
    live = np.searchsorted(-sizes, -np.arange(steps), "left")  # texts with more than so many words
    value = np.zeros((len(sizes), k))
    back, own = [], np.arange(k, dtype=np.int16)[None, :]
    for t in range(steps):
        n = live[t]
        now = value[:n]
        top = now.argmax(axis=1)
        floor = now[np.arange(n), top] - penalty
        stay = now >= floor[:, None]
        back.append(np.where(stay, own, top[:, None]).astype(np.int16))
        value[:n] = np.where(stay, now, floor[:, None]) + scores[starts[:n] + t]
    at = value.argmax(axis=1)
    out = [np.empty(n, np.int64) for n in sizes.tolist()]
    labels = np.empty(int(sizes.sum()), np.int64)
    place = np.cumsum(sizes) - sizes
    for t in range(steps - 1, -1, -1):
        n = live[t]
        labels[place[:n] + t] = at[:n]
        at[:n] = back[t][np.arange(n), at[:n]]
    for i, (a, n) in enumerate(zip(place.tolist(), sizes.tolist(), strict=True)):
        out[i] = labels[a : a + n]
    return np.concatenate([out[i] for i in np.argsort(order)]) if out else labels


def labelled_words(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(languages, first): the language of every word of some texts, by number; those of text i are
    languages[first[i]:first[i + 1]].

    Each distinct word is scored once. A text has its best single language throughout if no stretch gains a penalty over
    it in another language, nor a start and an end together: each stretch in another language costs a change, but for one
    where the best language never comes. The other texts take the best path.
    """
    words: list[str] = []
    first = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        words += words_in(text)
        first[i + 1] = len(words)
    if not words or not model.languages:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    places, distinct = pd.factorize(np.array(words, object))
    scores = model.score(distinct.tolist())[places]
    sums = np.zeros((len(words) + 1, len(model.languages)))
    np.cumsum(scores, axis=0, out=sums[1:])
    best = (sums[first[1:]] - sums[first[:-1]]).argmax(axis=1)  # of equal ones the first
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    labels = best[owner]
    # gains over the best language since the start of the text; each text lies below those before it, so that the running
    # minimum starts anew with it
    drop = 2 * FLOOR * (np.diff(first).max() + 1)
    mixed, filled = np.zeros(len(texts), bool), np.flatnonzero(np.diff(first) > 0)
    heads, tails = np.zeros(len(filled)), np.zeros(len(filled))
    own = sums[:, 0] * 0
    own[1:] = np.cumsum(scores[np.arange(len(words)), labels])
    for k in range(len(model.languages)):
        gain = sums[:, k] - own
        inside = gain[1:] - gain[first[:-1]][owner]
        before = np.minimum(0.0, gain[:-1] - gain[first[:-1]][owner])  # a text starts at 0
        low = np.minimum.accumulate(before - owner * drop) + owner * drop
        mixed[owner[inside - low > PENALTY * 0.999]] = True
        heads = np.maximum(heads, np.maximum.reduceat(inside, first[filled]))
        tails = np.maximum(tails, inside[first[filled + 1] - 1] - np.minimum.reduceat(before, first[filled]))
    mixed[filled[heads + tails > PENALTY * 0.999]] = True
    again = np.flatnonzero(mixed)
    if len(again):
        labels[mixed[owner]] = paths(scores, first[again], first[again + 1] - first[again])
    return labels, first


SPANS = "array<struct<start: int, end: int, lang: string>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])


def _judged(texts: list[str | None], model: Model, with_spans: bool) -> pa.StructArray:
    labels, first = labelled_words(texts, model)
    names = np.array([*model.languages, UNKNOWN], object)
    owner, n = np.repeat(np.arange(len(texts)), np.diff(first)), len(model.languages)
    counts = np.bincount(owner * max(1, n) + labels, minlength=len(texts) * max(1, n)).reshape(len(texts), max(1, n))
    size = np.diff(first)
    top = np.where(size > 0, counts.argmax(axis=1), n)
    share = np.divide(counts.max(axis=1), size, out=np.zeros(len(texts)), where=size > 0)
    arrays, fields = [pa.array(names[top], pa.string()), pa.array(share)], ["lang_pred", "score"]
    if with_spans:
        starts = np.flatnonzero(np.append(True, (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1]))) if len(labels) else labels
        ends = np.append(starts[1:], len(labels))[: len(starts)]
        base = first[owner[starts]] if len(starts) else starts
        spans = pa.StructArray.from_arrays(
            [pa.array((starts - base).astype(np.int32)), pa.array((ends - base).astype(np.int32)), pa.array(names[labels[starts]], pa.string())], fields=list(_SPAN)
        )
        offsets = np.searchsorted(starts, first).astype(np.int32)
        arrays.append(pa.ListArray.from_arrays(pa.array(offsets), spans))
        fields.append("spans")
    return pa.StructArray.from_arrays(arrays, fields)


def _label(batches, model: Model, with_spans: bool, at: int):
    for batch in batches:
        row = 0
        texts = batch.column(at)
        while row < batch.num_rows:
            some, size = [], 0
            while row + len(some) < batch.num_rows and size < BLOCK:
                some.append(texts[row + len(some)].as_py())
                size += len(some[-1] or "")
            kept = batch.slice(row, len(some)).columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, _judged(some, model, with_spans)], batch.schema.names)
            row += len(some)


def label(docs: DataFrame, model: Model, text_col: str = "text", into: str = "language", spans: bool = True) -> DataFrame:
    """Adds a struct column (lang_pred, score, and if asked for spans) to the rows; a column of its name is replaced.

    lang_pred is the language of most words on the best path, of equal ones the first by name, and score its share; `und`
    with score 0 where the text is null or has no letter, or where the model knows no language. Texts of any length are
    read whole; rows are independent of each other, and repeated ones get the same. An empty table gives an empty one.
    """
    send = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the n-grams of LEARNED_ROWS texts
    columns = [c for c in docs.columns if c != into]
    out = ", ".join(f"`{c}` {t}" for c, t in docs.select(*columns).dtypes)
    kind = f"struct<lang_pred: string, score: double{f', spans: {SPANS}' if spans else ''}>"
    if text_col in columns and docs.schema[text_col].dataType == T.StringType():
        at, read = columns.index(text_col), docs.select(*columns, F.lit(None).cast("boolean").alias(into))
    else:
        at, read = len(columns), docs.select(*columns, F.col(text_col).cast("string").alias(into))
    return read.mapInArrow(lambda it: _label(it, send.value, spans, at), f"{out}{', ' if columns else ''}`{into}` {kind}")

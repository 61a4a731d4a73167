"""Packing by local search: whole results, and few sequences beside the fewest possible."""

from __future__ import annotations

import random
import zlib
from itertools import product

import numpy as np
import pytest

from shelfline.llm import swaps

from .conftest import prose


def fewest(lengths, window):
    """By dynamic programming over subsets: (sequences, fill of the last one)."""
    best = [(0, window)] + [(len(lengths) + 1, 0)] * ((1 << len(lengths)) - 1)
    for some in range(1, 1 << len(lengths)):
        for i, n in enumerate(lengths):
            if some >> i & 1:
                bins, fill = best[some ^ 1 << i]
                best[some] = min(best[some], (bins, fill + n) if fill + n <= window else (bins + 1, n))
    return best[-1][0]


def sound(lengths, bins, window):
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(b and sum(lengths[i] for i in b) <= window for b in bins)


@pytest.mark.parametrize("seed", range(6))
def test_never_more_than_best_fit_and_near_the_fewest(seed):
    r, over, worse = random.Random(seed), 0, 0
    for _ in range(40):
        window = r.choice([20, 50, 100])
        lengths = [r.randrange(1, window) for _ in range(r.randrange(1, 11))]
        bins = swaps.packed(lengths, [None] * len(lengths), window)
        sound(lengths, bins, window)
        over += len(bins) - fewest(lengths, window)
        worse += len(bins) > len(swaps.best_fit(lengths, window))
    assert worse == 0 and over <= 1


def test_search_beats_best_fit_where_it_fails():
    r = random.Random(8)
    lengths = [r.randrange(150, 350) for _ in range(600)]  # best fit leaves what no piece fills
    bins = swaps.packed(lengths, [None] * len(lengths), 1000)
    sound(lengths, bins, 1000)
    least = -(-sum(lengths) // 1000)
    assert len(bins) <= 1.02 * least < 1.04 * least < len(swaps.best_fit(lengths, 1000))


def test_pairs_come_from_any_sequence():
    """Pairs of the 64 emptiest sequences alone leave 986 sequences of at least 974."""
    r = random.Random(3)
    lengths = [r.randrange(300, 700) for _ in range(4000)]
    bins = swaps.packed(lengths, [None] * len(lengths), 2048)
    sound(lengths, bins, 2048)
    assert len(bins) <= 983


def test_each_kind_of_change_pays():
    """A move, one for one, two for one, one for two: the emptier sequence drains, squares grow."""
    cases = [
        ([[60, 10], [20]], [[60, 10, 20]]),
        ([[70, 20], [30]], [[70, 30], [20]]),
        ([[70, 10, 10], [30]], [[70, 30], [10, 10]]),
        ([[70, 25], [15, 15]], [[70, 15, 15], [25]]),
    ]
    for start, want in cases:
        lengths = [n for b in start for n in b]
        ends = np.cumsum([0] + [len(b) for b in start])
        bins = [list(range(a, b)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        got = swaps.Search(bins, lengths, 100).run()
        sound(lengths, got, 100)
        assert sorted(sorted(lengths[i] for i in b) for b in got) == sorted(sorted(b) for b in want)


def test_search_ends_where_nothing_fits_together():
    lengths = [r for r, _ in product(range(51, 90), range(40))]
    bins = swaps.packed(lengths, [None] * len(lengths), 100)
    sound(lengths, bins, 100)
    assert len(bins) == len(lengths)


@pytest.mark.parametrize("pieces", [swaps.PIECES, 12])
def test_round_trip(texts, pieces, monkeypatch):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(swaps, "PIECES", pieces)
    r = random.Random(6)
    sample = [(1, None), (2, ""), (3, "don't  STOP <|endoftext|> x² “quotes” 日本語 "), (5, "a" * 9000), (5, "same id"), (5, "same id"), (None, "no id")]
    sample += [(10 + i, prose(r, r.choice([3, 30, 300, 900, 3000]))) for i in range(60)]
    found, sequences = {}, {}
    for p in swaps.pack(texts(sample), with_ids=True).collect():
        assert len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == p.ids_crc32
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        found.setdefault(p.doc_id, []).append((p.piece, p.start, p.length, p.ids))
    reference = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    wanted = {}
    for i, t in sample:
        ids, rows = reference.encode(t or "", add_special_tokens=False).ids + [0], wanted.setdefault(i, [])
        edges = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        rows += [(k, a, b - a, np.array(ids[a:b], "<u4").tobytes()) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    assert {i: sorted(x) for i, x in found.items()} == {i: sorted(x) for i, x in wanted.items()}
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist() and sum(n for _, n in parts) <= 2048
    lengths = [n for x in wanted.values() for _, _, n, _ in x]
    assert len(sequences) <= len(swaps.best_fit(lengths, 2048)) + -(-len(lengths) // pieces) - 1  # a share may leave one
    assert swaps.pack(texts([])).count() == 0

"""Alignment of two tokenizers against a plain walk over their tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from shelfline.llm import alignment

from .conftest import prose


def plain(rows):
    """What `alignment` gives, by the tokenizers' own files and one pass per document."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in printable} | {chr(256 + n): c for n, c in enumerate(c for c in range(256) if c not in printable)}
    out, links = [], []
    for doc, text in rows:
        body = (" " + (text or "")).encode()
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        if b"".join(bytes_a) != body or b"".join(bytes_b) != body:
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        shared = sorted(set(ends_a) & set(ends_b))
        groups, before = [], 0
        for end in shared:
            inside = [[str(i) for i, e in zip(ids, ends, strict=True) if before < e <= end] for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))]
            groups.append("|".join(",".join(x) for x in inside))
            before = end
        mine = [(ids_a[ends_a.index(e)], ids_b[ends_b.index(e)]) for e in shared]
        links.append(mine)
        written = ";".join(groups)
        out.append((doc, len(ids_a), len(ids_b), len(groups), len(mine), hashlib.sha256(written.encode()).hexdigest() if mine else ""))
    counts = Counter(x for mine in links for x in mine)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(*row, sum(counts[x] == best[x[1]] for x in mine), sum(counts[x] for x in mine)) for row, mine in zip(out, links, strict=True)]


def rows_of(seed=5):
    r = random.Random(seed)
    strange = "don't  STOP\n\n\tnow <|endoftext|> <s> x² µm ½ naïve “quotes” — 日本語 \x1c\x85\xa0 Ⅷ ١٢ 12³ '’s 'll  "
    rows = [(1, None), (2, ""), (3, " "), (4, "  "), (5, strange), (6, strange * 30), (7, "a▁b and more"), (8, "\x00 zero"), (9, "a" * 5000), (9, "same id"), (None, "no id")]
    return rows + [(10 + i, prose(r, r.choice([1, 3, 40, 700]))) for i in range(40)] + [(60, strange), (61, strange)]


def found(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("common", [alignment.COMMON, 20, 0])
def test_alignment_equals_a_plain_walk(texts, common, monkeypatch):
    """Whether counts are looked up, joined, or both."""
    pytest.importorskip("sentencepiece")
    monkeypatch.setattr(alignment, "COMMON", common)
    rows = rows_of()
    assert found(alignment.alignment(texts(rows))) == sorted(plain(rows), key=str)


def test_no_documents(texts):
    assert alignment.alignment(texts([])).collect() == []
    assert found(alignment.alignment(texts([(1, None)]))) == [(1, 0, 0, 0, 0, "", 0, 0)]


@pytest.mark.parametrize("step", [1, 2, 3, 7, 1000])
def test_pieces_stitch_to_one_merge(step):
    r = random.Random(step)
    for _ in range(60):
        end = r.randrange(1, 60)
        a, b = (np.array(sorted({end, *r.sample(range(1, end + 1), r.randrange(0, end))})) for _ in range(2))
        token_a, token_b, ends, closes = alignment.merged(a, b, step)
        assert ends.tolist() == sorted({*a.tolist(), *b.tolist()})
        assert token_a.tolist() == np.searchsorted(a, ends).tolist() and token_b.tolist() == np.searchsorted(b, ends).tolist()
        assert closes.tolist() == [e in set(a.tolist()) and e in set(b.tolist()) for e in ends.tolist()]


def test_diagonals_halve_the_work():
    a, b = np.arange(1, 1001) * 2, np.arange(1, 501) * 4
    i, j = alignment.diagonals(a, b, 100)
    assert np.diff(i + j).max() == 100 and (i + j)[-1] == 1500
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        order = sorted([(e, 0) for e in a.tolist()] + [(e, 1) for e in b.tolist()])[: x + y]
        assert sum(k == 0 for _, k in order) == x


def test_groups_as_text(texts):
    rows = [(1, "hello naïve world"), (2, None)]
    got = {r.doc_id: r for r in alignment.align(texts(rows), with_groups=True).collect()}
    assert hashlib.sha256(got[1].groups.encode()).hexdigest() == got[1].groups_sha256 and got[1].groups.count(";") == got[1].n_groups - 1
    assert got[2].groups == "" and got[2].links == b""

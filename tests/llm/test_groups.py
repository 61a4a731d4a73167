"""Near-duplicate documents and vectors, and repeated spans, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from shelfline.llm import frames, jaccard, substrings, vectors

from .conftest import LOWER, prose, words


def sets_of(rows, n=5):
    out = []
    for _, text in rows:
        w = words((text or "").translate(LOWER))
        out.append(set() if not w else {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    return out


def groups_of(rows, percent=75):
    sets, root = sets_of(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    least = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))), key=str)


def edited(r, text, n):
    w = text.split()
    for _ in range(n):
        at = r.randrange(len(w))
        w[at : at + 1] = r.choice([[], ["new" + str(r.randrange(99))], [w[at], "more" + str(r.randrange(99))]])
    return " ".join(w)


def corpus(seed):
    r = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one"), (5, "a b c d"), (6, "A B C D"), (7, "x " * 400)]
    line = prose(r, 12)
    for _ in range(12):
        base = prose(r, r.choice([8, 20, 60, 150, 400]))
        for _ in range(r.choice([1, 2, 6])):
            text = edited(r, base, r.choice([0, 0, 1, 2, 4, 8]))
            rows.append((len(rows), f"{line}\n{text}" if r.random() < 0.5 else text))
    base = prose(r, 120)
    rows += [(len(rows) + i, edited(r, base, r.choice([3, 4, 5, 6]))) for i in range(25)]  # a chain near the threshold
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_groups_equal_brute_force(texts, rows, seed):
    sample = corpus(seed)
    got = rows(jaccard.near_groups(texts(sample)))
    assert sorted(got, key=str) == groups_of(sample)


def test_near_groups_without_slack_or_large_blocks(texts, rows, monkeypatch):
    """Sets that are not safe go through the prefix join; small blocks and levels change nothing."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "SPARE", 0.4)
    jaccard.bands.cache_clear()
    sample = corpus(3)
    try:
        got = rows(jaccard.near_groups(texts(sample)))
    finally:
        jaccard.bands.cache_clear()
    assert sorted(got, key=str) == groups_of(sample)


def test_near_groups_with_many_small_blocks_and_passes(texts, rows, monkeypatch):
    for name, value in (("BLOCK", 2), ("SKETCHED", 4), ("SKETCH", 64), ("SPARE", 0.4), ("HELD", 100)):
        monkeypatch.setattr(jaccard, name, value)
    jaccard.bands.cache_clear()
    sample = corpus(3)
    try:
        got = rows(jaccard.near_groups(texts(sample)))
    finally:
        jaccard.bands.cache_clear()
    assert sorted(got, key=str) == groups_of(sample)


def bucket_of(sets, percent=75):
    first = np.r_[0, np.cumsum([len(s) for s in sets])]
    (owner, signature, kind), _ = jaccard.signatures(np.concatenate(sets), first, percent)
    return list(jaccard._dealt([(jaccard.classes_of(np.concatenate(sets), first)[owner], signature, kind)], 1))


def test_a_bucket_is_sorted_part_by_part(monkeypatch):
    random = np.random.default_rng(1)
    base = np.sort(random.integers(0, 1 << 63, 200).astype(np.uint64))
    sets = [np.sort(np.r_[np.delete(base, i), random.integers(0, 1 << 63, 3).astype(np.uint64)]) for i in range(30)]

    def found(size):
        monkeypatch.setattr(jaccard, "BUCKET", size)
        sizes, part = [], jaccard._part
        monkeypatch.setattr(jaccard, "_part", lambda *a: sizes.append(len((out := part(*a))[0])) or out)
        out = sorted((tuple(r.values()) for b in jaccard._members(bucket_of(sets)) for r in b.to_pylist()), key=str)
        monkeypatch.setattr(jaccard, "_part", part)
        return out, max(sizes)

    whole, all_of_it = found(1 << 21)
    parts, largest = found(1 << 9)
    assert whole == parts and len(whole) > 30
    assert largest < all_of_it / 4


def test_only_blocks_of_open_pairs_are_compared_by_tokens():
    random = np.random.default_rng(2)
    sets = [np.sort(random.integers(0, 1 << 63, n).astype(np.uint64)) for n in (30, 90, 90, 500, 500, 3000) for _ in range(20)]
    base = sets[70]
    sets.append(np.sort(np.r_[base[40:], sets[0]]))
    total = len(sets)
    table = pa.table({
        "area": [1] * total, "i": [0] * total, "j": [0] * total, "own": [0] * total, "fine": [k % 40 for k in range(total)], "cls": list(range(total)),
        "root": list(range(total)), "active": [True] * total, "n": [len(s) for s in sets], "sketch": [jaccard.sketch(s) for s in sets],
    })
    got = {tuple(r.values()) for r in jaccard._opened(table, 75).to_pylist()}
    pair = sorted((70 % 40, (total - 1) % 40))
    assert got == {(1, *pair, 70), (1, *pair, total - 1)}
    exact = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 4 * len(c := np.intersect1d(a, b)) >= 3 * (len(a) + len(b) - len(c))]
    assert exact == [(total - 1, 70)]


def test_shuffles_of_op7_go_with_their_queries(spark):
    from shelfline.llm.queries import QUERIES

    spark.conf.unset(frames.FREED[0])
    QUERIES["op7_ngram_jaccard"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get(frames.FREED[0]) == "true"


def test_near_groups_of_odd_rows(texts, rows):
    assert rows(jaccard.near_groups(texts([]))) == []
    sample = [(None, "a b c d e f"), (9, "a b c d e f"), (9, "a b c d e f"), (3, None), (None, None), (4, "q r s t u v")]
    got = sorted(rows(jaccard.near_groups(texts(sample))), key=str)
    assert got == sorted([(None, 2, 9), (9, 2, 9), (9, 2, 9), (3, 0, 3), (None, 0, None), (4, 2, 4)], key=str)


def test_near_groups_when_an_id_has_two_texts(texts, rows):
    sample = [(1, "a b c d e f g h"), (1, "q r s t u v w x"), (2, "q r s t u v w x"), (3, "a b c d e f g h")]
    got = sorted(rows(jaccard.near_groups(texts(sample))))
    assert got == [(1, 4, 1), (1, 4, 1), (2, 4, 1), (3, 4, 1)]


@pytest.mark.parametrize("share", [1 << 19, 20])
def test_components_of_a_chain(spark, share, monkeypatch):
    monkeypatch.setattr(frames, "FOREST", share)
    links = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 201), (202, 201), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in frames.components(links).collect()}
    assert all(got[i] == 0 for i in range(71)) and got[202] == got[201] == 200


def kept_by_force(sample, window):
    seen, out = {}, {}
    for i, text in sorted((x for x in sample if x[0] is not None), key=lambda x: x[0]):
        w = words(text)
        hit = bytearray(len(w))
        for a in range(len(w) - window + 1):
            place = seen.setdefault(tuple(w[a : a + window]), (i, a))
            if place < (i, a):
                hit[a : a + window] = b"\1" * window
        out[i] = (len(w), sum(hit), " ".join(x for x, h in zip(w, hit, strict=True) if not h))
    return out


@pytest.mark.parametrize("window", [4, 20])
def test_without_repeats_equals_brute_force(texts, window, monkeypatch):
    r = random.Random(window)
    passage, short = prose(r, 60), prose(r, window - 1)
    sample = [(0, None), (1, ""), (2, "one two"), (3, "a " * 90), (4, "a " * 50), (5, passage)]
    for _ in range(40):
        parts = [prose(r, r.randrange(40)) for _ in range(3)]
        cut = r.randrange(20)
        parts.insert(1, r.choice([passage, " ".join(passage.split()[cut : cut + 30]), short, ""]))
        sample.append((len(sample), "\n".join(parts)))
    sample += [(len(sample) + i, sample[10][1]) for i in range(3)]
    r.shuffle(sample)
    want = kept_by_force(sample, window)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in substrings.without_repeats(texts(sample), window=window).collect()}
    assert got == want
    # anchors that count as heavy, small shards and copies of shards change nothing
    monkeypatch.setattr(substrings, "HEAVY", 2)
    monkeypatch.setattr(substrings, "SHARD", 16)
    monkeypatch.setattr(substrings, "STREAM", 64)
    monkeypatch.setattr(substrings, "BATCH", 500)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in substrings.without_repeats(texts(sample), window=window).collect()}
    assert got == want


def test_without_repeats_of_odd_rows(texts, rows):
    assert rows(substrings.without_repeats(texts([]))) == []
    text = " ".join(map(str, range(30)))
    got = sorted(rows(substrings.without_repeats(texts([(None, text), (4, text), (4, text), (2, None)]))), key=str)
    assert got == sorted([(None, 30, 0, text), (4, 30, 0, text), (4, 30, 0, text), (2, 0, 0, "")], key=str)


def test_repeats_of_ids_with_several_texts_are_found(texts):
    first, other, more = (" ".join(f"{c}{i}" for i in range(40)) for c in "wvu")
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substrings.without_repeats(texts([(1, first), (5, other), (5, f"{first} {more}"), (6, other)])).collect()]
    assert sorted(got) == [(1, 40, 0), (5, 40, 0), (5, 80, 40), (6, 40, 40)]


def test_cut_out_keeps_the_layout(texts):
    passage = " ".join(f"p{i}" for i in range(25))
    docs = texts([(1, f"first\n{passage}\nlast"), (2, f"other\nline\n{passage}\nend of it"), (3, passage)])
    left = substrings.cut_out(docs, substrings.repeated_spans(docs)).collect()
    assert {r.doc_id: r.text for r in left} == {1: f"first\n{passage}\nlast", 2: "other\nline\nend of it", 3: ""}


def test_automaton_finds_only_earlier_places():
    automaton = substrings.Automaton()
    automaton.insert(list("abcab"), 5, 0)
    automaton.insert(list("xabc"), 7, 10)
    assert automaton.earlier(list("zabcz"), 9, 0, 3) == [(1, 4)]
    assert automaton.earlier(list("abc"), 5, 0, 3) == []
    assert automaton.earlier(list("cabxabc"), 6, 0, 3) == [(0, 3), (4, 7)]


def points(seed, n=300):
    r = np.random.default_rng(seed)
    base = r.normal(size=(30, 16))
    rows = [(i, [float(x) for x in base[i % 30] + r.normal(size=16) * r.choice([0.02, 0.05, 0.3])], int(i % 30) % 3) for i in range(n)]
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 1), (1002, [x * 2 for x in rows[0][1]], 0)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 16, 0), (2003, [float("nan")] * 16, 0), (2004, [None] * 16, 0)]
    rows += [(2005, rows[0][1], None), (2006, [1.0, 2.0], 0), (2007, [float("inf")] * 16, 0)]
    return rows


def links_of(rows, threshold=0.98):
    units = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            units[i] = (np.array(v) / np.linalg.norm(v), label)
    out = {i: set() for i, _, _ in rows}
    for i, (u, a) in units.items():
        out[i] = {j for j, (v, b) in units.items() if j != i and a == b and len(u) == len(v) and float(u @ v) >= threshold}
    return out


@pytest.mark.parametrize("shard", [1500, 40])
def test_vector_links(spark, shard, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", shard)
    sample = points(4)
    rows = spark.createDataFrame(sample, "vec_id long, embedding array<float>, label int")
    rows = rows.selectExpr("vec_id", "CAST(embedding AS array<double>) AS embedding", "label", "1 AS node", "2 AS kind")
    exact = links_of([(r.vec_id, r.embedding, r.label) for r in rows.collect()])
    got = {r.vec_id: r for r in vectors.near_links(rows).collect()}
    assert set(got) == set(exact)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(2000, 2008))
    wanted, found = sum(map(len, exact.values())), sum(min(got[i].n_links, len(x)) for i, x in exact.items())
    assert found >= 0.97 * wanted and all(got[i].n_links <= len(x) for i, x in exact.items())
    assert vectors.audit(rows, vectors.near_links(rows)) >= 0.9
    if found == wanted:
        for i, near in exact.items():
            assert got[i].component_id == min([got[j].component_id for j in near] + [got[i].component_id])


def test_vector_links_of_no_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_links(empty).count() == 0


def groups_of_near_copies(sizes, seed):
    """Vectors of one label that are nothing but groups of distinct near copies."""
    r = np.random.default_rng(seed)
    out = []
    for n in sizes:
        base = r.normal(size=64)
        out += [base / np.linalg.norm(base) + r.normal(size=64) * 0.012 for _ in range(n)]
    return [(i, [float(x) for x in v], 0) for i, v in enumerate(np.array(out)[r.permutation(len(out))])]


@pytest.mark.parametrize("sizes", [[300] * 3, [800, 700], [100] * 10])
def test_vector_links_of_labels_made_only_of_groups(spark, sizes):
    sample = groups_of_near_copies(sizes, 5)
    units = np.array([v for _, v, _ in sample])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    exact = (units @ units.T >= 0.98).sum(axis=1) - 1
    got = {r.vec_id: r for r in vectors.near_links(spark.createDataFrame(sample, "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[i].n_links for i in range(len(sample))] == exact.tolist()
    assert sum(r.kept for r in got.values()) == len(sizes)


def test_vector_tasks_stay_small_when_a_label_is_one_ball(spark, monkeypatch, tmp_path):
    """No task holds more than a block and a part, and all links are found over several cells, blocks and parts."""
    monkeypatch.setattr(vectors, "SHARD", 60)
    monkeypatch.setattr(vectors, "CENTERS", 3)
    links = vectors._links

    def watched(table, threshold):
        (tmp_path / f"{table.num_rows}").touch()
        return links(table, threshold)

    monkeypatch.setattr(vectors, "_links", watched)
    sample = groups_of_near_copies([900, 40, 1], 6)
    units = np.array([v for _, v, _ in sample])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    exact = (units @ units.T >= 0.98).sum(axis=1) - 1
    got = {r.vec_id: r for r in vectors.near_links(spark.createDataFrame(sample, "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[i].n_links for i in range(len(sample))] == exact.tolist()
    assert sum(r.kept for r in got.values()) == 3
    assert 0 < max(int(p.name) for p in tmp_path.iterdir()) < 4 * 60

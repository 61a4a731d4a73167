"""Hard negatives against a ranking of all rows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from shelfline.llm import negatives

SCHEMA = "vec_id long, label long, embedding array<double>, score long, anchor string, rank int"


def plain(rows, every, positives=5, wanted=5):
    valid = []
    for key, (i, label, v) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            valid.append((key, i, label, [math.floor(256 * x) for x in v]))
    out = []
    for key, i, label, v in valid:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, k, m) for k, j, m, w in valid if len(w) == len(v)]
        near = sorted(x for x in scored if x[3] == label and x[2] != key)[:positives]
        for p, positive, _, _ in near:
            far = sorted(x for x in scored if x[3] != label and 80 * -p <= 100 * -x[0] <= 100 * -p)[:wanted]
            out += [(i, positive, n, j, -p, -s) for n, (s, j, _, _) in enumerate(far, 1)]
    return sorted(out)


def found(spark, rows, every, **options):
    df = spark.createDataFrame([(i, label, v, 1, "x", 2) for i, label, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % every == 0, **options).collect()))


def vectors(seed, n, labels=3, dim=6):
    r = random.Random(seed)
    centers = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = r.choice(centers)
        rows.append((i, r.randrange(labels), [x + r.gauss(0, 0.5) for x in c]))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_equal_a_ranking_of_all(spark, small, monkeypatch):
    """In one task, and with several blocks, shares, clusters and stretches."""
    if small:
        for name, size in (("BLOCK", 20), ("SHARE", 8), ("CLUSTER", 3), ("STRETCH", 4)):
            monkeypatch.setattr(negatives, name, size)
    rows = vectors(1, 160)
    assert found(spark, rows, 5) == plain(rows, 5) != []
    assert found(spark, rows, 5, positives=2, negatives=3) == plain(rows, 5, 2, 3)


def test_copies_and_ties_go_to_smaller_ids(spark):
    r = random.Random(4)
    rows = [(i, i % 2, [1.0, 0.5]) for i in range(0, 60)] + [(60 + i, i % 3, [r.choice([0.5, 1.0]), r.choice([0.25, 0.5])]) for i in range(60)]
    assert found(spark, rows, 10) == plain(rows, 10) != []


def test_odd_rows_take_no_part(spark):
    rows = vectors(2, 40, labels=2)
    rows += [(100, None, [1.0] * 6), (110, 1, None), (120, 1, [None] * 6), (130, 1, [math.inf] * 6), (140, 0, [math.nan] * 6), (None, 1, [1.0] * 6)]
    rows += [(150, 0, [0.0] * 6), (160, 1, [1.0, 2.0]), (161, 1, [1.0, 2.5]), (162, 0, [1.0, 1.9]), (170, 0, []), (171, 0, []), (172, 1, [])]
    assert found(spark, rows, 10) == plain(rows, 10)


def test_no_rows_and_no_anchors(spark):
    assert found(spark, [], 10) == []
    assert found(spark, [(1, 1, [1.0]), (2, 2, [1.0])], 10) == []


def test_repeated_ids_count_one_by_one(spark):
    rows = vectors(3, 30, labels=2) * 2
    assert found(spark, rows, 10) == plain(rows, 10)


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(i, i % 2, [float(2**40 + i), float(3 * i + 1), 2.0**21]) for i in range(12)]
    big = [r for r in plain(rows, 4) if max(r[4:]) < 1 << 63]
    assert [r for r in found(spark, rows, 4) if max(r[4:]) < (1 << 63) - 1] == big
    rows = [(i, i % 2, [2.0**18 + i / 256, 2.0**19 + 3 * i / 256]) for i in range(12)]
    assert found(spark, rows, 4) == plain(rows, 4) != []


def test_a_certified_walk_stops_early(monkeypatch):
    import numpy as np

    seen = []
    real = negatives._products
    monkeypatch.setattr(negatives, "_products", lambda a, b, longest: (seen.append(len(b)), real(a, b, longest))[1])
    monkeypatch.setattr(negatives, "STRETCH", 16)
    r = np.random.default_rng(0)
    block = np.concatenate([r.normal(size=(40, 8)) + 20, r.normal(size=(1000, 8)) - 20])
    import pyarrow as pa

    rows = [(k, k, "a", (np.floor(v)).tobytes(), None, False) for k, v in enumerate(block)]
    rows.append((5000, 5000, "a", np.full(8, 20.0).tobytes(), [0], True))
    names = ["key", "id", "label", "vector", "wanted", "asks"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.bool_()]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    got = negatives._walk(table, 5, None)
    assert len(got) == 5 and sum(seen) < 100

"""The most frequent pairs without counting all of them, and distinct counts that add up."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from shelfline.operators import pairs, sketches
from shelfline.operators.top_pairs import top_pairs


def best(groups, n):
    counts = Counter(p for items in groups for p in combinations(sorted(items), 2))
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]


def members(spark, groups):
    return spark.createDataFrame([(g, i) for g, items in enumerate(groups) for i in items], "g int, i string")


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("n", [1, 3, 20, 400])
def test_equal_to_counting_all_pairs(spark, seed, n):
    r = random.Random(seed)
    weights = [1 / (k + 1) for k in range(30)]
    groups = [{f"p{k:02d}" for k in r.choices(range(30), weights, k=r.choice([1, 2, 4, 7]))} for _ in range(60)]
    got = [((r.item_a, r.item_b), r.pair_cnt) for r in top_pairs(members(spark, groups), n, group="g", item="i").collect()]
    assert sorted(got, key=lambda x: (-x[1], x[0])) == best(groups, n)


def test_rare_items_are_never_paired(spark, monkeypatch):
    """40 groups share three items; each has 60 items of its own, whose 71,000 pairs need not be formed."""
    groups = [{"a", "b", "c"} | {f"x{g:02d}-{k}" for k in range(60)} for g in range(40)]
    formed, real = [], pairs._count
    monkeypatch.setattr(pairs, "_count", lambda df: (formed.append(df.count()), real(df))[1])
    got = [((r.item_a, r.item_b), r.pair_cnt) for r in top_pairs(members(spark, groups), 3, group="g", item="i").collect()]
    assert sorted(got) == best(groups, 3) and sum(formed) == 120


def test_pairs_of_one_group_fill_up_in_order(spark):
    groups = [{f"x{g:02d}-{k}" for k in range(8)} for g in range(9)] + [{"z1", "z2"}, {"z1", "z2"}]
    got = [((r.item_a, r.item_b), r.pair_cnt) for r in top_pairs(members(spark, groups), 40, group="g", item="i").collect()]
    assert sorted(got, key=lambda x: (-x[1], x[0])) == best(groups, 40)
    assert top_pairs(members(spark, []), 5, group="g", item="i").collect() == []


@pytest.mark.parametrize("n", [50, 20_000])
def test_sketches_of_bins_merge_to_the_window(spark, n):
    rows = spark.range(3 * n).select(
        (F.col("id") % 2).alias("k"), F.timestamp_seconds(F.floor(F.col("id") / n) * 60).alias("bin"), (F.col("id") % (2 * n)).cast("string").alias("v")
    )
    held = sketches.bin_sketches(rows, ["k"], "bin", "v")
    start, end = F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(120))
    exact = {r.k: r.n for r in rows.where(F.col("bin") < end).groupBy("k").agg(F.countDistinct("v").alias("n")).collect()}
    got = {r.k: r.estimate for r in sketches.window_estimates(held, ["k"], "bin", start, end).collect()}
    assert got.keys() == exact.keys()
    for k, number in exact.items():  # three standard errors; few values are counted exactly
        assert abs(got[k] - number) <= (3 * sketches.standard_error() * number if n > 1000 else 0)

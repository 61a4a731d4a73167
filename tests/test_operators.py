from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from shelfline.operators.dedup import dedup
from shelfline.operators.nested import array_pairs, expand, manage_fields
from shelfline.operators import pairs
from shelfline.operators.pairs import pair_counts
from shelfline.operators.ranking import top_n, top_per_group
from shelfline.operators.retention import last, prune
from shelfline.operators.series import aligned_bin, cumulative, make_series


def test_dedup_keeps_the_first_in_order(spark, rows):
    df = spark.createDataFrame([("o1", "p1", 3), ("o1", "p1", 1), ("o1", "p2", 2), ("o2", "p1", 9)], "o string, p string, n int")
    assert rows(dedup(df, ["o", "p"])) == [("o1", "p1", 1), ("o1", "p2", 2), ("o2", "p1", 9)]
    assert rows(dedup(df, ["o", "p"], [F.desc("n")]))[0] == ("o1", "p1", 3)


def test_dedup_limits_each_key_before_the_shuffle(spark):
    df = spark.createDataFrame([("o1", 1)], "o string, n int")
    plan = dedup(df, ["o"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_top_per_group_breaks_ties_by_the_last_column(spark, rows):
    df = spark.createDataFrame([("a", 5, "z"), ("a", 5, "x"), ("a", 7, "y"), ("b", 1, "w")], "g string, v int, id string")
    got = rows(top_per_group(df, ["g"], [F.desc("v"), F.asc("id")], 2, rank_col="r"))
    assert got == [("a", 5, "x", 2), ("a", 7, "y", 1), ("b", 1, "w", 1)]


def test_top_n(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 1)], "id string, v int")
    assert [tuple(r) for r in top_n(df, "v", 2, ["id"]).collect()] == [("a", 2), ("b", 2)]


def brute_force(memberships, min_count):
    groups = defaultdict(set)
    for group, item in memberships:
        if group is not None and item is not None:
            groups[group].add(item)
    counts = Counter(pair for items in groups.values() for pair in combinations(sorted(items), 2))
    return sorted((a, b, n) for (a, b), n in counts.items() if n >= min_count)


@pytest.mark.parametrize("min_count", [1, 2, 3, 5])
@pytest.mark.parametrize("bulky, looked_up", [(3, 64), (3, 4), (3, 1), (12, 64), (12, 2), (1000, 64)])
def test_pair_counts_equal_brute_force(spark, monkeypatch, min_count, bulky, looked_up):
    monkeypatch.setattr(pairs, "MAX_LOOKED_UP", looked_up)
    rng = random.Random(min_count * 100 + bulky)
    data = [("huge", f"i{n:02d}") for n in range(30)] + [("large", f"i{n:02d}") for n in range(0, 30, 2)]
    data += [("wide", f"i{n:02d}") for n in range(10, 28)]
    for group in range(40):
        for _ in range(rng.randint(1, 6)):
            data.append((f"g{group}", f"i{rng.randint(0, 35):02d}"))
    data += [(None, "i01"), (None, "i02"), ("g1", None), ("g1", None)]
    df = spark.createDataFrame(data, "order_id string, product_id string")
    got = sorted(tuple(r) for r in pair_counts(df, min_count, bulky=bulky).collect())
    assert got == brute_force(data, min_count)


def test_pair_counts_of_one_huge_group_look_it_up_instead_of_expanding_it(spark):
    data = [("huge", f"i{n:04d}") for n in range(3000)] + [("a", "i0001"), ("a", "i0002"), ("b", "i0003")]
    df = spark.createDataFrame(data, "order_id string, product_id string")
    assert [tuple(r) for r in pair_counts(df, 2, bulky=100).collect()] == [("i0001", "i0002", 2)]


def test_pair_counts_of_two_huge_groups_pair_only_what_they_share(spark):
    data = [("huge", f"i{n:05d}") for n in range(20000)] + [("big", f"i{n:05d}") for n in range(19990, 39000)]
    df = spark.createDataFrame(data, "order_id string, product_id string")
    got = pair_counts(df, 2, bulky=100)
    assert got.count() == 45 and {r.pair_cnt for r in got.collect()} == {2}


def test_pair_counts_move_numbers_from_one_shuffle_of_the_groups(spark):
    df = spark.createDataFrame([("g1", "x"), ("g1", "y"), ("g2", "y"), ("g2", "x"), ("g3", "x")], "order_id string, product_id string")
    got = pair_counts(df, 2, largest_size=2, with_counts=True)
    assert [tuple(r) for r in got.collect()] == [("x", "y", 2, 3, 2)]
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ObjectHashAggregate" not in plan and "ReusedExchange" in plan


def test_pair_counts_without_rows(spark):
    empty = spark.createDataFrame([], "order_id string, product_id string")
    assert pair_counts(empty, 2).count() == 0


def test_expand_keeps_parents_and_drops_empty(spark, rows):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", []), ("c", None)], "id string, items array<string>")
    assert rows(expand(df, "items")) == [("a", 0, "x"), ("a", 1, "y")]


def test_manage_fields(spark):
    df = spark.createDataFrame([(1, ("p", "red"))], "id int, item struct<product_id string, color string>")
    out = manage_fields(df, {"pid": "item.product_id", "key": "id"})
    assert out.columns == ["pid", "key"] and tuple(out.first()) == ("p", 1)


def test_array_pairs_have_one_orientation(spark, rows):
    df = spark.createDataFrame([("k1", ["b", "a", "b"]), ("k2", ["a", "b", "c"])], "k string, v array<string>")
    assert rows(array_pairs(df, "v", "k")) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]


def stamp(text):
    return F.lit(f"2024-05-01 {text}").cast("timestamp")


def test_dense_series_and_running_total(spark):
    df = spark.createDataFrame([("k", "10:00:30"), ("k", "10:02:10"), ("k", "10:02:40"), ("j", "10:01:31")], "k string, t string")
    df = df.select("k", F.concat(F.lit("2024-05-01 "), "t").cast("timestamp").alias("ts"))
    start, end = stamp("10:00:30"), stamp("10:03:00")
    binned = df.groupBy("k", aligned_bin(F.col("ts"), start, "1 minute").alias("ts")).agg(F.count("*").alias("n"))
    dense = cumulative(make_series(binned, ["k"], "ts", "n", start, end, "1 minute"), ["k"], "ts", "n")
    got = [(r.k, r.t, r.n, r.cum) for r in dense.select("k", F.date_format("ts", "HH:mm:ss").alias("t"), "n", "cum").orderBy("k", "t").collect()]
    assert got == [
        ("j", "10:00:30", 0, 0), ("j", "10:01:30", 1, 1), ("j", "10:02:30", 0, 1),
        ("k", "10:00:30", 1, 1), ("k", "10:01:30", 1, 2), ("k", "10:02:30", 1, 3),
    ]


def test_prune_and_last(spark):
    df = spark.createDataFrame([("2024-04-30 09:59:59",), ("2024-04-30 10:00:00",), ("2024-05-01 10:30:00",)], "t string")
    df = df.select(F.col("t").cast("timestamp").alias("ts"))
    assert prune(df, "ts", stamp("10:00:00")).count() == 2
    assert last(df, "ts", stamp("10:00:00"), "24 hours").count() == 1

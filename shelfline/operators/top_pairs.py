"""The most frequent pairs of items, without counting all pairs.

No pair is in more groups than the rarer of its items is. So the items are taken by falling count, down to a threshold:
if `n` pairs among them reach it, no pair with a rarer item can be among the best. Otherwise the threshold falls
to a quarter.
Where fewer than `n` pairs are in two groups or more, pairs found in a single group fill up, in the order of their items:
only the first items of that order are paired, and more of them as long as they do not suffice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.operators.pairs import BULKY, item_counts, pair_counts
from shelfline.session import stored


def top_pairs(members: DataFrame, n: int, *, group: str, item: str, bulky: int = BULKY) -> DataFrame:
    """The `n` pairs `item_a < item_b` found in most groups, ties in the order of the items, as (item_a, item_b, pair_cnt).

    `members` has each membership once and is stored, as it is read several times.
    """
    rows = members.select(F.col(group).alias("grp"), F.col(item).alias("item")).dropna()
    counts = stored(item_counts(rows), "item-counts")
    threshold = _start(counts, n)
    while True:
        found = pair_counts(rows, threshold, group="grp", item="item", bulky=bulky, settled=True, counts=counts)
        found = stored(found.orderBy(F.desc("pair_cnt"), "item_a", "item_b").limit(n), "top-pairs")
        if threshold <= 2 or found.count() >= n:
            break
        threshold = max(2, threshold // 4)
    missing = n - found.count()
    if missing <= 0:
        return found
    single = _first_pairs(rows, found, missing, n)
    return found.unionByName(single)


def _start(counts: DataFrame, n: int) -> int:
    """An upper bound on the count of the `n`-th pair: `n` pairs take some k items, so one of them is as rare as the k-th."""
    k = 2
    while k * (k - 1) // 2 < n:
        k += 1
    most = [r[0] for r in counts.select("cnt").orderBy(F.desc("cnt")).limit(k).collect()]
    return max(2, most[-1]) if len(most) == k else 2


def _first_pairs(rows: DataFrame, better: DataFrame, missing: int, n: int) -> DataFrame:
    """The first `missing` pairs, in the order of their items, that are not among the `better` ones.

    All pairs in two groups or more are among these, so each one here is in a single group.
    """
    last = Window.partitionBy("grp")
    leading = rows.withColumn("_last", F.max("item").over(last)).where("item < _last").select("item").distinct()
    total, take = None, 2 * n
    while True:
        first = leading.orderBy("item").limit(take)
        a = rows.join(first, "item", "left_semi").select("grp", F.col("item").alias("item_a"))
        pairs = a.join(rows.select("grp", F.col("item").alias("item_b")), "grp").where("item_a < item_b").select("item_a", "item_b").distinct()
        rest = pairs.join(F.broadcast(better.select("item_a", "item_b")), ["item_a", "item_b"], "left_anti")
        found = stored(rest.orderBy("item_a", "item_b").limit(missing), "first-pairs")
        if found.count() >= missing:
            break
        total = leading.count() if total is None else total
        if take >= total:
            break
        take *= 4
    return found.withColumn("pair_cnt", F.lit(1).cast("bigint"))

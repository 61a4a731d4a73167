"""Counting the pairs of items that share a group: baskets, outfits and the like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.session import stored

# Groups above this many items are spread over several tasks.
BULKY = 1000
# At most this many of the largest groups are looked up instead of expanded.
MAX_LOOKED_UP = 64


def pair_counts(
    baskets: DataFrame,
    min_pair_cnt: int = 1,
    *,
    group: str = "order_id",
    item: str = "product_id",
    bulky: int = BULKY,
    settled: bool = False,
    counts: DataFrame | None = None,
    lookups: int | None = None,
    largest_size: int | None = None,
    with_counts: bool = False,
) -> DataFrame:
    """Unordered pairs `item_a < item_b` and the number of groups that hold both, where that is `min_pair_cnt` or more.

    The work of forming all pairs grows with the square of the group size, so these exact steps keep it down:

    * An item in fewer than `min_pair_cnt` groups has no pair that reaches the bound. Such items go first.
    * The largest bulky groups (at most `lookups`, by default MAX_LOOKED_UP) are not counted by forming their pairs: each item gets the list
      of those it is in, and a pair's share of them is the overlap of two short lists.
    * A pair found in no other group has to be in `min_pair_cnt` of these. So only items in that many of them are
      paired, and the `min_pair_cnt - 1` largest groups need no pairing at all, since such a pair is also in another.
    * Bulky groups that must be paired are cut into blocks of items, and each pair of blocks is joined on its own, so a
      single group becomes many small tasks.

    From the first step on, items go by numbers: pairs of numbers are far cheaper to count and to move than pairs of texts.

    The memberships are read several times, so they are stored first; `settled` says that `baskets` is a stored table
    with each membership once. `counts`, if at hand, has the groups per item as (item, cnt), and `largest_size` is the
    size of the largest group: no bulky ones are looked for where there can be none. `with_counts` adds the groups of
    each item as `cnt_a` and `cnt_b`.
    """
    members = baskets.select(F.col(group).alias("grp"), F.col(item).alias("item")).dropna()
    if not settled:
        members = stored(members.distinct(), "members")
    largest, large = [], None
    if largest_size is None or largest_size > bulky:
        large = members.groupBy("grp").agg(F.count("item").alias("size")).where(F.col("size") > bulky)
        largest = _largest(large, MAX_LOOKED_UP if lookups is None else lookups)
    if counts is None:
        counts = stored(item_counts(members), "counts")
    numbers = _numbers(counts.where(F.col("cnt") >= min_pair_cnt))
    members = members.join(numbers.select("item", "number"), "item").select("grp", F.col("number").alias("item"))
    return _by_name(_numbered_pairs(members, min_pair_cnt, bulky, large, largest), numbers, with_counts)


def _numbers(counts: DataFrame) -> DataFrame:
    """A number for each item. Stored, so that all readers see the same numbers."""
    return stored(counts.select("item", "cnt", F.monotonically_increasing_id().alias("number")), "numbers")


def _by_name(pairs: DataFrame, numbers: DataFrame, with_counts: bool) -> DataFrame:
    """The pairs by items instead of numbers; the smaller item comes first."""
    for side in ("a", "b"):
        found = numbers.select(F.col("number").alias(f"item_{side}"), F.struct("item", "cnt").alias(side))
        pairs = pairs.join(found, f"item_{side}")
    first, second = F.least("a", "b"), F.greatest("a", "b")  # by item: it is the first field, and no two are equal
    counts = [first["cnt"].alias("cnt_a"), second["cnt"].alias("cnt_b")] if with_counts else []
    return pairs.select(first["item"].alias("item_a"), second["item"].alias("item_b"), "pair_cnt", *counts)


def _numbered_pairs(
    members: DataFrame, min_pair_cnt: int, bulky: int, large: DataFrame | None, largest: list
) -> DataFrame:
    if not largest:
        return _count(_listed_pairs(members)).where(F.col("pair_cnt") >= min_pair_cnt)

    looked_up = largest if min_pair_cnt > 1 else []
    in_largest = F.col("grp").isin(looked_up)
    small = _listed_pairs(members.join(large, "grp", "left_anti"))
    spread = _blocked_pairs(members.join(large.where(~in_largest).select("grp"), "grp", "left_semi"), bulky)
    counted = _count(small.unionByName(spread))
    if not looked_up:
        return counted

    held = members.where(in_largest).groupBy("item").agg(F.collect_set("grp").alias("held"))
    if len(looked_up) >= min_pair_cnt:
        often = held.where(F.size("held") >= min_pair_cnt).select("item")
        paired = members.where(F.col("grp").isin(looked_up[min_pair_cnt - 1 :])).join(often, "item", "left_semi")
        only_here = _blocked_pairs(paired, bulky).distinct().withColumn("pair_cnt", F.lit(0).cast("bigint"))
        counted = counted.unionByName(only_here).groupBy("item_a", "item_b").agg(F.sum("pair_cnt").alias("pair_cnt"))
    return _add_overlap(counted, held).where(F.col("pair_cnt") >= min_pair_cnt)


def item_counts(members: DataFrame) -> DataFrame:
    """Groups per item."""
    return members.groupBy("item").agg(F.count("grp").alias("cnt"))


def _largest(large: DataFrame, limit: int) -> list:
    """Keys of the largest bulky groups, largest first: at most `limit` rows."""
    return [row["grp"] for row in large.orderBy(F.desc("size"), "grp").limit(limit).collect()]


def _listed_pairs(members: DataFrame) -> DataFrame:
    """Pairs of groups that are known to be small: a join of the memberships with themselves, from one shuffle.

    The hash of the group goes first in the key, since numbers sort faster than texts that begin alike.
    """
    keyed = members.withColumn("key", F.xxhash64("grp"))
    left, right = keyed.withColumnRenamed("item", "item_a"), keyed.withColumnRenamed("item", "item_b")
    return left.hint("merge").join(right, ["key", "grp"]).where("item_a < item_b").select("item_a", "item_b")


def _blocked_pairs(members: DataFrame, bulky: int) -> DataFrame:
    """Pairs of groups of any size. A pair meets in exactly one cell: the block of its first and of its second item."""
    sizes = members.groupBy("grp").agg(F.ceil(F.count("item") / bulky).cast("int").alias("blocks"))
    placed = members.join(sizes, "grp").withColumn("block", F.pmod(F.hash("item"), F.col("blocks")))
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = placed.select("grp", F.col("item").alias("item_a"), F.col("block").alias("row"), every_block.alias("col"))
    right = placed.select("grp", F.col("item").alias("item_b"), F.col("block").alias("col"), every_block.alias("row"))
    return left.join(right, ["grp", "row", "col"]).where("item_a < item_b").select("item_a", "item_b")


def _count(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("pair_cnt"))


def _add_overlap(counted: DataFrame, held: DataFrame) -> DataFrame:
    """Add to each pair the number of looked-up groups that both of its items are in."""
    both = counted.join(held.select(F.col("item").alias("item_a"), F.col("held").alias("held_a")), "item_a", "left")
    both = both.join(held.select(F.col("item").alias("item_b"), F.col("held").alias("held_b")), "item_b", "left")
    shared = F.when(
        F.col("held_a").isNotNull() & F.col("held_b").isNotNull(), F.size(F.array_intersect("held_a", "held_b"))
    ).otherwise(0)
    return both.select("item_a", "item_b", (F.col("pair_cnt") + shared).alias("pair_cnt"))

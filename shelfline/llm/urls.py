"""URL filters with built-in functions only: host and path rules, and a logistic regression for the rest.

A rule names a host, with all its subdomains, and the start of a path; the longest rule that fits a URL decides. URLs
that no rule fits are judged by a logistic regression on hashed character n-grams of host and path, trained from a small
labelled table of URLs by gradient descent. Training and scoring are DataFrame expressions: a URL's n-grams are an array
of places, its margin the sum of the weights at these places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import frames

PLACES = 4096
GRAMS = (3, 4, 5)
STEPS = 30

# Made-up URLs, with 1 for those to be blocked
LABELLED = [
    ("http://casino-royal.example/play", 1), ("https://www.best-casino.example/slots/win", 1),
    ("http://win-casino-online.example/bonus", 1), ("http://free-bets.example/odds", 1),
    ("https://bets-now.example/free", 1), ("https://sports-bets.example/today", 1),
    ("http://poker-win.example/tables", 1), ("http://cheap-pills.example/order", 1),
    ("https://pills-online.example/cheap", 1), ("http://buy-cheap-meds.example/pills", 1),
    ("http://adult-video.example/x", 1), ("https://www.adult-x.example/cam", 1),
    ("http://x-adult.example/live", 1), ("http://spam-farm.example/links", 1),
    ("https://link-farm-spam.example/a", 1), ("http://seo-spam.example/farm", 1),
    ("http://ads-track.example/pixel", 1), ("https://track-ads.example/click", 1),
    ("http://ad-tracker.example/ads", 1), ("http://free-prize-win.example/claim", 1),
    ("https://www.city-library.example/en/catalog", 0), ("http://blog.gardening.example/en/roses.html", 0),
    ("https://m.daily-news.example/de/article/120", 0), ("http://www.museum.example/fr/visit/", 0),
    ("https://university.example/en/courses?page=2", 0), ("http://recipes.example/es/soup.html", 0),
    ("https://blog.travel.example/en/alps/", 0), ("http://www.weather.example/de/today", 0),
    ("https://docs.software.example/en/guide#top", 0), ("http://m.health.example/en/4821.html", 0),
    ("https://science.example/fr/2048", 0), ("http://history.example/en/1492/", 0),
    ("https://www.music.example/es/3120?utm_source=feed", 0), ("http://blog.cooking.example/de/77", 0),
    ("https://m.sports.example/en/results?page=3", 0), ("http://maps.example/en/region/7", 0),
    ("https://www.theater.example/de/spielplan", 0), ("http://books.example/en/951.html", 0),
    ("https://nature.example/fr/foret/", 0), ("http://www.transport.example/en/timetable", 0),
    ("http://m.theory.example/en/2210?page=2&ref=x", 0), ("https://m.iron-works.example/de/33.html", 0),
    ("https://blog.weaver.example/es/18/", 0), ("http://www.northern.example/fr/9021#top", 0),
    ("https://m.station.example/en/415", 0), ("http://blog.teacher.example/en/88?utm_source=feed", 0),
    ("http://another.example/de/5150/", 0), ("https://www.heron.example/en/3871.html", 0),
    ("http://m.lighthouse.example/fr/640", 0), ("https://blog.handwriting.example/en/12#top", 0),
    ("https://m.anthem.example/es/707.html", 0), ("http://restoration.example/en/26/", 0),
    ("http://www.ribbon.example/de/914?page=2&ref=x", 0), ("https://blog.ocean.example/fr/52", 0),
    ("https://m.shelter.example/en/6043#top", 0), ("http://m.orchard.example/de/81/", 0),
    ("http://casino-win.example/en/3391", 1), ("https://blog.cheap-pills.example/de/27", 1),
    ("https://m.adult-x.example/en/58.html", 1), ("http://www.free-bets.example/fr/7/", 1),
    ("http://m.spam-farm.example/es/145", 1), ("https://www.ads-track.example/en/92?page=2", 1),
]


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of the rules (verdict, host, path) that fits, as a struct (verdict, rule), or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    chosen = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, name, start in reversed(ordered):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        chosen = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))).otherwise(chosen)
    return chosen


def places(host: Column, path: Column) -> Column:
    """Distinct places of the character n-grams of host and path, each marked with the part it comes from."""
    def grams(mark: str, text: Column, n: int) -> Column:
        padded = F.concat(F.lit("^"), F.coalesce(text, F.lit("")), F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(padded, i, F.lit(n))), F.lit(PLACES)).cast("int"))

    parts = [grams(mark, text, n) for mark, text in (("h", host), ("p", path)) for n in GRAMS]
    return F.array_distinct(F.concat(*parts))


def margin(found: Column, weights: list[float], bias: float) -> Column:
    """Sum of the weights at the places, over the root of their number, plus the bias."""
    table = F.split(F.lit(",".join(repr(round(w, 12)) for w in weights)), ",").cast("array<double>")
    total = F.aggregate(found, F.lit(0.0), lambda s, i: s + F.get(table, i))
    return total / F.sqrt(F.greatest(F.size(found), F.lit(1))) + F.lit(bias)


def train(spark: SparkSession, labelled: list[tuple[str, int]] | DataFrame = LABELLED, steps: int = STEPS, rate: float = 12.0, keep: float = 1e-3) -> tuple[list[float], float]:
    """Weights and bias of a logistic regression, by gradient descent on all labelled URLs at once.

    The labelled table (url, label) is small by definition; rows with a null label count for nothing. Each step is one
    aggregation by place. Without any row the weights are zero.
    """
    rows = spark.createDataFrame(labelled, "url string, label int") if isinstance(labelled, list) else labelled
    rows = rows.where("label IN (0, 1)").select("label", places(host_of(F.col("url")), path_of(F.col("url"))).alias("places"))
    rows = frames.cut(rows.coalesce(1))
    total = rows.count()
    weights, bias = [0.0] * PLACES, 0.0
    if not total:
        return weights, bias
    for _ in range(steps):
        scored = rows.withColumn("error", (F.col("label") - 1 / (1 + F.exp(-margin(F.col("places"), weights, bias)))) / total)
        # place -1 stands for the bias
        slope = scored.select("error", F.explode(F.concat("places", F.array(F.lit(-1)))).alias("place"), F.sqrt(F.size("places")).alias("norm"))
        slope = slope.groupBy("place").agg(F.sum(F.col("error") / F.when(F.col("place") < 0, 1.0).otherwise(F.col("norm"))).alias("g"))
        for place, g in slope.collect():  # at most PLACES rows and one
            if place < 0:
                bias += rate * g
            else:
                weights[place] += rate * (g - keep * weights[place])
    return weights, bias


def judge(
    pages: DataFrame, rules: list[tuple[str, str, str]], model: tuple[list[float], float], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row for each input row.

    A null url, or one without ://, has an empty host and path, fits no rule and is judged by the model like any other.
    score is the model's, from 0 to 1; 0.5 or more blocks where no rule decides. Other columns are ignored.
    """
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    parts = parts.withColumn("chosen", rule_of(F.col("host"), F.col("path"), rules))
    parts = parts.withColumn("score", 1 / (1 + F.exp(-margin(places(F.col("host"), F.col("path")), *model))))
    verdict = F.coalesce(F.col("chosen.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return parts.select("page_id", "host", "path", F.col("chosen.rule").alias("rule"), verdict.alias("verdict"), "score")

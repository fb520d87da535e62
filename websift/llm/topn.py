"""The N items with the highest score in every group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from websift.llm.lines import BROADCAST_ROWS, small
from websift.session import materialise

#: In how many parts the rows of a hot group are joined and ranked.
PARTS = 32


def best_of_each_item(rows: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """Each (group, item) once, with its highest score; null and NaN scores and null groups or items do not count. -0.0 equals 0.0."""
    ok = rows.select(F.col(group).alias("g"), F.col(item).alias("i"), (F.col(score) + F.lit(0.0).cast("float")).alias("s")).where("g is not null and i is not null and s is not null and not isnan(s)")
    return ok.groupBy("g", "i").agg(F.max("s").alias("s"))


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int = 5, bands: int = 6, hot_rows: int = 100_000) -> DataFrame:
    """group, item, score of the n items with the highest score of every group, equal scores by smaller item.

    A (group, item) that stands more than once counts once with its highest score; null or NaN scores, null groups and null
    items do not count. Infinite scores count. A group with fewer than n items gives all. An empty table, or n below 1, gives no rows.

    Method: descending score bands. Band edges are quantiles of the scores (an approximate quantile moves the edges, never the
    result), geometric from the top: each band holds about four times the rows above it. Each band is a folder of its own. Bands are taken from the top; a band first loses
    the groups already filled (anti-join), then counts its items of each open group on the map side. A group whose count stays
    within its need takes the whole band without sorting; where the count passes the need, the band is its boundary, and exact
    ranking by (score, item) of the band's rows finishes it. The rows of a group with more than hot_rows are spread over PARTS salts: joins
    with the tables of groups go by group and salt, and ranking is done in two stages, within a salt and then among the at most PARTS * n
    that are left, so a group with a third of all rows is never in one task.
    """
    best = materialise(best_of_each_item(rows, group, item, score), "topn-items")
    item_type = best.schema["i"].dataType
    if n < 1:
        return best.where("false").select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score))
    shares = [1 - 0.25**k for k in range(bands - 1, 0, -1)]
    # NaN can't stand here; infinities are kept out of the quantiles only.
    edges = best.where("abs(s) < double('inf')").approxQuantile("s", shares, 0.001) if shares else []
    edges = sorted(set(edges), reverse=True)
    band_of = sum((F.when(F.col("s") < F.lit(e).cast("double"), 1).otherwise(0) for e in edges), F.lit(0))
    hot = materialise(best.groupBy("g").agg(F.count("*").alias("k")).where(F.col("k") > hot_rows).select("g", F.lit(True).alias("hot")), "topn-hot")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("i"), F.lit(PARTS)).cast("int")).otherwise(0)
    banded = materialise(best.join(small(hot), "g", "left").select("g", "i", "s", salt.alias("salt"), band_of.alias("band")), "topn-bands", by="band")
    need = None
    taken: list[DataFrame] = []
    for k in range(len(edges) + 1):
        band = banded.where(F.col("band") == k).drop("band")
        if need is not None:
            band = band.join(_salted(need.where("left_over <= 0").select("g"), hot), ["g", "salt"], "left_anti")
        counts = band.groupBy("g").agg(F.count("*").alias("n_band"))
        wants = counts if need is None else counts.join(need, "g", "left")
        left = F.lit(n) if need is None else F.coalesce("left_over", F.lit(n))
        wants = materialise(wants.select("g", "n_band", left.cast("long").alias("want")), "topn-wants")
        band = band.join(_salted(wants, hot), ["g", "salt"])
        whole = band.where("n_band <= want").select("g", "i", "s")
        taken += [whole, _exact(band.where("n_band > want"), n)]
        if k < len(edges):
            now = wants.select("g", (F.col("want") - F.least("n_band", "want")).alias("left_over"))
            need = now if need is None else need.join(now.withColumnRenamed("left_over", "new"), "g", "full").select("g", F.coalesce("new", "left_over").alias("left_over"))
            need = materialise(need, "topn-need")
    out = reduce(DataFrame.unionByName, taken)
    return out.select(F.col("g").alias(group), F.col("i").cast(item_type).alias(item), F.col("s").alias(score))


def _salted(groups: DataFrame, hot: DataFrame) -> DataFrame:
    """The groups with a row for each of their salts."""
    last = F.when(F.col("hot"), PARTS - 1).otherwise(0)
    spread = groups.join(small(hot), "g", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), last))).drop("hot")
    return F.broadcast(spread) if groups.count() <= BROADCAST_ROWS else spread


def _exact(band: DataFrame, n: int) -> DataFrame:
    """The first want items by (score desc, item) of each group of a band, which is salted."""
    order = [F.desc("s"), F.asc("i")]
    first = band.withColumn("r", F.row_number().over(Window.partitionBy("g", "salt").orderBy(*order))).where(F.col("r") <= F.least(F.col("want"), F.lit(n)))
    return first.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where("r <= want").select("g", "i", "s")

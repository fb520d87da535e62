"""The link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(links: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """src, dst with redirected targets replaced; parallel edges stay. Null ends are dropped."""
    links = links.select("src", "dst").where("src is not null and dst is not null")
    if redirects is None:
        return links
    to = redirects.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
    return links.join(to, "dst", "left").select("src", F.coalesce("to", "dst").alias("dst"))


def keep_known(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges between two different pages that both exist; pages has the column page_key."""
    keys = pages.select(F.col("page_key").alias("dst"))
    return edges.where("src <> dst").join(keys, "dst", "left_semi").select("src", "dst")


def out_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """page_key, degree, also for pages without a link."""
    d = edges.groupBy(F.col("src").alias("page_key")).agg(F.count("*").alias("degree"))
    return nodes.select("page_key").join(d, "page_key", "left").select("page_key", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def degree_histogram(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """degree, n for every degree from 0 to the largest, also those that no page has."""
    h = out_degrees(edges, nodes).groupBy("degree").agg(F.count("*").alias("n"))
    every = h.agg(F.max("degree").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("degree"))
    return every.join(h, "degree", "left").select("degree", F.coalesce("n", F.lit(0).cast("long")).alias("n"))

"""Filters of the crawl: which URLs to fetch, which pages to keep, how long to wait."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from websift import schema as S
from websift.functions.urls import host_queue, path_and_query


def url_decision(url: Column, filters: list[Column], allowed: Column) -> Column:
    """The state a URL gets before a fetch: -1 skipped (stays as it is), 130 by a filter, 132 by robots rules, null to fetch."""
    struck = F.lit(False)
    for f in filters:
        struck = struck | F.coalesce(f, F.lit(False))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path.isin("/robots.txt", "/favicon.ico"), -1).when(struck, S.ERROR_FILTER_URL).when(~allowed, S.ERROR_ROBOT)


def page_decision(no_index: Column, filters: list[Column]) -> Column:
    """The state of a parsed page: 133, then 131 by a filter, else 4."""
    struck = F.lit(False)
    for f in filters:
        struck = struck | F.coalesce(f, F.lit(False))
    return F.when(no_index, S.ERROR_NO_INDEX).when(struck, S.ERROR_FILTER_PAGE).otherwise(S.FILE_HTML)


def clamp_delay(delay: Column, least: float = 0.5, most: float = 10.0) -> Column:
    """The wait between two fetches of a host in seconds; null counts as 0."""
    return F.least(F.greatest(F.coalesce(delay.cast("double"), F.lit(0.0)), F.lit(least)), F.lit(most))


def host_queues(urls: DataFrame) -> DataFrame:
    """queue, n, first_url, last_url of each host queue. Counts and ends instead of a list: one host may hold a third of all URLs."""
    return urls.select(host_queue(F.col("url")).alias("queue"), "url").where("queue is not null").groupBy("queue").agg(F.count_distinct("url").alias("n"), F.min("url").alias("first_url"), F.max("url").alias("last_url"))


def host_lists(urls: DataFrame, digits: int = 2) -> DataFrame:
    """queue, bucket, urls: the distinct URLs of each host queue in text order, cut into buckets by the first hex digits of their keys.

    A host may hold a third of all URLs: with d digits a list holds one in 16^d of its host's.
    """
    rows = urls.select(host_queue(F.col("url")).alias("queue"), F.left(F.sha2("url", 256), F.lit(digits)).alias("bucket"), "url").where("queue is not null")
    return rows.groupBy("queue", "bucket").agg(F.array_sort(F.collect_set("url")).alias("urls"))


def robots_needed(queues: DataFrame, cached: DataFrame, now: Column, life: Column) -> DataFrame:
    """queue: the distinct host queues without robots rules younger than life. cached: queue, fetched_at; an empty answer is one too."""
    fresh = cached.where(F.col("fetched_at") > now - life).select("queue").distinct()
    return queues.where("queue is not null").select("queue").distinct().join(fresh, "queue", "left_anti")


def with_target(urls: DataFrame) -> DataFrame:
    return urls.withColumn("target", path_and_query(F.col("url")))

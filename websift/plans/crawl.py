"""The crawl as a fixpoint of DataFrame rounds over tables in one folder: state, urls, pages, robots."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from websift import schema as S
from websift.functions import html, robots, urls
from websift.functions.keys import key_hex
from websift.operators import decide, state
from websift.session import materialise
from websift.sources.fetch import Transport, fetch, fetch_following


@dataclass
class CrawlConfig:
    """url_filters and page_filters: Columns that are true for what is struck out; over url, and over the fields of html.META.

    sleep waits between two fetches of a host; None fetches without a wait. strict_structure: a page whose body a search that climbs
    one level can't reach is a parsing error.
    """

    transport: Transport
    url_filters: list[Column] = field(default_factory=list)
    page_filters: list[Column] = field(default_factory=list)
    max_length: int = 15_000_000
    robots_hops: int = 5
    robots_length: int = 5_001_024
    robots_life: timedelta = timedelta(hours=24)
    max_rounds: int = 1000
    min_delay: float = 0.5
    max_delay: float = 10.0
    sleep: Callable[[float], None] | None = time.sleep
    strict_structure: bool = False
    #: The current states are written out every so many rounds, so that a round reads them and the log since.
    compact_rounds: int = 10


#: A batch of fetched pages leaves Python when it holds so many bytes of html.
BATCH_BYTES = 32_000_000
FETCHED = "url_key string, url string, kind int, dest string, html string, lang string, title string, description string, no_follow boolean, no_index boolean, links array<string>, digest string"
EMPTY = {"urls": "url_key string, url string", "pages": "url_key string, url string, html string, lang string, title string, description string, digest string", "robots": "queue string, content string, fetched_at timestamp"}


class Store:
    """Append-only Parquet tables; a batch is one append."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.compacted: tuple[DataFrame, int] | None = None
        for name in (*EMPTY, "state"):
            schema = S.STATE_LOG if name == "state" else EMPTY[name]
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{folder}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(S.STATE_LOG if name == "state" else EMPTY[name]).parquet(f"{self.folder}/{name}")

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(f"{self.folder}/{name}")

    def current(self) -> DataFrame:
        log = self.table("state")
        if self.compacted is None:
            return state.current(log)
        before, seq = self.compacted
        return state.current(before.select(*log.columns).unionByName(log.where(F.col("seq") > seq)))

    def compact(self, seq: int) -> None:
        """Writes the current states; all records up to seq must have been appended. A tombstone has done its work by then."""
        self.compacted = (materialise(self.current(), "states"), seq)

    def known_urls(self) -> DataFrame:
        """URLs discovered and not fetched."""
        return self.table("urls").join(state.known(self.current()), "url_key", "left_semi")

    def add_unknown(self, found: DataFrame, seq: int) -> DataFrame:
        """Keeps the URLs without a state, adds them as known and returns them."""
        fresh = materialise(found.select(key_hex(F.col("url")).alias("url_key"), "url").dropDuplicates(["url_key"]).join(self.current().select("url_key"), "url_key", "left_anti"), "fresh")
        self.append("urls", fresh)
        self.append("state", state.set_simple(fresh, S.KNOW, seq))
        return fresh


def _fetched(config_parts: tuple, key: str, url: str) -> list:
    """A row of FETCHED."""
    transport, max_length, strict = config_parts
    got = fetch(transport, urls.strip_empty_port(url), max_length)
    row = [key, url, S.ERROR_NETWORK, *[None] * 7, [], None]
    if got.redirect is not None:
        row[2:4] = S.REDIRECT, got.redirect
    elif got.body is not None:
        root = html.parse(text := got.body.decode("utf-8", "replace"))
        if strict and not html.is_strict(root):
            row[2] = S.ERROR_PARSING
            return row
        meta = html.meta(root)
        links = urls.page_links(url, [x.attrs["href"] for x in html._walk(root.children[1]) if x.tag == "a" and "href" in x.attrs])
        row[2:] = [S.FILE_HTML, None, text, meta["lang"], meta["title"], meta["description"], meta["no_follow"], meta["no_index"], links, hashlib.sha256(text.encode()).hexdigest()]
    return row


def _fetch_pages(config: CrawlConfig) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    parts, sleep = (config.transport, config.max_length, config.strict_structure), config.sleep  # Columns can't be sent to a worker

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FETCHED.split(", ")]
        rows, size, queue = [], 0, None
        for b in batches:
            for key, url, delay, host in zip(b.url_key, b.url, b.delay, b.queue, strict=True):
                if sleep and host == queue:
                    sleep(delay)
                queue = host
                rows.append(_fetched(parts, key, url))
                size += len(rows[-1][4] or "")
                if size > BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return run


def _fetch_robots(config: CrawlConfig) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    transport, hops, length = config.transport, config.robots_hops, config.robots_length

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [fetch_following(transport, f"{q.replace(':', '://', 1)}/robots.txt", hops, length).body for q in b.queue]
            yield pd.DataFrame({"queue": b.queue, "content": [None if x is None else x.decode("utf-8", "replace") for x in got]})

    return run


def plan(store: Store, seeds: DataFrame) -> DataFrame:
    """url_key, url: what a crawl begins with, the URLs the store knows and has not fetched and the cleaned seeds, each once."""
    cleaned = seeds.select(urls.clean_url("url").alias("url")).where("url is not null").select(key_hex(F.col("url")).alias("url_key"), "url")
    return store.known_urls().unionByName(cleaned).dropDuplicates(["url_key"])


def crawl(store: Store, seeds: DataFrame, config: CrawlConfig, now: datetime, first_seq: int = 1) -> int:
    """Runs rounds until nothing is left to plan; returns how many. seeds: column url; they are planned even if the store has them.

    A round: plan, strike by filter, robots of the hosts that still need them (kept for robots_life, a failure too, as 'allow
    all'), strike by robots, fetch with one task a host queue, parse, page decisions, append states and pages, expand links.
    """
    seq = first_seq
    front = plan(store, seeds)
    for done in range(config.max_rounds):
        at = F.lit(now)
        front = materialise(front.withColumn("queue", urls.host_queue(F.col("url"))), "front")
        if front.isEmpty():
            return done
        decided = front.withColumn("decision", decide.url_decision(F.col("url"), config.url_filters, F.lit(True)))
        cached = store.table("robots")
        rules = cached.where(F.col("fetched_at") > F.lit(now - config.robots_life)).groupBy("queue").agg(F.max_by("content", "fetched_at").alias("content"))
        missing = decide.robots_needed(decided.where("decision is null"), cached, at, F.lit(config.robots_life))
        fresh = materialise(missing.mapInPandas(_fetch_robots(config), "queue string, content string").withColumn("fetched_at", at), "robots")
        store.append("robots", fresh)
        robots_url = F.concat(F.regexp_replace("queue", "^([a-z0-9+.-]+):", "$1://"), F.lit("/robots.txt"))
        store.append("state", state.set_value(fresh.select(key_hex(robots_url).alias("url_key"), at.alias("state_time"), F.lit(0).alias("blob_position"), F.coalesce(F.octet_length("content"), F.lit(0)).alias("blob_length")), S.FILE_ROBOTS, seq + 1))
        rules = rules.unionByName(fresh.select("queue", "content"))
        judged = decided.join(rules, "queue", "left").withColumn("allowed", robots.robots_allow("content", urls.path_and_query(F.col("url"))))
        judged = judged.withColumn("delay", decide.clamp_delay(robots.parse_robots("content")["crawl_delay"], config.min_delay, config.max_delay))
        judged = materialise(judged.select("url_key", "url", "queue", "delay", decide.url_decision(F.col("url"), config.url_filters, F.col("allowed")).alias("decision")), "judged")
        struck = judged.where("decision >= 0")
        store.append("state", state.records(struck.withColumn("state_time", at), F.col("decision"), seq + 2))
        fetched = judged.where("decision is null").repartition("queue").sortWithinPartitions("queue").select("url_key", "url", "delay", "queue").mapInPandas(_fetch_pages(config), FETCHED)
        final = F.when(F.col("kind") == S.FILE_HTML, decide.page_decision(F.col("no_index"), config.page_filters)).otherwise(F.col("kind"))
        fetched = materialise(fetched.withColumn("kind", final), "fetched")
        changes = fetched.select("url_key", at.alias("state_time"), "kind", F.when(F.col("kind") == S.REDIRECT, key_hex(F.col("dest"))).alias("dest_key"), F.when(F.col("kind") == S.FILE_HTML, F.octet_length("html")).alias("blob_length"))
        store.append("state", state.records(changes, F.col("kind"), seq + 3))
        pages = fetched.where(F.col("kind") == S.FILE_HTML)
        store.append("pages", pages.select("url_key", "url", "html", "lang", "title", "description", "digest"))
        found = pages.where("not no_follow").select(F.explode("links").alias("url")).unionByName(fetched.where(F.col("kind") == S.REDIRECT).select(F.explode(urls.expand_url("dest")).alias("url")))
        front = store.add_unknown(found, seq + 4)
        if done % config.compact_rounds == config.compact_rounds - 1:
            store.compact(seq + 4)
        seq += 5
    return config.max_rounds

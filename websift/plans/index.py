"""From parsed pages to the two tables of the index: postings and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from websift.functions.html import parse_pages
from websift.functions.keys import key_hex
from websift.functions.urls import links_of
from websift.operators import links, postings, rank, state
from websift.session import materialise


def build(pages: DataFrame, log: DataFrame | None, folder: str, max_steps: int = 200, epsilon: float = 1e-5) -> dict[str, DataFrame]:
    """Parses each page once, writes postings (sorted by word) and ranks under folder and returns both tables.

    page_key is the key of the page's URL. log: the URL-state log whose redirects replace link targets.
    """
    parsed = materialise(parse_pages(pages, columns=("hrefs", "body_text")).select(key_hex(F.col("url")).alias("page_key"), "url", "body_text", links_of("url", "hrefs").alias("links")), "parsed")
    postings.write_index(postings.postings(parsed, "page_key", "body_text"), f"{folder}/postings")
    raw = parsed.select(F.col("page_key").alias("src"), F.explode("links").alias("to")).select("src", key_hex(F.col("to")).alias("dst"))
    moved = None if log is None else state.redirect_targets(state.current(log)).select(F.col("url_key").alias("src"), F.col("target").alias("dst"))
    ranks = rank.rank(links.build(raw, moved), parsed.select("page_key"), max_steps, epsilon)
    ranks.write.mode("overwrite").parquet(f"{folder}/rank")
    spark = pages.sparkSession
    return {"postings": spark.read.parquet(f"{folder}/postings"), "rank": spark.read.parquet(f"{folder}/rank")}

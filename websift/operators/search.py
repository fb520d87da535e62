"""AND queries over postings: parse, retrieve, score, page."""

from __future__ import annotations

import math


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_SIZE = 10


def parse_query(query: str) -> list[str]:
    """The words of a query by the rule of websift.functions.text.tokens, duplicates kept."""
    import unicodedata

    out, run = [], ""
    for c in query + " ":
        if c == "-" or unicodedata.category(c)[0] in "LN":
            run += c
            continue
        if len(run.encode()) >= 3 and run.replace(run[0], ""):
            out.append("".join(x.lower() if len(x.lower()) == 1 else x.lower()[0] for x in run))
        run = ""
    return out


def query_terms(terms: list[str], posts: DataFrame) -> DataFrame:
    """position, word, df of each query word, also for words that no page has."""
    spark = posts.sparkSession
    asked = spark.createDataFrame(list(enumerate(terms)), "position int, word string")
    df = posts.where(F.col("word").isin(sorted(set(terms)))).groupBy("word").agg(F.count("*").alias("df"))
    return asked.join(df, "word", "left").select("position", "word", F.coalesce("df", F.lit(0).cast("long")).alias("df"))


def retrieve(terms: list[str], posts: DataFrame, key: str = "page_key") -> DataFrame:
    """key, tf of the pages that hold every word; tf is that of the first word. One shuffle whatever the number of words.

    posts has one row a word and page. No words: no pages.
    """
    if not terms:
        return posts.where("false").select(key, "tf")
    distinct = sorted(set(terms))
    hits = posts.where(F.col("word").isin(distinct)).groupBy(key).agg(F.count("*").alias("k"), F.max(F.when(F.col("word") == terms[0], F.col("tf"))).alias("tf"))
    return hits.where(F.col("k") == len(distinct)).select(key, "tf")


def intersect(a: DataFrame, b: DataFrame, key: str = "page_key") -> DataFrame:
    """The rows of a whose key is in b."""
    return a.join(b.select(key), key, "left_semi")


def score(hits: DataFrame, ranks: DataFrame | None, key: str = "page_key") -> DataFrame:
    """key, score = tf of the first word + rank; a page without rank has rank 0."""
    if ranks is None:
        return hits.select(key, F.col("tf").cast("double").alias("score"))
    return hits.join(ranks.select(key, "rank"), key, "left").select(key, (F.col("tf") + F.coalesce("rank", F.lit(0.0))).alias("score"))


def page_of(scored: DataFrame, page: int, key: str = "page_key", size: int = PAGE_SIZE) -> DataFrame:
    """The page-th (from 0) results, highest score first, equal scores by key."""
    return scored.orderBy(F.desc("score"), key).offset(size * page).limit(size)


def n_chunks(n: int, size: int = PAGE_SIZE) -> int:
    return math.ceil(n / size)


def search(query: str, page: int, posts: DataFrame, ranks: DataFrame | None, pages: DataFrame, key: str = "page_key") -> dict:
    """Terms with their df, the results of one page with url, title and description, the number of results and of result pages.

    ValueError for a page below 0 or past the last, or a hit that has no stored page. An empty query has an empty page 0.
    """
    if page < 0:
        raise ValueError("page is below 0")
    terms = parse_query(query)
    scored = score(retrieve(terms, posts, key), ranks, key)
    n = scored.count() if terms else 0
    if page * PAGE_SIZE > n or not terms and page > 0:
        raise ValueError("page is past the last result")
    top = page_of(scored, page, key)
    rows = [r.asDict() for r in top.join(pages.select(key, "url", "title", "description"), key, "left").orderBy(F.desc("score"), key).collect()]  # PAGE_SIZE rows
    if any(r["url"] is None for r in rows):
        raise ValueError("a result has no stored page")
    return {"terms": [r.asDict() for r in query_terms(terms, posts).orderBy("position").collect()] if terms else [], "results": rows, "n": n, "chunks": n_chunks(n)}


def parse_params(q: str | None, page: str | None) -> tuple[str, int] | None:
    """Query and page of a request; None if there is no query (the caller shows the start page). ValueError for a page that is no whole number from 0."""
    if not q:
        return None
    if page in (None, ""):
        return q, 0
    if not (page.isascii() and page.isdigit()):
        raise ValueError("page is no whole number")
    return q, int(page)

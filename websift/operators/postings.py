"""Vocabulary counts and the inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from websift.functions.text import tokens
from websift.session import materialise


def words(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row for each word of each text: key, word. Null and empty texts have no word."""
    return texts.select(F.col(key), F.explode(tokens(F.col(text))).alias("word"))


def vocabulary(texts: DataFrame, text: str = "text") -> DataFrame:
    """word, n: how often each word occurs. Counted on the map side before the shuffle."""
    return texts.select(F.explode(tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def vocabulary_totals(vocab: DataFrame) -> DataFrame:
    """One row: n_tokens, n_words. vocab has one row a word."""
    return vocab.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.count("*").alias("n_words"))


def top_words(vocab: DataFrame, k: int = 100) -> DataFrame:
    """The k most frequent words, equal counts by word."""
    return vocab.orderBy(F.desc("n"), "word").limit(k)


def postings(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """word, key, tf as DOUBLE: how often the word occurs in the page."""
    return words(texts, key, text).groupBy("word", key).agg(F.count("*").cast("double").alias("tf"))


def posting_lists(posts: DataFrame, key: str, most: int = 50_000) -> DataFrame:
    """word, bucket, items: the posting list of each word in key order. The list of a word on more than most pages is cut into buckets.

    bucket: the first hex digits of the key's SHA-256, one digit for each factor of 16 by which the list is longer than most; '' for a
    list in one piece. So no list grows with the collection, and a hot word spreads over tasks. posts has one row a word and page.
    """
    df = document_frequency(posts).where(F.col("df") > most)
    digits = F.ceil(F.log(F.col("df") / most) / F.log(F.lit(16.0))).cast("int")
    long = materialise(df.select("word", digits.alias("digits")), "long-lists")
    # Every long list has more than most rows, so there are few of them; a larger table is left to the planner.
    known = F.broadcast(long) if long.count() <= 100_000 else long
    bucket = F.left(F.sha2(F.col(key).cast("string"), 256), F.coalesce("digits", F.lit(0)))
    rows = posts.join(known, "word", "left").select("word", bucket.alias("bucket"), F.struct(F.col(key), F.col("tf").cast("float").alias("f32")).alias("item"))
    return rows.groupBy("word", "bucket").agg(F.array_sort(F.collect_list("item")).alias("items"))


def document_frequency(posts: DataFrame) -> DataFrame:
    """word, df: in how many pages each word stands; posts has one row a word and page."""
    return posts.groupBy("word").agg(F.count("*").alias("df"))


def write_index(posts: DataFrame, path: str, files: int = 64) -> None:
    """Parquet, range-parted and sorted by word: a query for a few words reads a few row groups."""
    posts.repartitionByRange(files, "word", posts.columns[1]).sortWithinPartitions("word", posts.columns[1]).write.mode("overwrite").parquet(path)

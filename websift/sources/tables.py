"""Readers of the Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from websift.schema import STATE_LOG


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table by its name; filters and column selections reach the Parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def memory_store(spark: SparkSession, rows: list[tuple] = ()) -> DataFrame:
    """A state log held in memory, for tests."""
    return spark.createDataFrame(list(rows), STATE_LOG)


def fake_store(spark: SparkSession, n: int = 51) -> dict[str, DataFrame]:
    """n pages that all hold 'pebble': key i, rank 100 - i, tf 0."""
    ids = spark.range(n).select(F.col("id").alias("page_key"))
    return {
        "postings": ids.select(F.lit("pebble").alias("word"), "page_key", F.lit(0.0).alias("tf")),
        "rank": ids.select("page_key", (100.0 - F.col("page_key")).alias("rank")),
        "pages": ids.select("page_key", F.concat(F.lit("https://shingle.test/"), "page_key").alias("url"), F.concat(F.lit("Stone "), "page_key").alias("title"), F.concat(F.lit("About stone "), "page_key").alias("description")),
    }


def url_list(lines: DataFrame, state: DataFrame, accepted: list[int]) -> DataFrame:
    """The URLs of a text file (column value) whose current state is accepted; lines that are no absolute URL stay out."""
    ok = lines.where(F.col("value").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]")).select(F.col("value").alias("url"), F.sha2("value", 256).alias("url_key"))
    return ok.join(state.where(F.col("state_type").isin(accepted)).select("url_key"), "url_key", "left_semi")


Processor = Callable[[DataFrame], DataFrame]


def process(pages: DataFrame, processors: dict[str, Processor]) -> dict[str, DataFrame]:
    """One parsed scan feeds several processors. The scan is kept on disk and in memory, and unpersisted by the caller through 'scan'."""
    scan = pages.persist()
    return {"scan": scan} | {name: p(scan) for name, p in processors.items()}

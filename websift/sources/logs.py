"""Log records as gzipped JSON lines, and a transport that logs its requests."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from websift.sources.fetch import Response, Transport

LOG = "time timestamp, level string, msg string, attrs map<string,string>"


def write_log(records: DataFrame, folder: str) -> None:
    """Appends records of LOG to a folder of gzipped JSON lines."""
    records.select("time", "level", "msg", "attrs").write.mode("append").json(folder, compression="gzip")


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LOG).json(folder)


def logged(transport: Transport, log: Callable[[str, dict], None] | None = None) -> Transport:
    """The transport; each request is logged as fetch.ok with status and url, or as fetch.err with err and url."""
    say = log or (lambda msg, attrs: logging.getLogger("websift.fetch").info("%s %s", msg, attrs))

    def run(url: str) -> Response:
        try:
            r = transport(url)
        except Exception as e:
            say("fetch.err", {"err": str(e), "url": url})
            raise
        say("fetch.ok", {"status": r.status, "url": url})
        return r

    return run

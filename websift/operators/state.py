"""The log of URL states: current state, changes, statistics, redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from websift import schema as S
from websift.session import materialise

VALUE = ["state_type", "state_time", "dest_key", "blob_position", "blob_length"]


def current(log: DataFrame) -> DataFrame:
    """The last record (highest seq) of each key; keys whose last record is a tombstone are gone. Aggregates on the map side."""
    last = log.groupBy("url_key").agg(F.max_by(F.struct("seq", *VALUE), "seq").alias("last"))
    return last.select("url_key", "last.*").where(F.col("state_type") != S.NOTHING)


def known(state: DataFrame) -> DataFrame:
    """Keys discovered and not fetched."""
    return state.where(F.col("state_type") == S.KNOW).select("url_key")


def unknown(candidates: DataFrame, state: DataFrame) -> DataFrame:
    """The distinct candidate keys that have no state."""
    return candidates.select("url_key").distinct().join(state.select("url_key"), "url_key", "left_anti")


def records(changes: DataFrame, state_type: int | Column, first_seq: int | Column) -> DataFrame:
    """New log rows for the keys of changes; columns it lacks are null. seq only has to rise from batch to batch."""
    kind = F.lit(state_type) if isinstance(state_type, int) else state_type
    own = {c: F.col(c) if c in changes.columns else F.lit(None) for c in VALUE[1:]}
    out = changes.select(F.lit(first_seq).cast("long").alias("seq"), "url_key", kind.alias("state_type"), *[v.alias(c) for c, v in own.items()])
    return out.select(*[F.col(f.name).cast(f.dataType) for f in S.STATE_LOG])


def set_simple(keys: DataFrame, state_type: int, seq: int) -> DataFrame:
    """A state without payload; 0 is a tombstone. ValueError for a file type, which needs a value."""
    if S.FILE_ROBOTS <= state_type < 128:
        raise ValueError("a file state needs a value")
    return records(keys, state_type, seq)


def set_redirect(pairs: DataFrame, seq: int) -> DataFrame:
    """pairs: url_key, dest_key."""
    return records(pairs, S.REDIRECT, seq)


def set_value(files: DataFrame, state_type: int, seq: int) -> DataFrame:
    """files: url_key, blob_position, blob_length. ValueError for what is no file type."""
    if not S.FILE_ROBOTS <= state_type < 128:
        raise ValueError("not a file type")
    return records(files, state_type, seq)


def html_entries(state: DataFrame) -> DataFrame:
    """Keys of stored HTML pages."""
    return state.where(F.col("state_type") == S.FILE_HTML)


def lookup(keys: DataFrame, state: DataFrame) -> DataFrame:
    """For each key of keys: 'ok' and the time stored, 'notFile', or 'notExist'."""
    got = keys.select("url_key").join(state.select("url_key", "state_type", "state_time"), "url_key", "left")
    kind = F.when(F.col("state_type").isNull(), "notExist").when(S.is_file(F.col("state_type")), "ok").otherwise("notFile")
    return got.select("url_key", kind.alias("status"), F.when(kind == "ok", F.col("state_time")).alias("state_time"))


def values(keys: DataFrame, state: DataFrame, contents: DataFrame) -> DataFrame:
    """url_key, status, state_time, content of each key asked for. contents: url_key, content, digest (SHA-256 in hex of what was stored).

    status as in lookup, or 'damaged' where the content is absent or the last 20 bytes of its digest differ; content only with 'ok'.
    """
    got = lookup(keys, state).join(contents.select("url_key", "content", "digest"), "url_key", "left")
    intact = F.coalesce(F.right(F.sha2("content", 256), F.lit(40)) == F.right("digest", F.lit(40)), F.lit(False))
    status = F.when((F.col("status") == "ok") & ~intact, "damaged").otherwise(F.col("status"))
    return got.select("url_key", status.alias("status"), "state_time", F.when(status == "ok", F.col("content")).alias("content"))


def statistics(state: DataFrame) -> DataFrame:
    """state_type, name, n, percent of all (whole numbers), bytes, percent of all bytes; one row for each type there is.

    The log is added up by type on the map side; the percentages are windows over the at most 256 types.
    """
    t = F.col("state_type")
    size = F.when(S.is_file(t), F.coalesce("blob_length", F.lit(0)).cast("long")).otherwise(F.lit(0).cast("long"))
    by = state.groupBy("state_type").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    all_types = Window.partitionBy(F.lit(0))
    by = by.withColumn("tn", F.sum("n").over(all_types)).withColumn("tb", F.sum("bytes").over(all_types))
    part = lambda x, total: F.when(F.col(total) == 0, F.lit(0).cast("long")).otherwise(F.expr(f"{x} * 100 div {total}"))
    return by.select("state_type", S.state_name(t).alias("name"), "n", part("n", "tn").alias("percent"), "bytes", part("bytes", "tb").alias("percent_bytes"))


def totals(state: DataFrame) -> DataFrame:
    t = F.col("state_type")
    return state.agg(
        F.count("*").alias("total"), F.count_if(S.is_file(t)).alias("total_file"), F.count_if(S.is_error(t)).alias("total_error"),
        F.coalesce(F.sum(F.when(S.is_file(t), F.col("blob_length").cast("long"))), F.lit(0)).alias("total_bytes"), F.count_if(t == S.FILE_HTML).alias("n_html"),
    )


def redirect_targets(state: DataFrame, lookups: int = 10) -> DataFrame:
    """url_key, target: the file each redirect leads to within so many lookups; loops, dead ends and longer chains are absent.

    Pointer chains are followed by equi joins. Only open chains are carried on; a step is written out every few joins so that the plan stays small.
    """
    links = state.where(F.col("state_type") == S.REDIRECT).select(F.col("url_key").alias("at"), F.col("dest_key").alias("to"))
    files = state.where(S.is_file(F.col("state_type"))).select(F.col("url_key").alias("at"))
    nodes = links.unionByName(files.withColumn("to", F.lit(None).cast("string")))
    front = links.select(F.col("at").alias("url_key"), F.col("to").alias("at"), F.lit(False).alias("done"))
    for step in range(1, lookups):
        # A file keeps its place (to is null there), a redirect moves on, anything else is dropped by the inner join.
        front = front.join(nodes, "at").select("url_key", F.coalesce("to", "at").alias("at"), F.col("to").isNull().alias("done"))
        if step % 4 == 0:
            front = materialise(front, "redirects")
    return front.where("done").select("url_key", F.col("at").alias("target"))

"""Frequency of every term over the collection, with a mark on those too rare or too common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of Unicode, and the zero-width marks that no one sees.
BLANK = r"[\s\p{Z}\x{85}\x{200B}\x{FEFF}]+"


def clean_word(word: Column) -> Column:
    """Without surrounding white space, lower case; null for a blank."""
    trimmed = F.regexp_replace(word, f"^{BLANK}|{BLANK}$", "")
    return F.nullif(F.lower(trimmed), F.lit(""))


def term_frequency(counts: DataFrame, record: str = "page_id", word: str = "word", n: str = "word_count") -> DataFrame:
    """word, total, records: the total count of each word and in how many distinct records it stands.

    Rows alike in all columns count once. Rows with a null record, a null or blank word, or a count that is null or below 1
    do not count. An empty table gives no rows; other columns of the table only tell rows apart.

    Method: range-partitioned external sort of (term, record) pairs. Pairs are first added up on the map side; the sort key is
    the pair, so the rows of one term may span several ranges and no range holds more than its share, however hot the term.
    Each range is scanned once, run by run, in constant memory: a run of a pair adds to its term's occurrences and one record.
    A term cut by a range end leaves a partial there; the partials (one row a term and range) are added up. A pair never
    spans two ranges, so adding the numbers of records is exact.
    """
    rows = counts.distinct() if counts.columns else counts
    pairs = rows.select(clean_word(F.col(word)).alias("word"), F.col(record).alias("record"), F.col(n).cast("long").alias("n")).where("word is not null and record is not null and n >= 1")
    pairs = pairs.groupBy("word", "record").agg(F.sum("n").alias("n"))
    ordered = pairs.repartitionByRange("word", "record").sortWithinPartitions("word", "record").select("word", "n")
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("total", T.LongType()), T.StructField("records", T.LongType())])
    return ordered.mapInArrow(_runs, schema).groupBy("word").agg(F.sum("total").alias("total"), F.sum("records").alias("records"))


def _runs(batches):  # noqa: ANN001, ANN202
    """Adds up runs of equal words of sorted batches; the open run is carried from batch to batch."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = ["word", "total", "records"]
    open_run = None
    for b in batches:
        if not b.num_rows:
            continue
        runs = pc.run_end_encode(b.column(0))
        ends = np.asarray(runs.run_ends)
        starts = np.concatenate(([0], ends[:-1]))
        words = runs.values.to_pylist()
        totals = np.add.reduceat(np.asarray(b.column(1), dtype=np.int64), starts).tolist()
        sizes = (ends - starts).tolist()
        if open_run is not None and open_run[0] == words[0]:
            totals[0] += open_run[1]
            sizes[0] += open_run[2]
            open_run = None
        head = [[x] for x in open_run] if open_run is not None else [[], [], []]
        open_run = (words.pop(), totals.pop(), sizes.pop())
        yield pa.RecordBatch.from_arrays([pa.array(head[0] + words, pa.string()), pa.array(head[1] + totals, pa.int64()), pa.array(head[2] + sizes, pa.int64())], names)
    if open_run is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_run[0]], pa.string()), pa.array([open_run[1]], pa.int64()), pa.array([open_run[2]], pa.int64())], names)


def mark_terms(frequency: DataFrame, n_records: int, common_share: float = 0.2, rare_total: int = 3) -> DataFrame:
    """word, total, records, mark: 'common' if the word stands in more than common_share of n_records, else 'rare' if its total is at most rare_total, else null."""
    mark = F.when(F.col("records") > F.lit(common_share * n_records), "common").when(F.col("total") <= rare_total, "rare")
    return frequency.select("word", "total", "records", mark.alias("mark"))

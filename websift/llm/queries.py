"""Queries of the problems on text. Each callable takes (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from websift.llm import encode, lines, mixing, pagepass, termfreq, topn, truncation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Pages with a smoothed score of so much are keyword-stuffed.
SPAM_SCORE = 0.5


def query(sql: Query | str) -> Callable[[Query], Query] | Query:
    """Registers a query; @query('sql') with the SQL that gives the same rows."""
    if callable(sql):
        QUERIES[sql.__name__] = sql
        return sql

    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pages(spark: SparkSession, d: str, parts: pagepass.Parts) -> DataFrame:
    nodes = _read(spark, d, "nodes")
    repeated = lines.repeated_lines(nodes)
    return pagepass.analyse(nodes, _read(spark, d, "page_meta"), _read(spark, d, "documents"), _read(spark, d, "lang_samples"), lines.materialise(repeated, "repeated"), parts)


def _good(pages: DataFrame) -> DataFrame:
    """Pages that are neither of problem 2 nor of problem 7."""
    stuffed = pagepass.smoothed_spam(pages).where(F.col("score") >= SPAM_SCORE).select("page_id")
    return pages.where("not coalesce(residue, false)").join(stuffed, "page_id", "left_anti")


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pages = _good(_pages(spark, d, pagepass.Parts(residue=True, spam=True, languages=True)))
    whole = pages.where("lang <> 'und' and (label is null or label <> lang)").select("page_id", F.lit(0).alias("node_id"), "lang")
    segments = pages.select("page_id", F.explode(F.arrays_zip("foreign_nodes", "foreign_langs")).alias("x")).select("page_id", F.col("x.foreign_nodes").alias("node_id"), F.col("x.foreign_langs").alias("lang"))
    return whole.unionByName(segments)


@query
def p1_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every page (node 0) with main text, and of each of its main-text nodes in another language."""
    pages = _pages(spark, d, pagepass.Parts(languages=True))
    whole = pages.where("lang is not null").select("page_id", F.lit(0).alias("node_id"), "lang", "confidence")
    x = F.explode(F.arrays_zip("foreign_nodes", "foreign_langs", "foreign_confidence")).alias("x")
    segments = pages.select("page_id", x).select("page_id", F.col("x.foreign_nodes").alias("node_id"), F.col("x.foreign_langs").alias("lang"), F.col("x.foreign_confidence").alias("confidence"))
    return whole.unionByName(segments)


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d, pagepass.Parts(residue=True)).where("residue").select("page_id")


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pages = _good(_pages(spark, d, pagepass.Parts(residue=True, spam=True)))
    return pages.select("page_id", F.explode("main").alias("node_id"))


CLEAN_COUNTS = r"""d AS (SELECT DISTINCT * FROM word_frequency), t AS (SELECT page_id, lower(regexp_replace(word, '^[\s\p{Z}\x{85}\x{200B}\x{FEFF}]+|[\s\p{Z}\x{85}\x{200B}\x{FEFF}]+$', '', 'g')) AS word, word_count AS n FROM d WHERE word_count >= 1),
    f AS (SELECT word, sum(n)::BIGINT AS total, count(DISTINCT page_id) AS records FROM t WHERE word <> '' AND page_id IS NOT NULL GROUP BY word),
    m AS (SELECT f.*, CASE WHEN records > 0.2 * (SELECT count(DISTINCT page_id) FROM word_frequency) THEN 'common' WHEN total <= 3 THEN 'rare' END AS mark FROM f)"""


def _marked(spark: SparkSession, d: str) -> DataFrame:
    counts = _read(spark, d, "word_frequency")
    n = counts.agg(F.count_distinct("page_id")).first()[0]
    return termfreq.mark_terms(termfreq.term_frequency(counts), n)


@query(f"WITH {CLEAN_COUNTS} SELECT word, mark FROM m WHERE mark IS NOT NULL")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).where("mark is not null").select("word", "mark")


@query(f"WITH {CLEAN_COUNTS} SELECT word, total, records, mark FROM m")
def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d)


@query("""WITH b AS (SELECT word, item_key, max(f32) AS f32 FROM postings WHERE f32 IS NOT NULL AND NOT isnan(f32) AND word IS NOT NULL AND item_key IS NOT NULL GROUP BY word, item_key)
    SELECT word, item_key FROM b QUALIFY row_number() OVER (PARTITION BY word ORDER BY f32 DESC, item_key) <= 5""")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(_read(spark, d, "postings"), "word", "item_key", "f32", 5).select("word", "item_key")


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(_read(spark, d, "nodes"))


@query(r"""WITH l AS (SELECT DISTINCT host_name, page_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{M}]+', ' ', 'g')) AS line FROM nodes WHERE text IS NOT NULL AND host_name IS NOT NULL),
    h AS (SELECT host_name, count(DISTINCT page_id) AS n FROM nodes GROUP BY host_name)
    SELECT host_name, line, count(*) AS pages FROM l JOIN h USING (host_name) WHERE line <> '' GROUP BY host_name, line, n HAVING count(*) >= greatest(3, ceil(n * 0.2 - 1e-9))""")
def p6_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines that level one of problem 6 takes as they stand, without names filled in."""
    return lines.line_support(_read(spark, d, "nodes"))


@query
def p6_sequences(spark: SparkSession, d: str) -> DataFrame:
    """The frequent sequences of lines of every site, by line hashes, with the pages they stand on."""
    found = lines.frequent_sequences(_read(spark, d, "nodes"))
    return found.select("site", F.array_join(F.transform("lines", lambda x: x.cast("string")), " ").alias("lines"), F.size("lines").alias("n_lines"), "pages")


@query
def p6_removed(spark: SparkSession, d: str) -> DataFrame:
    """The nodes with text that stay once the repeated lines are gone."""
    nodes = _read(spark, d, "nodes")
    return lines.remove_lines(nodes.where("text is not null").select("page_id", "node_id", "text"), lines.repeated_lines(nodes))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d, pagepass.Parts(residue=True, spam=True))
    return pagepass.smoothed_spam(pages).where(F.col("score") >= SPAM_SCORE).select("page_id")


@query
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.token_ids(_read(spark, d, "documents"))


@query
def p9_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Every use of a document in a mix with its place in the training, in training order."""
    positions, _ = mixing.mix(_read(spark, d, "documents"), _read(spark, d, "mix_targets"))
    return mixing.order_by_position(positions)


@query
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    positions, plan = mixing.mix(_read(spark, d, "documents"), _read(spark, d, "mix_targets"))
    return mixing.shares(positions, plan)


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(_read(spark, d, "documents")).select("doc_id")


@query
def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    """The share of cut documents of every source."""
    documents = _read(spark, d, "documents")
    return truncation.cut_shares(documents, truncation.truncated(documents))

"""Lines repeated across one site's documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from websift.session import materialise

#: A table of at most so many rows (of a few longs) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint for a written table whose size is known to be small; other tables are left to a shuffle join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def line_text(text: Column) -> Column:
    """The words of a line in lower case, parted by a blank: without punctuation, bullets, digits and other white space."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{M}]+", " "))


def site_lines(nodes: DataFrame, max_filled_words: int = 12) -> DataFrame:
    """page_id, node_id, site, line, words, long: one row a node whose text has a letter. site and line are 64-bit hashes.

    words holds the line itself, unless max_filled_words is 0 and no filled-in name is looked for; long: it has more words than that.
    """
    words = line_text(F.col("text"))
    rows = nodes.where("text is not null and host_name is not null").select("page_id", "node_id", F.xxhash64("host_name").alias("site"), words.alias("w")).where("w <> ''")
    long = F.char_length("w") - F.char_length(F.replace("w", F.lit(" "), F.lit(""))) >= max_filled_words
    return rows.select("page_id", "node_id", "site", F.xxhash64("w").alias("line"), F.when(F.lit(max_filled_words > 0), F.col("w")).alias("words"), long.alias("long"))


def thresholds(nodes: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """site, least: how many pages of a site a line has to stand on."""
    pages = nodes.where("host_name is not null").select(F.xxhash64("host_name").alias("site"), "page_id").distinct()
    return pages.groupBy("site").agg(F.greatest(F.lit(min_pages).cast("long"), F.ceil(F.count("*") * F.lit(min_share) - 1e-9)).alias("least"))


def _supported(items: DataFrame, keys: list[str], least: DataFrame) -> DataFrame:
    """The keys that stand on enough distinct pages of their site; items: page_id and keys, of which the first is site."""
    support = items.select("page_id", *keys).distinct().groupBy(*keys).agg(F.count("*").alias("pages"))
    return support.join(least, "site").where("pages >= least").select(*keys, "pages")


def filled_lines(lines: DataFrame, least: DataFrame) -> DataFrame:
    """page_id, node_id, site, line of the short lines that are one sentence with another name filled in; line hashes that sentence.

    Every fixed word of a sentence on enough pages stands in at least as many lines, so words in fewer lines are what is
    filled in; one blank stands for a run of them. What is left must hold a fixed word. Words are counted by lines, added up
    on the map side.
    """
    short = lines.where("words is not null").select("page_id", "node_id", "site", F.split("words", " ").alias("words"))
    counted = short.select("site", F.explode(F.array_distinct("words")).alias("word")).groupBy("site", "word").agg(F.count("*").alias("n"))
    fixed = materialise(counted.join(least, "site").where("n >= least").select("site", "word", F.lit(True).alias("fixed")), "fixed-words")
    # A sentence can only qualify if its first or last word is fixed or the blank stands there: no line is lost before the join.
    parts = short.select("page_id", "node_id", "site", F.posexplode("words").alias("at", "word")).join(small(fixed), ["site", "word"], "left")
    sentence = F.array_sort(F.collect_list(F.struct("at", F.when(F.col("fixed"), F.col("word")).otherwise("*").alias("word"))))
    made = parts.groupBy("page_id", "node_id", "site").agg(sentence.alias("s"))
    text = F.regexp_replace(F.array_join(F.transform("s", lambda x: x["word"]), " "), r"\*( \*)+", "*")
    made = made.select("page_id", "node_id", "site", text.alias("s")).where(F.col("s").contains("*") & (F.col("s") != "*"))
    return made.select("page_id", "node_id", "site", F.xxhash64("s").alias("line"))


def filled_long_lines(lines: DataFrame, least: DataFrame) -> DataFrame:
    """As filled_lines, for lines of any length: their words are counted apart from those of short lines, and at least half the words are fixed.

    A sentence that is mostly other words is no fixed sentence; a long line of rare words around one 'the' would else be one. The fixed
    words of the sites are looked up in memory where they are few, so that the words of article text are not shuffled.
    """
    rows = lines.where("words is not null").select("page_id", "node_id", "site", "words")
    counted = rows.select("site", F.explode(F.array_distinct(F.split("words", " "))).alias("word")).groupBy("site", "word").agg(F.count("*").alias("n"))
    fixed = materialise(counted.join(least, "site").where("n >= least").select("site", "word"), "fixed-long-words")
    if fixed.count() <= BROADCAST_ROWS:
        known: dict[int, set[str]] = {}
        for r in fixed.collect():  # at most BROADCAST_ROWS narrow rows
            known.setdefault(r.site, set()).add(r.word)
        made = rows.mapInArrow(lambda batches: _blanked(batches, known), "page_id long, node_id int, site long, s string")
    else:
        parts = rows.select("page_id", "node_id", "site", F.posexplode(F.split("words", " ")).alias("at", "word")).join(fixed.withColumn("fixed", F.lit(True)), ["site", "word"], "left")
        sentence = F.array_sort(F.collect_list(F.struct("at", F.when(F.col("fixed"), F.col("word")).otherwise("*").alias("word"))))
        made = parts.groupBy("page_id", "node_id", "site").agg(sentence.alias("s"), F.count("*").alias("n"), F.count("fixed").alias("k")).where("k < n and 2 * k >= n")
        made = made.select("page_id", "node_id", "site", F.regexp_replace(F.array_join(F.transform("s", lambda x: x["word"]), " "), r"\*( \*)+", "*").alias("s"))
    return made.select("page_id", "node_id", "site", F.xxhash64("s").alias("line"))


def _blanked(batches: Iterator[pa.RecordBatch], known: dict[int, set[str]]) -> Iterator[pa.RecordBatch]:
    """The lines with one blank for each run of words that are not known; those with nothing blank or less than half known are dropped."""
    for b in batches:
        keep, made = [], []
        for i, (site, line) in enumerate(zip(b["site"].to_pylist(), b["words"].to_pylist(), strict=True)):
            have, words, out, n = known.get(site, ()), line.split(" "), [], 0
            for w in words:
                if w in have:
                    out.append(w)
                    n += 1
                elif not out or out[-1] != "*":
                    out.append("*")
            if n < len(words) <= 2 * n:
                keep.append(i)
                made.append(" ".join(out))
        kept = b.select(["page_id", "node_id", "site"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(made, pa.string())], names=["page_id", "node_id", "site", "s"])


def _hits(nodes: DataFrame, min_pages: int, min_share: float, max_filled_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(least pages of each site; page_id, node_id, site, line of every node with a frequent line; site, line, pages of the frequent lines)."""
    least = materialise(thresholds(nodes, min_pages, min_share), "line-least")
    lines = materialise(site_lines(nodes, max_filled_words), "lines")
    single = materialise(_supported(lines, ["site", "line"], small(least)), "line-single")
    one = small(single)
    same = lines.join(one.select("site", "line"), ["site", "line"], "left_semi").select("page_id", "node_id", "site", "line")
    rare = lines.where("words is not null").join(one.select("site", "line"), ["site", "line"], "left_anti")
    filled = filled_lines(rare.where("not long"), small(least)).unionByName(filled_long_lines(rare.where("long"), small(least)))
    filled = materialise(filled, "line-filled")
    single_filled = materialise(_supported(filled, ["site", "line"], small(least)), "line-templates")
    filled = filled.join(small(single_filled).select("site", "line"), ["site", "line"], "left_semi")
    return least, same.unionByName(filled), single.unionByName(single_filled)


def repeated_lines(nodes: DataFrame, min_pages: int = 3, min_share: float = 0.2, max_filled_words: int = 12) -> DataFrame:
    """page_id, node_id of every line that stands in a frequent sequence of lines of its site.

    A sequence is frequent if it stands on at least min_pages pages and min_share of all pages of its site. Lines are the same if
    they differ only in case, white space, punctuation, bullets, digits or the name filled into a sentence; of sentences of more than
    max_filled_words words at least half has to be fixed. Nodes without host, without text or without a letter are no lines; repeated
    rows count once; an empty table has no lines.

    Method: the first level of distributed PrefixSpan over the line identifiers of each site (see frequent_sequences). A sequence never
    stands on more pages than one of its parts, so each line of a frequent sequence of any length is a frequent sequence of one line:
    what is to be deleted is complete with level one, and deeper levels are not run for it.
    """
    return _hits(nodes, min_pages, min_share, max_filled_words)[1].select("page_id", "node_id").distinct()


def frequent_sequences(nodes: DataFrame, min_pages: int = 3, min_share: float = 0.2, max_filled_words: int = 12) -> DataFrame:
    """site, lines, pages: the frequent sequences of lines of each site, of any length; those that only leave lines out of a longer one on the same pages may be absent.

    The lines of a sequence stand on a page in its order, other lines may stand between them. Method: PrefixSpan, see prefix_span.
    """
    least, hits, _ = _hits(nodes, min_pages, min_share, max_filled_words)
    placed = F.array_sort(F.collect_set(F.struct("node_id", "line")))
    pages = hits.groupBy("site", "page_id").agg(F.transform(placed, lambda x: x["line"]).alias("rest"))
    # Pages with the same lines are one row with their number: the pages of a site mostly share their frame.
    sequences = pages.groupBy("site", "rest").agg(F.count("*").alias("n"))
    return prefix_span(sequences, least)


def prefix_span(sequences: DataFrame, least: DataFrame) -> DataFrame:
    """site, lines, pages. sequences: site, rest (lines in order), n (on how many pages); least: site, least (pages a sequence needs).

    The projection of a prefix is what is left of each sequence after its first occurrence; equal rests are added up. A level first
    takes what all rests of a prefix begin with (the common beginning of the smallest and the greatest) into the prefix at once: a
    prefix continued in another way stands on the same pages with these lines between, so no closed sequence is lost. Then each
    later line, at its first place in the rest, grows the prefix; the grown prefixes on enough pages are the next level, until none is
    left. A grown prefix is dropped, with all that begins with it, if on all its pages one and the same line stands between its last two
    lines (or before its first): with that line in it, it and all that begins with it stand on the same pages. A prefix is given if no line
    grows it without losing a page. So every closed sequence is given (one that no longer one on the same pages contains). Supports are added up on the map side, and no step holds
    the sequences of a site in one task. Each level is written to the shared folder.
    """
    spark = sequences.sparkSession
    front = materialise(sequences.join(least, "site").select("site", F.expr("cast(array() as array<bigint>)").alias("lines"), "rest", "n", "least"), "span-front")
    found = spark.createDataFrame([], "site bigint, lines array<bigint>, pages bigint")
    while not front.isEmpty():
        prefix = front.groupBy("site", "lines").agg(F.min("rest").alias("low"), F.max("rest").alias("high"), F.sum("n").alias("pages"), F.max("least").alias("least"))
        shared = F.filter(F.sequence(F.lit(1), F.least(F.size("low"), F.size("high"))), lambda i: F.slice("low", 1, i) == F.slice("high", 1, i))
        taken = F.when((F.size("low") > 0) & (F.size("high") > 0), F.size(shared)).otherwise(0)
        # The empty prefix takes nothing in: it is no sequence itself.
        prefix = prefix.withColumn("taken", F.when(F.size("lines") > 0, taken).otherwise(0))
        prefix = materialise(prefix.select("site", "lines", "pages", "least", "taken", F.concat("lines", F.slice("low", F.lit(1), F.col("taken"))).alias("grown")), "span-prefix")
        rests = front.select("site", "lines", "rest", "n").join(small(prefix), ["site", "lines"])
        rests = rests.select("site", F.col("grown").alias("lines"), F.slice("rest", F.col("taken") + 1, F.greatest(F.size("rest") - F.col("taken"), F.lit(0))).alias("rest"), "n", "least")
        grown = rests.select("site", "lines", "least", "rest", "n", F.explode(F.array_distinct("rest")).alias("line"))
        after = F.array_position("rest", F.col("line")).cast("int")
        grown = grown.select("site", "least", "n", F.col("lines").alias("prefix"), "line", F.slice("rest", after + 1, F.size("rest") - after).alias("rest"), F.slice("rest", F.lit(1), after - 1).alias("between"))
        support = grown.groupBy("site", "prefix", "line").agg(F.sum("n").alias("pages"), F.max("least").alias("least")).where("pages >= least")
        support = materialise(support.select("site", "prefix", "line", "pages"), "span-support")
        grown = grown.join(small(support), ["site", "prefix", "line"])
        always = grown.select("site", "prefix", "line", "pages", "n", F.explode(F.array_distinct("between")).alias("other")).groupBy("site", "prefix", "line", "other").agg(F.sum("n").alias("k"), F.max("pages").alias("pages"))
        always = materialise(always.where("k = pages").select("site", "prefix", "line").distinct(), "span-always")
        closed = prefix.where("size(grown) > 0").select("site", F.col("grown").alias("prefix"), F.col("pages").alias("own"))
        longer = support.groupBy("site", "prefix").agg(F.max("pages").alias("most"))
        closed = closed.join(longer, ["site", "prefix"], "left").where("most is null or most < own")
        found = found.unionByName(closed.select("site", F.col("prefix").alias("lines"), F.col("own").alias("pages")))
        front = grown.join(small(always), ["site", "prefix", "line"], "left_anti")
        front = front.groupBy("site", F.concat("prefix", F.array("line")).alias("lines"), "rest").agg(F.sum("n").alias("n"), F.max("least").alias("least"))
        front = materialise(front.select("site", "lines", "rest", "n", "least"), "span-front")
    return found


def line_support(nodes: DataFrame, min_pages: int = 3, min_share: float = 0.2) -> DataFrame:
    """host_name, line, pages: the lines, by their words in lower case, on enough pages of their site; without names filled in. The same lines that level one of repeated_lines counts."""
    rows = nodes.where("text is not null and host_name is not null").select("host_name", "page_id", line_text(F.col("text")).alias("line")).where("line <> ''")
    pages = nodes.where("host_name is not null").select("host_name", "page_id").distinct().groupBy("host_name").agg(F.count("*").alias("all_pages"))
    support = rows.distinct().groupBy("host_name", "line").agg(F.count("*").alias("pages"))
    return support.join(pages, "host_name").where(F.col("pages") >= F.greatest(F.lit(float(min_pages)), F.col("all_pages") * min_share - 1e-9)).select("host_name", "line", "pages")


def remove_lines(nodes: DataFrame, occurrences: DataFrame) -> DataFrame:
    """The nodes without the repeated lines."""
    return nodes.join(occurrences, ["page_id", "node_id"], "left_anti")

"""Texts cut by a field limit or during transfer."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from websift.llm.lines import line_text, small
from websift.session import materialise

#: What a cut leaves at the end of a text: the start of an entity or tag, a broken character.
BROKEN = r"(&[a-zA-Z#0-9]{0,8}|</?[a-zA-Z]{0,8}|\x{FFFD}+)$"
#: A mark that some writers put after a cut, and others after a whole sentence.
MARK = r"\s*(\[\s*(\.\.\.|…)\s*\]|\(\s*(\.\.\.|…)\s*\)|…|\.\.\.+)\s*$"
#: Ends of whole texts: sentence ends, closing signs, numbers, addresses, tags, signatures.
WHOLE = r"([.!?:;…。！？।؟۔»”)\]}'’\"*/=_~%>]|\p{N}|[\p{So}\p{Sk}\p{Sc}]|\p{Lo})$|(https?://|www\.)\S+$|(^|\s)[#@]\S+$|(^|\s)[-–—]\s*\p{Lu}\S+$|(^|\s)\S+\.(com|org|net|example|test|invalid|[a-z]{2})$"
#: Ends that are whole even at a length where texts of the source are cut: a sentence end or a closing sign.
CLOSED = r"[.!?…。！？।؟۔][\"'»”’」』)\]}]*$|[^\s(\[{«“„][)\]}»”」』\"]$"
#: White space of Unicode, and marks that no one sees.
SPACES = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\u200b\ufeff"
#: What marks and broken characters are made of, in runs of any length; before them an entity or tag of at most TORN_CHARS.
MARK_SIGNS = SPACES + ".…[]()\ufffd"
TORN_CHARS = 12


def _rtrim(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def _tail(text: Column) -> Column:
    """The end of a text that BROKEN or MARK can match: the whole run of signs it ends in and TORN_CHARS before it."""
    return F.right(text, F.char_length(text) - F.char_length(F.rtrim(text, F.lit(MARK_SIGNS))) + F.lit(TORN_CHARS))


def _endings(documents: DataFrame) -> DataFrame:
    """doc_id, source, lengths and what the end of each text looks like. Texts that are null, empty or blank are left out.

    Marks stand at the end of a text, so only its last run of their signs goes through the patterns for them, however long it is; the other
    patterns see the last line or its last words. The lengths are those of whole texts.
    """
    d = documents.where("text is not null and doc_id is not null").select("doc_id", "source", "text", _rtrim(F.col("text")).alias("t")).where("t <> ''")
    d = d.withColumn("end", _tail(F.col("t")))
    d = d.withColumn("broken", F.col("end").rlike(BROKEN)).withColumn("marked", F.col("end").rlike(MARK))
    stripped = F.when(F.col("broken") | F.col("marked"), F.regexp_replace(F.regexp_replace("end", BROKEN, ""), MARK, "")).otherwise(F.col("end"))
    d = d.withColumn("bare", _rtrim(F.concat(F.left("t", F.char_length("t") - F.char_length("end")), stripped)))
    d = d.withColumn("last_line", F.trim(F.substring_index("bare", "\n", -1)))
    earlier = F.filter(F.transform(F.split("bare", "\n"), lambda x: F.rtrim(x, F.lit(SPACES + "»"))), lambda x: x != "")
    d = d.withColumn("lines", F.transform(F.slice(earlier, 1, F.greatest(F.size(earlier) - 1, F.lit(0))), lambda x: F.right(x, F.lit(1))))
    closed = F.size(F.filter("lines", lambda x: x.isin(*".!?:…])。！？।؟۔")))
    d = d.withColumn("loose_share", F.when(F.size("lines") >= 6, 1 - closed / F.size("lines")).otherwise(0.0))
    d = d.withColumn("words", F.filter(F.split(F.lower("last_line"), r"[^\p{L}\p{M}\p{N}]+"), lambda x: x != ""))
    d = d.withColumn("sentence", F.trim(F.element_at(F.split("last_line", r"[.!?…]+[\"'»”)]*\s|[。！？]+[」』）]*"), -1)))
    d = d.withColumn("comma", F.right("bare", F.lit(1)).isin(*",(“„«["))
    d = d.withColumn("whole", F.substring_index(F.rtrim("last_line", F.lit(SPACES + "»")), " ", -2).rlike(WHOLE) & ~F.col("comma"))
    held = lambda signs: F.char_length("last_line") - F.char_length(F.translate("last_line", signs, ""))
    unclosed = F.lit(False)
    for a, b in ("()", "[]", "{}", "（）", "「」", "“”"):
        unclosed |= held(a) > held(b)
    d = d.withColumn("closed", F.rtrim("last_line", F.lit(SPACES)).rlike(CLOSED) & ~unclosed & ~F.col("comma"))
    said = F.filter(F.split(F.lower("sentence"), r"[^\p{L}\p{M}\p{N}]+"), lambda x: x != "")
    d = d.withColumn("stuffed", (F.size(said) >= 6) & (F.size(F.array_distinct(said)) <= 0.6 * F.size(said)))
    one_word = F.size(F.split(F.col("sentence"), r"[^\p{L}\p{M}\p{N}]+[\p{L}\p{M}\p{N}]")) <= 1
    return d.select(
        "doc_id", "source", F.char_length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.char_length("bare").alias("bare_chars"), F.octet_length("bare").alias("bare_bytes"),
        "broken", "marked", "whole", "closed", "comma", "stuffed", "loose_share", "last_line", "sentence", F.size("words").alias("n_words"),
        F.when(F.size("words") >= 1, F.element_at("words", -1)).alias("last"), F.when(one_word, ".").when(F.size("words") >= 2, F.element_at("words", -2)).alias("prev"),
    )


def hazards(lengths: DataFrame, neighbours: int = 25, rate: float = 0.01, least: int = 4) -> DataFrame:
    """source, unit, length of the lengths at which texts of a source end far more often than at the lengths around.

    lengths: source, unit, length, a row a text. The discrete hazard of a length is the share of the texts at least that
    long that end there. It is tested against the hazard of the lengths within neighbours on both sides (a Poisson tail, in its
    Chernoff bound, so p-values err on the safe side); Benjamini and Hochberg's rule keeps the share of false discoveries of each
    source and unit under rate. Windows run over counted lengths, not texts, within a source.
    """
    n = lengths.groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    group = Window.partitionBy("source", "unit")
    at_risk = F.sum("n").over(group.orderBy(F.desc("length")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    near = group.orderBy("length").rangeBetween(-neighbours, neighbours)
    n = n.withColumn("at_risk", at_risk)
    n = n.withColumn("hazard", F.col("n") / F.col("at_risk"))
    around = F.sum("hazard").over(near) - F.col("hazard")
    # A length without a text has hazard 0; half a text is added so that an empty neighbourhood has a hazard.
    n = n.withColumn("expected", around / (2 * neighbours) * F.col("at_risk") + 0.5 / (2 * neighbours))
    excess = F.col("n") > F.col("expected")
    log_p = F.when(excess, F.col("n") - F.col("expected") - F.col("n") * F.log(F.col("n") / F.col("expected"))).otherwise(0.0)
    n = n.withColumn("p", F.exp(log_p))
    rank, tests = F.row_number().over(group.orderBy("p", "length")), F.count("*").over(group)
    n = n.withColumn("ok", F.when(F.col("p") <= rate * rank / tests, rank)).withColumn("upto", F.max("ok").over(group)).withColumn("rank", rank)
    return n.where((F.col("rank") <= F.col("upto")) & (F.col("n") >= least)).select("source", "unit", "length", "n", "p")


#: Texts are cut into words in portions of about so many characters.
PORTION = 8_000_000


def _portions(texts: pa.Array) -> Iterator[pa.Array]:
    at = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False)) // PORTION
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)]
    return (texts.slice(a, b - a) for a, b in itertools.pairwise(cuts) if b > a)


def _count_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """prev, word, n, n_end of the texts of each portion."""
    for texts in (t for b in batches if b.num_rows for t in _portions(b.column(0))):
        plain = pc.replace_substring(pc.replace_substring_regex(pc.utf8_lower(texts), "[!?:…]", "."), "\n", ". ")
        lists = pc.split_pattern_regex(plain, r"[^\p{L}\p{M}\p{N}.]+")
        parts, text = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
        dots = pc.ends_with(parts, ".").to_numpy(zero_copy_only=False)
        encoded = pc.utf8_rtrim(parts, ".").dictionary_encode()
        names = encoded.dictionary
        blank = pc.equal(pc.utf8_length(names), 0).to_numpy(zero_copy_only=False)
        code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.flatnonzero(~blank[code])
        if not len(at):
            continue
        # How many ends stand up to each part; between two words of a text there is one if the number rises.
        ends = np.cumsum(dots)
        begin = np.ones(len(at), bool)
        begin[1:] = text[at[1:]] != text[at[:-1]]
        last = np.append(begin[1:], True)
        upto = np.append(ends[at[1:] - 1], ends[-1])
        upto[last] = ends[np.searchsorted(text, text[at[last]], "right") - 1]
        closed = upto - ends[at] + dots[at] > 0
        prev = np.zeros(len(at), np.int64)
        prev[1:] = np.where(begin[1:] | closed[:-1], 0, code[at[:-1]] + 1)
        # The end of a text before its first word closes no word; a last word without an end is open and does not count.
        keep = ~last | closed
        key, inverse, n = np.unique(prev[keep] * len(names) + code[at[keep]], return_inverse=True, return_counts=True)
        n_end = np.bincount(inverse, closed[keep], len(key)).astype(np.int64)
        before = key // len(names)
        words = names.take(pa.array(np.maximum(before - 1, 0)))
        made = [pc.if_else(pa.array(before == 0), ".", words), names.take(pa.array(key % len(names))), pa.array(n.astype(np.int64)), pa.array(n_end)]
        yield pa.RecordBatch.from_arrays(made, ["prev", "word", "n", "n_end"])


def word_pairs(documents: DataFrame) -> DataFrame:
    """prev, word, n, n_end over all texts: how often word follows prev, and how often a sentence or line ends there. prev '.' is the start of a sentence.

    Words are in lower case, parted by all but letters, marks, digits and inner dots; a sentence ends at '.', '!', '?', ':' and '…'. The open
    end of a text itself does not count. Arrow batches are cut and counted as arrays (the JVM's patterns take several times as long),
    so the counts of a batch, not its words, are shuffled.
    """
    trimmed = _rtrim(F.col("text"))
    end = _tail(trimmed)
    text = F.concat(F.left(trimmed, F.char_length(trimmed) - F.char_length(end)), F.regexp_replace(end, MARK, ""))
    counted = documents.where("text is not null").select(text.alias("text")).mapInArrow(_count_pairs, "prev string, word string, n long, n_end long")
    return counted.groupBy("prev", "word").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end"))


def continuations(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """prev, last, n, n_end, n_longer, n_any, n_any_end for each pair asked for; pairs: the rows of word_pairs.

    n, n_end: as there, n_longer: how often a longer word that begins with last follows prev; n_any and n_any_end: the same as n
    and n_end after any word. Each pair is looked up by its word's beginnings of the lengths that are asked for: an equi join.
    """
    keys = materialise(asked.select("prev", "last").distinct(), "cut-asked")
    sizes = [r[0] for r in keys.select(F.char_length("last")).distinct().collect()]  # a row a length of a word
    keys = small(keys)
    beginnings = F.filter(F.array(*[F.lit(k) for k in sorted(sizes)]).cast("array<int>"), lambda k: k <= F.char_length("word"))
    hit = pairs.select("prev", "word", "n", "n_end", F.explode(F.transform(beginnings, lambda k: F.left("word", k))).alias("last")).join(keys, ["prev", "last"], "left_semi")
    same = F.col("word") == F.col("last")
    after = hit.groupBy("prev", "last").agg(F.sum(F.when(same, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(same, F.col("n_end")).otherwise(0)).alias("n_end"), F.sum(F.when(same, 0).otherwise(F.col("n"))).alias("n_longer"))
    lasts = keys.select("last").distinct()
    anywhere = pairs.withColumnRenamed("word", "last").join(lasts, "last", "left_semi").groupBy("last").agg(F.sum("n").alias("n_any"), F.sum("n_end").alias("n_any_end"))
    return keys.select("prev", "last").join(after, ["prev", "last"], "left").join(anywhere, "last", "left")


#: Hazards of sentence ends are told apart in so many steps.
STEPS = 2000


def _step(ends: Column, times: Column) -> Column:
    """The hazard of an end after so many times, with one end and one other case added, in STEPS steps."""
    return F.floor((ends + 1) / (times + 2) * STEPS).cast("int")


def usual_ends(pairs: DataFrame) -> DataFrame:
    """kind, step, p: of all sentence and line ends in the texts, the share that stands where the hazard of an end is at most that step.

    kind 'pair': the hazard after two words, 'word': after one. Each end is looked at without itself. At most 2 * STEPS rows.
    """
    words = pairs.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end"))
    both = pairs.where("n_end > 0").select(F.lit("pair").alias("kind"), "n", "n_end").unionByName(words.where("n_end > 0").select(F.lit("word").alias("kind"), "n", "n_end"))
    steps = both.groupBy("kind", _step(F.col("n_end") - 1, F.col("n") - 1).alias("step")).agg(F.sum("n_end").alias("k"))
    kind = Window.partitionBy("kind")
    return steps.select("kind", "step", (F.sum("k").over(kind.orderBy("step")) / F.sum("k").over(kind)).alias("p"))


def _open_limit(tested: DataFrame, rate: float) -> float:
    """The highest p, by Benjamini and Hochberg's rule, at which an end is no usual one. tested: p; equal ones are added up, so the rule runs over a few rows."""
    by = tested.groupBy("p").agg(F.count("*").alias("k"))
    every = Window.partitionBy(F.lit(0))
    ranked = by.select("p", F.sum("k").over(every.orderBy("p")).alias("rank"), F.sum("k").over(every).alias("m"))
    found = ranked.where(F.col("p") <= F.lit(rate) * F.col("rank") / F.col("m")).agg(F.max("p")).first()[0]
    return -1.0 if found is None else found


def truncated(documents: DataFrame, rate: float = 0.1, same_line: int = 3, min_pairs: int = 3, min_words: int = 20) -> DataFrame:
    """doc_id, source, reason of every text cut inside a word or a sentence.

    Method: discrete hazards, tested with control of the false-discovery rate, on two scales.
    'length': the length of the text is one at which texts of its source end far more often than at the lengths around (hazards), and
    its end is incomplete. A cut during transfer has no typical length; for it the hazard of a sentence end after its last two words is
    tested (after its last word where these stand less than min_pairs times in all texts, and not at all only inside a line): how often a sentence ends there, of the
    times the texts got so far, also where the last word is the beginning of another. An end is rare if few of all sentence ends in the
    texts stand at so low a hazard (usual_ends); Benjamini and Hochberg's rule over all open ends keeps the share of false ones under rate.
    reason 'word' if the last word mostly goes on, else 'sentence' (also after a comma or an opening sign). 'broken': only a torn entity,
    tag or character shows the cut.

    Texts that end whole (sentence end, closing sign, number, address, tag, signature) or in a line in lower case of its own are not cut;
    at a length where too many texts of the source end, only a sentence end or closing sign with no bracket left open is whole. Not cut are,
    by their length alone, those that end in a line that same_line texts of the source end in; nor are texts of seven lines or more of which more than three quarters end open, nor a last
    sentence that mostly repeats its words. Null, empty and blank texts, and null ids, give
    no row; a null source is a source of its own; repeated rows give one row.
    """
    ends = materialise(_endings(documents), "cut-endings")
    units = [("chars", "chars"), ("bytes", "bytes"), ("bare_chars", "bare_chars"), ("bare_bytes", "bare_bytes")]
    lengths = ends.select("source", F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(c).cast("long").alias("length")) for u, c in units])).alias("x")).select("source", "x.*")
    limits = hazards(lengths)
    limits = small(materialise(limits.groupBy("source").agg(F.collect_set(F.concat_ws(":", "unit", "length")).alias("limits")), "cut-limits"))
    key = F.xxhash64(line_text(F.col("last_line")))
    held = ends.join(limits.withColumnRenamed("source", "s3"), F.col("source").eqNullSafe(F.col("s3")), "left").drop("s3")
    at_limit = F.coalesce(F.arrays_overlap("limits", F.array(*[F.concat_ws(":", F.lit(u), F.col(c)) for u, c in units])), F.lit(False))
    open_ends = held.withColumn("at_limit", at_limit).where(F.col("broken") | ~F.col("whole") | (F.col("at_limit") & ~F.col("closed")))
    common = small(materialise(ends.groupBy("source", key.alias("line")).agg(F.count_distinct("doc_id").alias("k")).where(F.col("k") >= same_line).select("source", "line", F.lit(True).alias("usual")), "cut-usual"))
    pairs = materialise(word_pairs(documents), "cut-pairs")
    seen = continuations(pairs, open_ends.where("prev is not null and last is not null"))
    x = open_ends.withColumn("line", key)
    x = x.join(common.withColumnRenamed("source", "s2").withColumnRenamed("line", "l2"), (F.col("line") == F.col("l2")) & F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2", "l2")
    x = x.join(small(materialise(seen, "cut-seen")), ["prev", "last"], "left")
    n, n_end, longer, n_any, any_end = (F.coalesce(F.col(c), F.lit(0)) for c in ("n", "n_end", "n_longer", "n_any", "n_any_end"))
    own_line = F.col("sentence") == F.col("last_line")
    aside = own_line & F.col("last_line").rlike(r"^[•\s–-]*\p{Ll}") & ~F.col("comma")
    tagged = F.col("last_line").rlike(r"^[^\s,.!?:;|]+(,\s+[^\s,.!?:;|]+){2,}$")
    name = own_line & F.col("last_line").rlike(r"^\P{L}*\p{Lu}\p{Ll}+(\s+\p{Lu}\p{Ll}+){0,2}\P{L}*$") & (n == 0) & (longer == 0)
    x = x.withColumn("excluded", (F.col("loose_share") > 0.75) | F.col("stuffed") | aside | tagged | name)
    paired = n + longer >= min_pairs
    kind = F.when(paired, "pair").when((n_any >= min_words) & ((n >= 1) | ~own_line), "word")
    x = x.withColumn("kind", kind).withColumn("step", F.when(paired, _step(n_end, n + longer)).otherwise(_step(any_end, n_any)))
    # A hazard at which no sentence ever ends lies under the first step of its kind: the p of the next lower step, or 0.
    p = usual_ends(pairs).groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("step", "p"))).alias("known"))
    x = x.join(F.broadcast(p), "kind", "left")  # two rows
    below = F.filter("known", lambda e: e["step"] <= F.col("step"))
    x = materialise(x.withColumn("p", F.when(F.col("kind").isNotNull(), F.coalesce(F.try_element_at(below, F.lit(-1))["p"], F.lit(0.0)))).drop("known"), "cut-tested")
    limit = _open_limit(x.where("p is not null and not excluded"), rate)
    usual = F.coalesce("usual", F.lit(False))
    at_limit, excluded = F.col("at_limit"), F.col("excluded")
    in_text = ~own_line | (F.col("n_words") >= 4)
    rare = F.coalesce(F.col("p") <= limit, F.lit(False))
    reason = (
        F.when(~excluded & ~usual & at_limit & (~F.col("marked") | ((n == 0) & (longer == 0) & in_text)), "length")
        .when(F.col("broken") & at_limit, "length")
        .when(~excluded & rare & (longer > n), "word")
        .when(~excluded & (rare | F.col("comma")), "sentence")
        .when(F.col("broken"), "broken")
    )
    return x.withColumn("reason", reason).where("reason is not null").groupBy("doc_id", "source").agg(F.min("reason").alias("reason"))


def cut_shares(documents: DataFrame, cut: DataFrame) -> DataFrame:
    """source, n_documents, n_cut, share of every source; texts that are null or blank count as documents that are not cut."""
    all_docs = documents.groupBy("source").agg(F.count_distinct("doc_id").alias("n_documents"))
    cuts = cut.groupBy(F.col("source").alias("s")).agg(F.count_distinct("doc_id").alias("n_cut"))
    joined = all_docs.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left")
    n = F.coalesce("n_cut", F.lit(0).cast("long"))
    return joined.select("source", "n_documents", n.alias("n_cut"), (n / F.greatest("n_documents", F.lit(1))).alias("share"))

"""The main body of each page: a linear-chain CRF over the text blocks of the tree, decoded by Viterbi."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from websift.llm import crf
from websift.llm.pagestream import CONTAINERS, INLINE, Pages, _merge_flags, stream_pages

COLUMNS = ["parent_id", "node_depth", "tag", "text"]
#: Tags that get a code of their own; others share one.
TAGS = ["#text", "a", "abbr", "b", "blockquote", "body", "button", "code", "dd", "div", "dl", "dt", "em", "figcaption", "h1", "h2", "h3", "h4", "i", "label", "li", "ol", "p", "pre", "section", "small", "span", "strong", "table", "td", "th", "tr", "ul"]
SECTIONS = ["nav", "header", "footer", "aside", "main", "article", "noscript", "table"]
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

#: How many values each feature has; a feature's codes start where those of the one before end.
SIZES = {
    "tag": 40, "parent": 40, "grandparent": 40, "sections": 256, "link_list": 4, "chars": 12, "words": 12, "end": 12,
    "flag_tag": 80, "flag_around": 8, "h1": 4, "heading": 8, "commas": 64, "depth": 12, "box_links": 24, "box_flags": 24,
    "box_h1": 4, "place": 12, "flag_since": 24, "tag_words": 480, "box_mean": 24, "siblings": 160, "list_links": 24, "bias": 1,
}
OFFSETS = dict(zip(SIZES, np.concatenate(([0], np.cumsum(list(SIZES.values()))[:-1])).tolist(), strict=True))
N_CODES = sum(SIZES.values())


class Model(NamedTuple):
    weights: np.ndarray
    trans: np.ndarray


def is_keyword_line(texts: pa.Array) -> np.ndarray:
    """Lines that only list single words: 'a, b, c' or '#a #b'."""
    t = pc.utf8_trim_whitespace(texts)
    return np.asarray(pc.match_substring_regex(t, r"^[^\s,.!?:;|]+(,\s+[^\s,.!?:;|]+){2,}$").fill_null(False)) | np.asarray(pc.match_substring_regex(t, r"^#\S+(\s+#\S+)+$").fill_null(False))


def _bucket(x: np.ndarray, most: int) -> np.ndarray:
    """0 for 0, then one bucket for each power of about 1.6."""
    return np.minimum(np.ceil(np.log(np.maximum(x, 0) + 1) / 0.48).astype(np.int64), most)


def _last(values: np.ndarray, is_new: np.ndarray, first: np.ndarray, default: int) -> np.ndarray:
    """At each place the value at the latest place up to it where is_new, within the sequence that began at first."""
    at = np.maximum.accumulate(np.where(is_new, np.arange(len(values)), -1))
    return np.where(at >= first, values[np.maximum(at, 0)], default)


def blocks(p: Pages) -> np.ndarray:
    """The places of the nodes whose text is not blank."""
    return np.flatnonzero(np.asarray(pc.match_substring_regex(p.text, r"[^\s\x{A0}\x{200B}\x{FEFF}]")))


def features(p: Pages, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of each text block, number of blocks of each page)."""
    n = len(at)
    lengths = np.bincount(p.page[at], minlength=len(p.start))
    if not n:
        return np.zeros((0, len(SIZES)), np.int64), lengths
    known = {t: i for i, t in enumerate(TAGS)}
    tag = np.array([known.get(t, len(TAGS)) for t in p.tag_names])[p.tag]
    up = p.up(tag, 39)
    sections = np.zeros(len(tag), np.int64)
    for i, s in enumerate(SECTIONS):
        sections |= p.tag_is(s).astype(np.int64) << i
    bits = (p.tag_is("a").astype(np.int64) << 8) | (p.tag_is("li", "ul", "ol", "dl").astype(np.int64) << 9) | sections
    bits = p.inherit(bits, np.bitwise_or)
    own = np.arange(len(tag))
    box_of = p.inherit(np.where(p.tag_is(*CONTAINERS), own, -1), lambda above, mine: np.where(mine >= 0, mine, above))
    # A container that is a block itself belongs to the box around it.
    box = np.where(p.tag_is(*CONTAINERS)[at] & (p.parent[at] >= 0), box_of[np.maximum(p.parent[at], 0)], box_of[at])
    box = np.maximum(box, 0)

    text = pc.utf8_trim_whitespace(p.text.take(pa.array(at)))
    chars = pc.utf8_length(text).to_numpy().astype(np.int64)
    words = pc.count_substring_regex(text, r"\S+").to_numpy().astype(np.int64)
    commas = pc.count_substring(text, ",").to_numpy().astype(np.int64)
    full = np.asarray(pc.match_substring_regex(text, r"[.!?…][\"'»”)\]]*$"))
    colon = np.asarray(pc.match_substring_regex(text, r"[:;,\-–]$"))
    upper = np.asarray(pc.match_substring_regex(text, r"^[^\p{L}]*\p{Lu}"))
    digit = np.asarray(pc.match_substring_regex(text, r"^\p{N}|\p{N}\)?$"))
    flag = p.flag[at].astype(np.int64)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))[p.page[at]]
    last = first + lengths[p.page[at]] - 1
    place = np.arange(n)
    before = np.where(place > first, flag[np.maximum(place - 1, 0)], 0)
    after = np.where(place < last, flag[np.minimum(place + 1, n - 1)], 0)
    t = tag[at]
    is_h1 = t == known["h1"]
    is_head = p.tag_is(*HEADINGS)[at]
    seen_h1 = _last(np.ones(n, np.int64), is_h1, first, 0)
    head_flag = _last(flag + 1, is_head, first, 0)
    flag_at = np.maximum.accumulate(np.where(flag == 1, place, -1))
    since = np.where(flag_at >= first, place - flag_at, 30)
    linked = (bits[at] >> 8) & 1

    size = len(tag)
    sums_by = lambda key, x, m: np.bincount(key, x, m)
    sums = lambda x: sums_by(box, x, size)
    box_n, box_chars = sums(np.ones(n)), sums(chars.astype(float))
    share = lambda x, total: np.minimum((x / np.maximum(total, 1) * 5 + 0.5).astype(np.int64), 5)
    links_in_box = share(sums(chars * linked.astype(float)), box_chars)[box]
    flags_in_box = share(sums(flag.astype(float)), box_n)[box]
    mean_in_box = _bucket((box_chars / np.maximum(box_n, 1)), 11)[box]
    h1_in_box = (sums(is_h1.astype(float)) > 0)[box]
    n_bucket = np.minimum(box_n[box].astype(np.int64), 3)

    parent = np.maximum(p.parent[at], 0)
    same_parent = np.minimum(sums_by(parent, np.ones(n), size)[parent].astype(np.int64), 4) - 1
    outer = np.maximum(p.up(p.parent, 0)[at], 0)
    outer = np.where(linked == 1, outer, parent)
    list_links = share(sums_by(outer, chars * linked.astype(float), size), sums_by(outer, chars.astype(float), size))[outer]

    value = {
        "tag": t, "parent": up[at], "grandparent": p.up(up, 39)[at], "sections": bits[at] & 255, "link_list": (bits[at] >> 8) & 3,
        "chars": _bucket(chars, 11), "words": _bucket(words, 11), "end": full * 1 + colon * 2 + upper * 4 + 0 * digit,
        "flag_tag": flag * 40 + t, "flag_around": before * 1 + after * 2 + flag * 4, "h1": seen_h1 * 2 + is_h1, "heading": head_flag + 3 * is_head,
        "commas": _bucket(commas, 5) * 12 + _bucket(words, 9), "depth": np.minimum(p.depth[at], 11), "box_links": links_in_box * 4 + n_bucket, "box_flags": flags_in_box * 4 + n_bucket,
        "box_h1": h1_in_box * 2 + (linked == 1), "place": np.minimum(10 * (place - first) // np.maximum(last - first + 1, 1), 9), "flag_since": np.minimum(since, 9) + 10 * (linked == 1), "tag_words": t * 12 + _bucket(words, 11),
        "box_mean": mean_in_box + 12 * (linked == 1), "siblings": same_parent * 40 + t, "list_links": list_links * 4 + same_parent, "bias": np.zeros(n, np.int64),
    }
    codes = np.stack([np.clip(value[k], 0, SIZES[k] - 1) + OFFSETS[k] for k in SIZES], axis=1)
    return codes.astype(np.int64), lengths


def line_of(p: Pages, at: np.ndarray) -> np.ndarray:
    """The line of each text block: the parent that has bare text for its inline pieces, else the block itself."""
    bare = np.zeros(len(p.page), bool)
    texts = at[p.tag_is("#text")[at]]
    bare[p.parent[texts][p.parent[texts] >= 0]] = True
    parent = np.maximum(p.parent[at], 0)
    inside = p.tag_is("#text", *INLINE)[at] & bare[parent] & (p.parent[at] >= 0)
    return np.where(inside, parent, at)


def decode(p: Pages, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(places of the text blocks, whether each belongs to the main body). Flagged lines never do."""
    at = blocks(p)
    codes, lengths = features(p, at)
    emit = np.zeros((len(at), 2))
    if len(at):
        emit[:, 1] = model.weights[codes].sum(axis=1)
    main = crf.viterbi(emit, model.trans, crf.Chains(lengths)) == 1
    if len(at):
        # The inline pieces of one line have one label: that of most of its characters.
        line = line_of(p, at)
        chars = pc.utf8_length(p.text.take(pa.array(at))).to_numpy().astype(float)
        votes = np.bincount(line, chars * np.where(main, 1, -1), len(p.page))
        main = votes[line] > 0
        main &= ~p.flag[at]
    return at, main


_BLANK = re.compile(r"\s+")


def weak_labels(p: Pages, at: np.ndarray, documents: dict[int, str]) -> tuple[np.ndarray, np.ndarray]:
    """(label of each block, whether its page may be trained on).

    A block is main if its line stands in the page's exported text and is not flagged. The inline pieces of one parent make
    one line. Pages whose export begins or ends in a line that no block has (a cut text) are left out.
    """
    texts = [_BLANK.sub(" ", x).strip() for x in p.text.take(pa.array(at)).to_pylist()]
    group: dict[int, list[int]] = {}
    for i, k in enumerate(line_of(p, at).tolist()):
        group.setdefault(k, []).append(i)
    line = [""] * len(at)
    for members in group.values():
        whole = _BLANK.sub("", "".join(texts[i] for i in members))
        for i in members:
            line[i] = whole
    label, usable = np.zeros(len(at), np.int8), np.zeros(len(p.start), bool)
    pages = p.page[at]
    for k in range(len(p.start)):
        document = documents.get(int(p.page_id[p.start[k]]))
        if not document:
            continue
        lines = [_BLANK.sub("", x) for x in document.split("\n") if x.strip()]
        have = set(lines)
        a, b = np.searchsorted(pages, [k, k + 1])
        hit = [i for i in range(a, b) if line[i] in have]
        found = {line[i] for i in hit}
        usable[k] = bool(lines) and lines[0] in found and lines[-1] in found
        for i in hit:
            label[i] = not p.flag[at[i]]
    return label, usable


def sample_texts(documents: DataFrame, n_pages: int) -> dict[int, str]:
    """doc_id: text of at most n_pages documents with a text, those with the lowest hash of their id.

    A cut of the hash range, by the number of documents, leaves about twice as many ids as are needed before any are sorted; only ids are, and
    the texts are then read by id. So neither a task nor the driver gets more, however many documents there are.
    """
    ok = documents.where("text is not null and doc_id is not null").select(F.col("doc_id").alias("page_id"), "text")
    cut = min(2 * n_pages / max(ok.count(), 1), 1.0)
    hashed = F.xxhash64("page_id")
    ids = ok.where(hashed <= F.lit(int(-(2**63) + cut * (2**64 - 2**11)))).select("page_id").distinct().orderBy(hashed, "page_id").limit(n_pages)
    chosen = sorted(r[0] for r in ids.collect())  # at most n_pages rows
    return {r.page_id: r.text for r in ok.where(F.col("page_id").isin(chosen)).dropDuplicates(["page_id"]).collect()} if chosen else {}  # at most n_pages rows


def fit(nodes: DataFrame, documents: DataFrame, flags: DataFrame, n_pages: int = 1000, steps: int = 100) -> Model:
    """Trains on at most n_pages labelled pages: those with the lowest hash of their id that have an exported text.

    The labels are weak ones, from documents (doc_id, text). No usable page gives a model that takes nothing for main body.
    """
    texts = sample_texts(documents, n_pages)
    if not texts:
        return Model(np.zeros(N_CODES), np.zeros((2, 2)))
    ids = sorted(texts)
    pick = lambda df: df.where(F.col("page_id").isin(ids))
    rows = pick(nodes).select("page_id", "node_id", *COLUMNS, F.lit(False).alias("flag"))
    rows = rows.unionByName(pick(flags).select("page_id", "node_id", *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in COLUMNS], F.lit(True).alias("flag")))
    table = rows.toArrow().sort_by([("page_id", "ascending"), ("node_id", "ascending"), ("flag", "descending")])  # the nodes of n_pages pages
    if not table.num_rows:
        return Model(np.zeros(N_CODES), np.zeros((2, 2)))
    return fit_table(_merge_flags(table), texts, steps)


def fit_table(table: pa.Table, texts: dict[int, str], steps: int = 100) -> Model:
    p = Pages(table)
    at = blocks(p)
    codes, lengths = features(p, at)
    label, usable = weak_labels(p, at, texts)
    keep = usable[p.page[at]]
    if not keep.any():
        return Model(np.zeros(N_CODES), np.zeros((2, 2)))
    return Model(*crf.train(codes[keep], label[keep].astype(np.int64), lengths[usable], N_CODES, steps))


FOUND = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("node_id", T.IntegerType())])


def main_body(nodes: DataFrame, documents: DataFrame, repeated: DataFrame, n_pages: int = 1000) -> DataFrame:
    """page_id, node_id of the text blocks of the main body of every page.

    nodes: page_id, node_id, parent_id, node_depth, tag, text. repeated: page_id, node_id of lines that the site repeats.
    Lines that only list keywords are left out of it. Nodes without text are no blocks, nor are nodes with a null id; a repeated (page_id, node_id) counts once; a missing parent
    ends the chain of ancestors; an empty table, or one without a page to learn from, has no main body.

    Method: linear-chain CRF over the text blocks of a page in document order, with the tags of a block and its ancestors, its
    text, its box and the repeated lines around it as features; trained on at most n_pages weakly labelled pages.
    """
    model = fit(nodes, documents, repeated, n_pages)

    def run(table: pa.Table) -> dict:
        p = Pages(table)
        at, main = decode(p, model)
        main &= ~is_keyword_line(p.text.take(pa.array(at)))
        return {"page_id": p.page_id[at[main]], "node_id": p.node_id[at[main]].astype(np.int32)}

    return stream_pages(nodes, COLUMNS, run, FOUND, repeated)

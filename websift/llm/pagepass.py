"""One pass over whole pages that gives, a row a page, what the page queries need: main body, residue, spam features and languages."""

from __future__ import annotations

import dataclasses
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from websift.llm import langid, mainbody, residue, spam, trees
from websift.llm.lines import small
from websift.llm.pagestream import Pages, _merge_flags, stream_pages
from websift.session import materialise

TITLE, LABEL = -2, -1
HIDDEN = r"display:\s*none|visibility:\s*hidden|font-size:\s*0(px|em|pt|%)?\s*(;|$)|-\d{3,}px|overflow:\s*hidden|opacity:\s*0(\.0*)?\s*(;|$)|color:\s*#?(\w+)[^;]*;\s*background(-color)?:\s*#?\2\b"
COLUMNS = ["parent_id", "node_depth", "tag", "text"]
MORE = ["attr_text", "hidden", "site"]


@dataclasses.dataclass
class Parts:
    """What a pass computes beside the main body."""

    residue: bool = False
    spam: bool = False
    languages: bool = False


class Learned(NamedTuple):
    body: mainbody.Model
    forest: list[trees.Tree]
    known: list[str]
    lang: langid.Model | None


ROW = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("site", T.LongType()),
        T.StructField("main", T.ArrayType(T.IntegerType())),
        T.StructField("residue", T.BooleanType()),
        T.StructField("spam", T.DoubleType()),
        T.StructField("lang", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("label", T.StringType()),
        T.StructField("foreign_nodes", T.ArrayType(T.IntegerType())),
        T.StructField("foreign_langs", T.ArrayType(T.StringType())),
        T.StructField("foreign_confidence", T.ArrayType(T.DoubleType())),
    ]
)


def node_rows(nodes: DataFrame, meta: DataFrame | None, parts: Parts) -> DataFrame:
    """The nodes with the columns of a pass; the title and the declared language of a page travel as two more rows of it."""
    attrs = [F.col("attrs")[k] for k in ("alt", "title", "content", "aria-label", "value")]
    attr_text = F.nullif(F.concat_ws(" ", *attrs), F.lit("")) if parts.spam else F.lit(None).cast("string")
    hidden = F.coalesce(F.col("attrs")["style"].rlike(HIDDEN), F.lit(False)) if parts.spam else F.lit(False)
    rows = nodes.select("page_id", "node_id", *COLUMNS, attr_text.alias("attr_text"), hidden.alias("hidden"), F.xxhash64("host_name").alias("site"))
    if meta is not None:
        for node, column in ((TITLE, "title"), (LABEL, "langage")):
            if parts.residue if node == TITLE else parts.languages:
                none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields}
                own = {"page_id": F.col("page_id"), "node_id": F.lit(node).cast(rows.schema["node_id"].dataType).alias("node_id"), "text": F.col(column).alias("text")}
                rows = rows.unionByName(meta.where(F.col(column).isNotNull()).select(*[own.get(c, none[c]) for c in rows.columns]))
    return rows


class Pass:
    """Runs over tables of whole pages."""

    def __init__(self, learned: Learned, parts: Parts) -> None:
        self.learned, self.parts = learned, parts
        self.judge = residue.Judge() if parts.residue else None
        self.scorer = langid.Scorer(learned.lang) if parts.languages and learned.lang else None

    def __call__(self, table: pa.Table) -> dict | None:
        ids = table["node_id"].to_numpy()
        extra = {}
        for node in (TITLE, LABEL):
            part = table.filter(pa.array(ids == node))
            extra[node] = dict(zip(part["page_id"].to_pylist(), part["text"].to_pylist(), strict=True))
        table = table.filter(pa.array(ids >= 0))
        titles = extra[TITLE]
        if not table.num_rows:
            alone = [k for k, t in titles.items() if residue.has_leftover(t)]
            return self._alone(alone) if alone else None
        p = Pages(table)
        at, main = mainbody.decode(p, self.learned.body)
        n = len(p.start)
        page_ids = p.page_id[p.start]
        out = {f.name: [None] * n for f in ROW.fields}
        out["page_id"], out["site"] = page_ids, p.table["site"].to_numpy()[p.start]
        texts = p.text.take(pa.array(at))
        keyword = mainbody.is_keyword_line(texts)
        kept = np.flatnonzero(main & ~keyword)
        out["main"] = _lists(p.page[at[kept]], p.node_id[at[kept]], n)
        if self.parts.residue:
            out["residue"] = self._residue(p, at, main, texts, titles, page_ids)
        if self.parts.spam:
            x = self.spam_features(p, at, main, texts)
            out["spam"] = np.where(spam.has_words(x), trees.predict(self.learned.forest, x), 0.0)
            if self.parts.residue:
                out["spam"] = np.where(self.in_text, 0.0, out["spam"])
        if self.parts.languages:
            self._languages(p, at[kept], texts.take(pa.array(kept)), extra[LABEL], page_ids, out)
        alone = [k for k in titles.keys() - set(page_ids.tolist()) if residue.has_leftover(titles[k])] if self.parts.residue else []
        if alone:
            more = self._alone(alone)
            out = {k: list(v) + list(more[k]) for k, v in out.items()}
        return out

    @staticmethod
    def _alone(ids: list[int]) -> dict:
        """Pages without nodes whose title is residue."""
        out = {f.name: [None] * len(ids) for f in ROW.fields}
        return out | {"page_id": ids, "main": [[]] * len(ids), "residue": [True] * len(ids), "spam": [0.0] * len(ids)}

    def spam_features(self, p: Pages, at: np.ndarray, main: np.ndarray, texts: pa.Array) -> np.ndarray:
        m = np.flatnonzero(main)
        linked = p.inherit(p.tag_is("a"), np.logical_or)[at[m]]
        hidden = p.inherit(p.table["hidden"].fill_null(False).to_numpy(zero_copy_only=False), np.logical_or)[at[m]]
        attr = p.table["attr_text"]
        has = np.flatnonzero(np.asarray(attr.is_valid()))
        attr = attr.take(pa.array(has)).combine_chunks()
        attr = attr.combine_chunks() if isinstance(attr, pa.ChunkedArray) else attr
        return spam.features(texts.take(pa.array(m)), p.page[at[m]], linked, hidden, attr, p.page[has], len(p.start), pa.array(self.learned.known, pa.string()))

    def _residue(self, p: Pages, at: np.ndarray, main: np.ndarray, texts: pa.Array, titles: dict, page_ids: np.ndarray) -> list[bool]:
        n = len(p.start)
        pages = p.page[at]
        in_title = np.array([residue.has_leftover(titles.get(k)) for k in page_ids.tolist()], bool)
        found = np.zeros(n, bool)
        chars = pc.utf8_length(texts).to_numpy().astype(np.int64)
        main_chars = np.bincount(pages[main], chars[main], n)
        in_code = p.inherit(p.tag_is("code", "pre", "kbd", "samp"), np.logical_or)[at]
        linked = p.inherit(p.tag_is("a"), np.logical_or)[at]
        # On a page without other main text, a repeated line outside menus, links and notices may stand in place of content.
        counted = main & ~np.asarray(pc.match_substring_regex(texts, REFERENCE))
        empty = np.bincount(pages[counted], chars[counted], n) == 0
        beside = p.inherit(p.tag_is("nav", "header", "footer", "aside", "noscript", "button", "form", "label"), np.logical_or)[at]
        in_place = p.flag[at] & empty[pages] & ~linked & ~beside
        open_line = (~p.flag[at] & ~linked) | in_place
        # A placeholder outside the main text counts where what stands outside outweighs it.
        outside = np.bincount(pages[open_line & ~main], chars[open_line & ~main], n) > main_chars
        hints = np.flatnonzero(residue.array_hint(texts) & ~in_code & ((main & ~p.flag[at]) | (outside[pages] & open_line) | in_place))
        for i, t in zip(hints.tolist(), texts.take(pa.array(hints)).to_pylist(), strict=True):
            found[pages[i]] |= residue.has_leftover(t)
        own_line = main & ~p.flag[at]
        # The judge sees every distinct line that counts; a page is judged as a whole only if one of its lines matches.
        judged = np.flatnonzero(own_line | open_line)
        match = self.judge.matches(texts.take(pa.array(judged)))
        suspect = np.bincount(pages[judged[match]], minlength=n) > 0
        look = np.flatnonzero(~found & suspect)
        bounds = np.searchsorted(pages, np.stack([look, look + 1]))
        for k, a, b in zip(look.tolist(), *bounds.tolist(), strict=True):
            idx = np.arange(a, b)
            inside = idx[own_line[a:b]]
            outside = idx[~own_line[a:b] & open_line[a:b]]
            found[k] = self.judge.replaces_content(texts.take(pa.array(inside)).to_pylist(), texts.take(pa.array(outside)).to_pylist())
        #: A message or filler in place of content is no keyword stuffing.
        self.in_text = found
        return (found | in_title).tolist()

    def _languages(self, p: Pages, at: np.ndarray, texts: pa.Array, labels: dict, page_ids: np.ndarray, out: dict) -> None:
        """Main language by the words of the lines each language wins ('und' if the model knows none so likely); then the lines wholly in another language."""
        n = len(p.start)
        model = self.learned.lang
        line = mainbody.line_of(p, at)
        order, first = np.unique(line, return_inverse=True)
        pieces = texts.to_pylist()
        joined = [""] * len(order)
        for i, k in enumerate(first.tolist()):
            joined[k] += pieces[i]
        scored = langid.score_lines(self.scorer, joined)
        line_page = p.page[order]
        m = len(model.langs)
        scripts = [langid.script_language(t) if not t.isascii() else (None, 0.0) for t in joined]
        langs = [*model.langs, *sorted({s for s, _ in scripts if s is not None} - set(model.langs))]
        at_lang = {la: j for j, la in enumerate(langs)}
        by_script = np.array([-1 if s is None else at_lang[s] for s, _ in scripts], np.int64)
        latin = by_script < 0
        best = np.where(latin, scored.scores.argmax(axis=1), by_script) if len(order) else np.zeros(0, np.int64)
        # A line in a script without blanks counts by its letters.
        weight = np.where(latin, scored.words, np.maximum(scored.words, np.array([len(t) for t in joined], float) / 6)) if len(order) else np.zeros(0)
        votes = np.zeros((n, len(langs)))
        np.add.at(votes, (line_page, best), weight)
        total, levels = (np.stack([np.bincount(line_page[latin], x[latin, j], n) for j in range(m)], axis=1) for x in (scored.scores, scored.levels))
        main_lang = np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), -1)
        share = votes.max(axis=1) / np.maximum(votes.sum(axis=1), 1e-9)
        in_model = (main_lang >= 0) & (main_lang < m)
        of_page = lambda x: np.bincount(line_page[latin], x[latin], n)
        known = langid.is_known(model, levels[np.arange(n), np.clip(main_lang, 0, m - 1)], of_page(scored.chars), of_page(scored.words))
        script_sure = np.bincount(line_page, np.where(latin, 0.0, weight * np.array([c for _, c in scripts])), n) / np.maximum(np.bincount(line_page, np.where(latin, 0.0, weight), n), 1e-9)
        sure = share * np.where(in_model, langid.confidence(total, model.temperature), script_sure)
        undetermined = in_model & ~known
        main_lang = np.where(undetermined, -1, main_lang)
        mine = main_lang[line_page]
        rows = np.arange(len(order))
        own = np.clip(mine, 0, m - 1)
        top = np.minimum(best, m - 1)
        margin = np.where(mine < m, scored.scores[rows, top] - scored.scores[rows, own], np.inf)
        # Words that clearly speak for the main language against the line's own show a line that is not wholly foreign.
        w = scored.word_line
        against = scored.word_scores[np.arange(len(w)), own[w]] - scored.word_scores[np.arange(len(w)), top[w]] if len(w) else np.zeros(0)
        mixed = np.bincount(w, (against > 3.0) & (mine[w] < m), len(order)) / np.maximum(scored.words, 1)
        conf = np.where(latin, langid.confidence(scored.scores, model.temperature), np.array([c for _, c in scripts]))
        # A language is only believed against the page's own where its samples hold enough of the words; names alone are no evidence.
        seen = np.bincount(w, (scored.word_seen >> top[w]) & 1, len(order)) if len(w) else np.zeros(len(order))
        believed = (seen >= 2) & (seen >= SEEN_SHARE * scored.words)
        foreign = latin & believed & (best != mine) & (mine >= 0) & (margin > MARGIN) & (mixed <= 0.2)
        foreign |= ~latin & (mine >= 0) & (best != mine)
        hit = np.flatnonzero(foreign[first])
        owner = p.page[at[hit]]
        out["foreign_nodes"] = _lists(owner, p.node_id[at[hit]], n)
        out["foreign_langs"] = _lists(owner, np.array([langs[best[k]] for k in first[hit].tolist()], object), n)
        out["foreign_confidence"] = _lists(owner, conf[first[hit]], n)
        out["lang"] = [langs[k] if k >= 0 else "und" if u else None for k, u in zip(main_lang.tolist(), undetermined.tolist(), strict=True)]
        out["confidence"] = np.where(undetermined, 0.0, sure).tolist()
        out["label"] = [langid.declared(labels.get(k)) for k in page_ids.tolist()]


#: A reference number such as stands on an error page; alone it is no content.
REFERENCE = r"(?i)^[^\p{L}\p{N}]*(ref|ray|id|code|error|request|incident)\b[\s:#.]*[\w/ :-]*$"
#: How much a line's own language must win by, in log-probability.
MARGIN = 4.0
#: What share of a line's words the samples of its language must hold.
SEEN_SHARE = 0.3


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> list[list]:
    """The values of each owner, in order; owner is sorted."""
    bounds = np.searchsorted(owner, np.arange(n + 1))
    flat = values.tolist()
    return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def learn(rows: DataFrame, documents: DataFrame, repeated: DataFrame, samples: DataFrame, parts: Parts, n_pages: int = 1000) -> Learned:
    """Trains all models of a pass on the driver: body and forest on at most n_pages pages (lowest hash of the id), languages on the samples."""
    texts = mainbody.sample_texts(documents, n_pages)
    clean = [(r.lang, r.text) for r in samples.select("lang", "text").collect()]  # a fixed small table
    known = sorted({w for _, t in clean if t for w in _plain(t)})
    lang = langid.calibrate(clean, langid.vocabulary()) if parts.languages else None
    body = mainbody.Model(np.zeros(mainbody.N_CODES), np.zeros((2, 2)))
    forest: list[trees.Tree] = []
    if texts:
        ids = sorted(texts)
        pick = lambda df: df.where(F.col("page_id").isin(ids))
        table = pick(rows).where("node_id >= 0").withColumn("flag", F.lit(False))
        empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields}
        table = table.unionByName(pick(repeated).select(*[F.col(c) if c in ("page_id", "node_id") else empty[c] for c in rows.columns], F.lit(True).alias("flag")))
        arrow = table.toArrow().sort_by([("page_id", "ascending"), ("node_id", "ascending"), ("flag", "descending")])  # the nodes of n_pages pages
        if arrow.num_rows:
            arrow = _merge_flags(arrow)
            body = mainbody.fit_table(arrow, texts)
            if parts.spam:
                run = Pass(Learned(body, [], known, None), Parts(spam=True))
                p = Pages(arrow)
                at, main = mainbody.decode(p, body)
                x = run.spam_features(p, at, main, p.text.take(pa.array(at)))
                forest = spam.fit(x, _labels(p, texts, spam.function_words(clean)))
    return Learned(body, forest, known, lang)


def _labels(p: Pages, texts: dict[int, str], common: set[str]) -> np.ndarray:
    """The weak label of each page from its exported text and the texts of its attributes."""
    attrs = p.table["attr_text"].to_pylist()
    ends = [*p.start.tolist()[1:], len(p.page_id)]
    return np.array([spam.weak_label(texts.get(int(p.page_id[a])), " ".join(x for x in attrs[a:b] if x), common) for a, b in zip(p.start.tolist(), ends, strict=True)], np.int64)


def _plain(text: str) -> list[str]:
    return langid.WORD.findall(text.lower().replace("'", " ").replace("’", " "))


def analyse(nodes: DataFrame, meta: DataFrame | None, documents: DataFrame, samples: DataFrame, repeated: DataFrame, parts: Parts, n_pages: int = 1000) -> DataFrame:
    """The rows of ROW, one a page, written to the shared folder."""
    rows = node_rows(nodes, meta, parts)
    learned = learn(rows, documents, repeated, samples, parts, n_pages)
    return materialise(stream_pages(rows, [*COLUMNS, *MORE], _Lazy(learned, parts), ROW, repeated), "pages")


class _Lazy:
    """Builds the Pass on the worker: automata and caches are not sent."""

    def __init__(self, learned: Learned, parts: Parts) -> None:
        self.args, self.made = (learned, parts), None

    def __getstate__(self) -> dict:
        return {"args": self.args, "made": None}

    def __call__(self, table: pa.Table) -> dict | None:
        if self.made is None:
            self.made = Pass(*self.args)
        return self.made(table)


def smoothed_spam(pages: DataFrame, weight: float = 0.1, prior: float = 20.0) -> DataFrame:
    """page_id, score: the page's spam score drawn a little towards the mean score of its site (itself drawn towards the overall mean by prior pages)."""
    site = pages.groupBy("site").agg(F.sum("spam").alias("s"), F.count("*").alias("n"))
    mean = pages.agg(F.coalesce(F.avg("spam"), F.lit(0.0))).first()[0]
    rate = materialise(site.select("site", ((F.col("s") + prior * F.lit(mean)) / (F.col("n") + prior)).alias("rate")), "site-rate")
    joined = pages.select("page_id", "site", "spam").join(small(rate), "site", "left")
    return joined.select("page_id", ((1 - weight) * F.col("spam") + weight * F.coalesce("rate", F.col("spam"))).alias("score"))

"""HTML to nodes, meta and links on the standard library's tokenizer; one Arrow pass parses a page once for all of them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from websift.schema import META, NODE

# Fixed values of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEAD_ONLY = {"base", "link", "meta", "title", "style", "script", "noscript", "template"}
CLOSED_BY_BLOCK = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main",
    "menu", "nav", "ol", "p", "pre", "search", "section", "table", "ul",
}
#: A start tag closes the open elements named here, up to the nearest element named in the second set.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


class Element:
    """An element (tag set) or a text (tag None)."""

    __slots__ = ("attrs", "children", "ns", "parent", "tag", "text")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, parent: Element | None = None, text: str = "", ns: str = "") -> None:
        self.tag, self.attrs, self.parent, self.text, self.ns = tag, attrs or {}, parent, text, ns
        self.children: list[Element] = []


class _Builder(HTMLParser):
    """Builds html, head and body, implied where the page lacks them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("html")
        self.head = Element("head", parent=self.root)
        self.body = Element("body", parent=self.root)
        self.root.children = [self.head, self.body]
        self.in_body = False
        self.open = self.head

    def _enter_body(self) -> None:
        if not self.in_body:
            self.in_body, self.open = True, self.body

    def _close(self, names: set[str], stop: set[str]) -> None:
        x = self.open
        while x.parent is not None and x.tag not in stop:
            if x.tag in names:
                self.open = x.parent
                return
            x = x.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]], closed: bool = False) -> None:
        found: dict[str, str] = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        if tag in ("html", "head", "body"):
            at = {"html": self.root, "head": self.head, "body": self.body}[tag]
            at.attrs = found | at.attrs
            if tag == "body":
                self._enter_body()
            return
        if not self.in_body and tag not in HEAD_ONLY:
            self._enter_body()
        if tag in CLOSED_BY_BLOCK:
            self._close({"p"}, {"button", "table", "td", "th", "body"})
        if tag in IMPLIED_END:
            self._close(*IMPLIED_END[tag])
        ns = self.open.ns or (tag if tag in ("svg", "math") else "")
        x = Element(tag, found, self.open, ns=ns)
        self.open.children.append(x)
        if tag not in VOID and not (closed and ns):
            self.open = x

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs, closed=True)

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self._enter_body()
            return
        if tag in ("html", "body"):
            return
        x = self.open
        while x.parent is not None and x not in (self.body, self.head):
            if x.tag == tag:
                self.open = x.parent
                return
            x = x.parent
        if tag == "p" and self.in_body:
            self.open.children.append(Element("p", parent=self.open))

    def handle_data(self, data: str) -> None:
        if not self.in_body and self.open is self.head and data.strip():
            self._enter_body()
        last = self.open.children[-1] if self.open.children else None
        if last is not None and last.tag is None:
            last.text += data
        else:
            self.open.children.append(Element(None, parent=self.open, text=data))


    def handle_comment(self, data: str) -> None:
        if not self.in_body and self.open is self.head:
            self.head.children.append(Element("#comment", parent=self.head))


def parse(html: str | None) -> Element:
    """The tree of a page; null or empty html gives an empty head and body. Never raises on dirty html."""
    builder = _Builder()
    if html:
        builder.feed(html)
        builder.close()
    return builder.root


def _dropped(x: Element) -> bool:
    """style, and script other than ld+json; the same names inside svg stay."""
    if x.ns:
        return False
    return x.tag == "style" or x.tag == "script" and x.attrs.get("type") != "application/ld+json"


def _compact(text: str) -> str:
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return text


def nodes(top: Element, blank: bool = False) -> list[dict]:
    """The elements and texts under top in document order. An only text child is folded into its element; blank texts stay out unless blank."""
    out: list[dict] = []
    todo = [(top, None, 0, 0)]
    while todo:
        x, parent, pos, depth = todo.pop()
        kept = [c for c in x.children if not _dropped(c) and (c.tag is not None or blank or c.text.strip())]
        text = x.text if x.tag is None else None
        if len(kept) == 1 and kept[0].tag is None:
            text, kept = kept[0].text, []
        if x.tag == "script" and text is not None:
            text = _compact(text)
        k = len(out)
        out.append(
            {
                "node_id": k, "parent_id": parent, "pos": pos, "depth": depth, "ns": x.ns, "tag": x.tag, "elem_id": x.attrs.get("id"),
                "classes": x.attrs.get("class", "").split(), "attrs": {a: v for a, v in x.attrs.items() if a not in ("id", "class") and ":" not in a}, "text": text,
            }
        )
        todo.extend((c, k, i, depth + 1) for i, c in reversed(list(enumerate(kept))))
    return out


def _walk(top: Element) -> Iterator[Element]:
    todo = [top]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(reversed(x.children))


def walk(top: Element, prune: Callable[[Element], bool]) -> None:
    """Calls prune on each element in document order; what stands under one for which it is true is skipped."""
    todo = [top]
    while todo:
        x = todo.pop()
        if not prune(x):
            todo.extend(reversed(x.children))


def _text(x: Element) -> str:
    return "".join(c.text for c in x.children if c.tag is None)


def meta(root: Element) -> dict:
    """Meta of a page: the first title, description and og value of the head counts; robots directives add up."""
    out: dict = {"lang": root.attrs.get("lang", ""), "title": None, "description": None, "no_follow": False, "no_index": False, "og_title": None, "og_image": None, "og_description": None, "og_locale": None, "og_site_name": None, "linked_data": []}
    places = {"og:title": "og_title", "og:image": "og_image", "og:description": "og_description", "og:locale": "og_locale", "og:site_name": "og_site_name"}
    for x in _walk(root.children[0]):
        if x.tag == "title" and out["title"] is None:
            out["title"] = _text(x)
        elif x.tag == "script" and x.attrs.get("type") == "application/ld+json":
            out["linked_data"].insert(0, _compact(_text(x)))
        elif x.tag == "meta" and (content := x.attrs.get("content", "")):
            name = x.attrs.get("name", "")
            if name == "description":
                out["description"] = content if out["description"] is None else out["description"]
            elif name == "robots":
                words = re.split(r"[,\s]+", content)
                out["no_index"] |= "noindex" in words or "none" in words
                out["no_follow"] |= "nofollow" in words or "none" in words
            elif (at := places.get(x.attrs.get("property", ""))) and out[at] is None:
                out[at] = content
    return {k: v if v is not None else "" for k, v in out.items()}


def print_lines(top: Element) -> list[str]:
    """A dump of the tree for tests: one line a node, '=' for each level."""
    out = []
    for x in nodes(top):
        parts = ["=" * x["depth"]]
        if x["tag"]:
            parts.append(f"<{x['tag']}>")
        parts += [f"#{x['elem_id']}"] * bool(x["elem_id"]) + [f".{c}" for c in x["classes"]] + [f"{k}={v}" for k, v in sorted(x["attrs"].items())]
        if x["text"]:
            parts.append(repr(x["text"].strip()))
        out.append(" ".join(p for p in parts if p))
    return out


def is_strict(root: Element) -> bool:
    """Whether a search that climbs one level at most gets from the head to the body.

    It gets past an element if it gets past all its children and ends in a last child without children of its own. Comments and white
    space in the head count as children.
    """
    passed = lambda x: not x.children or not x.children[-1].children and all(map(passed, x.children))
    return passed(root.children[0])


PARSED = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("meta", META),
        T.StructField("nodes", T.ArrayType(NODE)),
        T.StructField("hrefs", T.ArrayType(T.StringType())),
        T.StructField("body_text", T.StringType()),
    ]
)


def parse_pages(pages: DataFrame, strict_structure: bool = False, columns: tuple[str, ...] = ("meta", "nodes", "hrefs", "body_text")) -> DataFrame:
    """One row a page with its meta, body nodes, raw hrefs in document order and body text (node texts parted by a line feed); of a page only what columns need is made.

    Null html gives empty meta and a lone body node. strict_structure leaves out the pages that a one-level search for the
    body can't read. Only the columns asked for leave Python. Pages that come in fewer partitions than there are cores (one small
    file) are spread first; a larger input is parsed where it is read, without a shuffle.
    """
    schema = T.StructType([f for f in PARSED if f.name in ("page_id", "url", *columns)])
    names = schema.names
    wants_body = bool({"nodes", "hrefs", "body_text"} & set(names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page_id, url, html in zip(b.page_id, b.url, b.html, strict=True):
                root = parse(html)
                if strict_structure and not is_strict(root):
                    continue
                made = {"page_id": page_id, "url": url}
                if "meta" in names:
                    made["meta"] = meta(root)
                if wants_body:
                    made["nodes"] = body = nodes(root.children[1])
                    made["hrefs"] = [x["attrs"]["href"] for x in body if x["tag"] == "a" and "href" in x["attrs"]]
                    made["body_text"] = "\n".join(x["text"] for x in body if x["text"])
                rows.append([made[n] for n in names])
            yield pd.DataFrame(rows, columns=names)

    rows = pages.select("page_id", "url", "html")
    cores = pages.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)
    return rows.mapInPandas(run, schema)

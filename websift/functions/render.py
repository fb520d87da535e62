"""Results and pages as HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from websift.functions.text import escape_html, limit_text


def result_item(url: Column, title: Column, description: Column) -> Column:
    """One result as a list item: title with a link, description; both shortened, nulls as empty texts, all text escaped."""
    short = lambda x, n: escape_html(limit_text(F.coalesce(x, F.lit("")), n))
    return F.concat(F.lit('<li><a href="'), escape_html(url), F.lit('">'), short(title, 60), F.lit("</a><p>"), short(description, 160), F.lit("</p></li>"))


def result_page(found: dict, query: str, page: int) -> str:
    """A whole page of results as search.search gives them: terms with their pages, results in order, links to the other result pages."""
    import html as text

    e = lambda x: text.escape(str(x or ""))
    terms = ", ".join(f"{e(t['word'])} ({t['df']})" for t in found["terms"])
    items = "".join(f'<li><a href="{e(r["url"])}">{e(r["title"])}</a><p>{e(r["description"])}</p></li>' for r in found["results"])
    pages = " ".join(f"<b>{k}</b>" if k == page else f'<a href="?q={e(query)}&amp;page={k}">{k}</a>' for k in range(found["chunks"]))
    return f"<!DOCTYPE html><html><head><title>{e(query)}</title></head><body><p>{terms}: {found['n']}</p><ol start={10 * page + 1}>{items}</ol><nav>{pages}</nav></body></html>"

"""URL cleaning, resolution and parent expansion. Python, because Spark has no URL algebra; called through Arrow UDFs."""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import quote_plus, unquote_plus, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")


def _query(raw: str) -> str:
    """Sorted by key, values of a key in their order, re-encoded; a pair with ';' or a bad escape is dropped."""
    pairs: dict[str, list[str]] = {}
    for part in raw.split("&"):
        if not part or ";" in part or _BAD_ESCAPE.search(part):
            continue
        key, _, value = part.partition("=")
        pairs.setdefault(unquote_plus(key), []).append(unquote_plus(value))
    return "&".join(f"{quote_plus(k, safe='~')}={quote_plus(v, safe='~')}" for k in sorted(pairs) for v in pairs[k])


def clean(url: str | None) -> str | None:
    """Without user, fragment and bare '?', query sorted. None for what can't be parsed."""
    if url is None:
        return None
    try:
        s = urlsplit(url.strip())
        s.port  # noqa: B018  raises for a bad port
    except ValueError:
        return None
    query = _query(s.query)
    host = s.netloc.rpartition("@")[2]
    if not s.scheme:
        return None
    return f"{s.scheme}://{host}{s.path}" + (f"?{query}" if query else "") if host else None


def resolve(base: str | None, href: str | None) -> str | None:
    """href against the page's URL; <base> elements do not count. Only http and https remain."""
    if base is None or href is None:
        return None
    try:
        url = urljoin(base, href.strip())
        return url if urlsplit(url).scheme in ("http", "https") else None
    except ValueError:
        return None


def expand(url: str | None, seen: dict[str, None] | None = None) -> list[str]:
    """The cleaned URL and those above it: without query, each parent folder, the host without port, each parent domain, www.<domain>.

    seen: URLs found before; a URL already in it adds nothing.
    """
    seen = {} if seen is None else seen
    source = clean(url)
    if source is None:
        return list(seen)
    s = urlsplit(source)
    host = s.netloc.removesuffix(".")
    site = f"{s.scheme}://{host}"
    whole = site + s.path + (f"?{s.query}" if s.query else "")
    if whole not in seen:
        name = host.partition(":")[0]
        labels = name.split(".")
        folders = [site + s.path[: slash.end()] for slash in re.finditer("/", s.path)]
        # The host itself only where its port is left out; a domain keeps two labels.
        domains = [".".join(labels[i:]) for i in range(0 if name != host else 1, max(len(labels) - 1, 1))]
        hosts = [*domains, "www." + ".".join(labels[-2:])]
        seen.update(dict.fromkeys([whole, site + s.path, *folders, *(f"{s.scheme}://{h}/" for h in hosts)]))
    return list(seen)


def parse_all(texts: Iterable[str]) -> list[str]:
    """The cleaned URLs; ValueError names the first text that is no absolute URL."""
    out = []
    for t in texts:
        if (url := clean(t)) is None:
            raise ValueError(f"no absolute URL: {t!r}")
        out.append(url)
    return out


def sorted_list(found: Iterable[str]) -> list[str]:
    """URLs in text order; for a few URLs of a message or a configuration. Tables are sorted by Spark."""
    return sorted(found)


def page_links(base: str | None, hrefs: Iterable[str] | None) -> list[str]:
    """All URLs that a page's hrefs lead to, with their parents, each once."""
    seen: dict[str, None] = {}
    for href in () if hrefs is None else hrefs:
        if (url := resolve(base, href)) is not None:
            expand(url, seen)
    return list(seen)


@F.pandas_udf(T.StringType())
def clean_url(url: pd.Series) -> pd.Series:
    return url.map(clean, na_action="ignore")


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([resolve(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def expand_url(url: pd.Series) -> pd.Series:
    return pd.Series([expand(u) for u in url], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def links_of(base: pd.Series, hrefs: pd.Series) -> pd.Series:
    return pd.Series([page_links(b, h) for b, h in zip(base, hrefs, strict=True)], dtype=object)


def host_queue(url: Column) -> Column:
    """scheme:host[:port] without user and trailing ':'; null for a text that is no absolute URL."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":$", "")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    return F.when(host != "", F.concat_ws(":", scheme, host))


def strip_empty_port(url: str) -> str:
    """The URL without a ':' that no port follows."""
    return re.sub(r"^([^/]*//[^/?#]*):(?=[/?#]|$)", r"\1", url)


def without_empty_port(url: Column) -> Column:
    """The URL without a ':' that no port follows."""
    return F.regexp_replace(url, r"^([^/?#]*//[^/?#]*):(?=[/?#]|$)", "$1")


def path_and_query(url: Column) -> Column:
    """What robots rules are tested against: the path and the raw query, without the '?' between."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.concat(F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"\?(.*)$", 1))

"""robots.txt: parsing, rule order and matching."""

from __future__ import annotations

import re
from typing import NamedTuple
from urllib.parse import unquote_plus

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")


class Rule(NamedTuple):
    allow: bool
    first: str
    middle: tuple[str, ...]
    end: bool


class Robots(NamedTuple):
    crawl_delay: int = 0
    sitemaps: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()


def lines(content: str) -> list[tuple[str, str]]:
    """(lower-case name, value) of each line that has a ':' outside its comment."""
    out = []
    for line in re.split(r"[\n\r]", content):
        name, colon, value = line.partition("#")[0].partition(":")
        if colon:
            out.append((name.strip().lower(), value.strip()))
    return out


def pattern_rule(pattern: str, allow: bool) -> Rule | None:
    """None for a bad escape. An empty pattern is the empty prefix, which every URL has."""
    end = False
    if len(pattern) > 1:
        if pattern.endswith("$"):
            pattern, end = pattern[:-1], True
        elif pattern.endswith("*"):
            pattern = pattern[:-1]
    if _BAD_ESCAPE.search(pattern):
        return None
    first, *middle = (unquote_plus(p) for p in pattern.split("*"))
    return Rule(allow, first, tuple(middle), end)


def matches(rule: Rule, target: str) -> bool:
    """Prefix, then each part at its first place after the one before; no way back. end: nothing may follow."""
    if not target.startswith(rule.first):
        return False
    at = len(rule.first)
    for part in rule.middle:
        if (k := target.find(part, at)) < 0:
            return False
        at = k + len(part)
    return not rule.end or at == len(target)


def rule_regex(rule: Rule) -> str:
    """The same test for Spark's rlike: atomic groups give the first place without a way back."""
    quote = lambda s: r"\Q" + s.replace(r"\E", r"\E\\E\Q") + r"\E"
    return "(?s)^" + quote(rule.first) + "".join(f"(?>.*?{quote(p)})" for p in rule.middle) + (r"\z" if rule.end else "")


def parse(content: str | None) -> Robots:
    """The rules for every agent ('*'), patterns in descending order, Allow first among equals; delay and sitemaps of the whole file."""
    delay, sitemaps, found = 0, [], []
    agents: list[str] = ["*"]
    after_rule = False
    for name, value in lines(content or ""):
        if name == "crawl-delay" and value.isascii() and value.isdigit() and int(value) > 0:
            delay = int(value)
        elif name == "sitemap" and value.startswith("https://"):
            sitemaps.append(value)
        elif name == "user-agent":
            if after_rule or agents == ["*"] and not found:
                agents = []
            after_rule = False
            agents.append(value)
        elif name in ("allow", "disallow"):
            after_rule = True
            if "*" in agents:
                found.append((value, name == "allow"))
    found.sort(key=lambda x: (x[0], x[1]), reverse=True)
    rules = (pattern_rule(p, a) for p, a in found)
    return Robots(delay, tuple(sitemaps), tuple(r for r in rules if r is not None))


def allowed(robots: Robots, target: str) -> bool:
    return next((r.allow for r in robots.rules if matches(r, target)), True)


RULE = T.StructType(
    [T.StructField("allow", T.BooleanType()), T.StructField("first", T.StringType()), T.StructField("middle", T.ArrayType(T.StringType())), T.StructField("end_match", T.BooleanType()), T.StructField("regex", T.StringType())]
)
PARSED = T.StructType([T.StructField("crawl_delay", T.IntegerType()), T.StructField("sitemaps", T.ArrayType(T.StringType())), T.StructField("rules", T.ArrayType(RULE))])


@F.pandas_udf(T.BooleanType())
def robots_allow(content: pd.Series, target: pd.Series) -> pd.Series:
    """Whether the robots file allows the target (path and query without '?'); a null file allows all."""
    cache: dict[str | None, Robots] = {}
    out = []
    for c, t in zip(content, target, strict=True):
        if c not in cache:
            cache[c] = parse(c)
        out.append(allowed(cache[c], t or ""))
    return pd.Series(out, dtype=bool)


@F.pandas_udf(PARSED)
def parse_robots(content: pd.Series) -> pd.DataFrame:
    rows = []
    for c in content:
        r = parse(c)
        rows.append((r.crawl_delay, list(r.sitemaps), [{"allow": x.allow, "first": x.first, "middle": list(x.middle), "end_match": x.end, "regex": rule_regex(x)} for x in r.rules]))
    return pd.DataFrame(rows, columns=["crawl_delay", "sitemaps", "rules"])

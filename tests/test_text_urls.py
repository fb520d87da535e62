import hashlib

import hypothesis.strategies as st
import pytest
from hypothesis import given, settings
from pyspark.sql import functions as F

from websift.functions import keys, robots, text, urls
from websift.functions.html import meta, nodes, parse, parse_pages, print_lines, walk
from websift.operators.search import parse_query


def words(spark, s):
    return spark.createDataFrame([(s,)], "t string").select(text.tokens(F.col("t")).alias("w")).first().w


def test_tokens(spark):
    assert words(spark, "Two sheep, 17 goats\tand x; zz9 9zz 1111 sheep") == ["two", "sheep", "goats", "and", "zz9", "9zz", "sheep"]
    assert words(spark, "ooo OOo ñu --- -a-") == ["ooo", "ñu", "-a-"]
    assert words(spark, "ΟΔΟΣ İx-1") == ["οδοσ", "ix-1"]
    assert words(spark, "") == []
    assert words(spark, None) is None


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_query_words_are_long_and_lower(q):
    for w in parse_query(q):
        assert len(w.encode()) >= 2 and not any(c.isspace() for c in w)


def test_query():
    assert parse_query("Red  KITE, red") == ["red", "kite", "red"]
    assert parse_query("of 7 ss") == []


def test_limit_and_escape(spark):
    df = spark.createDataFrame([("abcdef",), ("ab",), ("éééé",), (None,)], "t string")
    assert [r[0] for r in df.select(text.limit_text(F.col("t"), 4)).collect()] == ["abcd...", "ab", "éééé", None]
    assert spark.createDataFrame([("<a href=\"x\">'&",)], "t string").select(text.escape_html(F.col("t"))).first()[0] == "&lt;a href=&#34;x&#34;&gt;&#39;&amp;"


def test_key(spark):
    url = "https://moorhen.test/pond?depth=3"
    df = spark.createDataFrame([(url,), (None,)], "u string")
    assert [r[0] for r in df.select(keys.key_hex(F.col("u"))).collect()] == [hashlib.sha256(url.encode()).hexdigest(), None]
    assert df.select(keys.key_binary(F.col("u"))).first()[0] == hashlib.sha256(url.encode()).digest()


def test_page_links():
    hrefs = ["//me:pw@reed.test", "tel:12345", "http://a.pond.reed.test:81/x/y?k=2&b=1#z", "fish", "?p=1"]
    assert set(urls.page_links("https://pike.test/lake/", hrefs)) == {
        "https://reed.test", "https://www.reed.test/",
        "http://a.pond.reed.test:81/x/y?b=1&k=2", "http://a.pond.reed.test:81/x/y", "http://a.pond.reed.test:81/x/", "http://a.pond.reed.test:81/",
        "http://a.pond.reed.test/", "http://pond.reed.test/", "http://reed.test/", "http://www.reed.test/",
        "https://pike.test/lake/fish", "https://pike.test/lake/", "https://pike.test/", "https://www.pike.test/", "https://pike.test/lake/?p=1",
    }
    assert urls.page_links(None, ["/x"]) == [] and urls.page_links("https://pike.test/", None) == []


def test_expand_edges():
    assert urls.expand("https://eel.test./a") == ["https://eel.test/a", "https://eel.test/", "https://www.eel.test/"]
    assert urls.expand("https://10.0.0.7/") == ["https://10.0.0.7/", "https://0.0.7/", "https://0.7/", "https://www.0.7/"]
    assert urls.expand("no url") == [] and urls.expand(None) == []


def test_clean():
    assert urls.clean("https://u:p@a.b/x?b=1&a=2&b=0#f") == "https://a.b/x?a=2&b=1&b=0"
    assert urls.clean("https://a.b/x?") == "https://a.b/x"
    assert urls.clean("https://a.b/?q=a b;c&r=%zz") == "https://a.b/"
    assert urls.clean("nothing") is None and urls.clean(None) is None and urls.clean("http://[bad/") is None
    assert urls.resolve("https://a.b/c/d", "../e") == "https://a.b/e"
    assert urls.resolve("https://a.b/", "mailto:x@y") is None and urls.resolve(None, "x") is None


def test_parse_urls():
    assert urls.parse_all(["https://a.b/?y=1&x=2", "https://c.d/"]) == ["https://a.b/?x=2&y=1", "https://c.d/"]
    with pytest.raises(ValueError, match="nothing"):
        urls.parse_all(["https://a.b/", "nothing"])
    assert urls.sorted_list(["https://c.d/", "https://a.b/x", "https://a.b/"]) == ["https://a.b/", "https://a.b/x", "https://c.d/"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_clean_is_stable(tail):
    once = urls.clean("https://host.example/" + tail)
    assert once is None or urls.clean(once) == once


def test_queue(spark):
    df = spark.createDataFrame([("HTTPS://u@a.b:80/x",), ("http://a.b:/",), ("x",)], "url string")
    assert [r[0] for r in df.select(urls.host_queue(F.col("url"))).collect()] == ["https:a.b:80", "http:a.b", None]
    assert df.select(urls.path_and_query(F.lit("https://a/b?c=d#e"))).first()[0] == "/bc=d"
    assert [r[0] for r in df.select(urls.without_empty_port(F.col("url"))).collect()] == ["HTTPS://u@a.b:80/x", "http://a.b/", "x"]


PAGE = """<!DOCTYPE html><html lang="fr"><head><title>First</title><meta name="description" content="D"><meta name="robots" content="noindex, nofollow">
<meta property="og:title" content="One"><meta property="og:title" content="Two"><script type="application/ld+json">{ "a" : 1 }</script><script>x()</script></head>
<body class="b c" id=i><p>one<p>two <b>bold</b> end<style>p{}</style><ul><li>x<li>y &amp; z</ul><br><a href="/l">L</a><!-- no --></body></html>"""


def test_html():
    root = parse(PAGE)
    m = meta(root)
    assert (m["lang"], m["title"], m["description"], m["no_index"], m["no_follow"], m["og_title"], m["linked_data"]) == ("fr", "First", "D", True, True, "One", ['{"a":1}'])
    assert print_lines(root.children[1]) == ["<body> #i .b .c", "= <p> 'one'", "= <p>", "== 'two'", "== <b> 'bold'", "== 'end'", "= <ul>", "== <li> 'x'", "== <li> 'y & z'", "= <br>", "= <a> href=/l 'L'"]
    assert nodes(parse(None).children[1])[0]["tag"] == "body"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/ =\"'abp!-&;", max_size=60))
def test_html_never_fails(s):
    nodes(parse(s).children[1])
    meta(parse(s))


def test_parse_pages(spark):
    rows = spark.createDataFrame([(1, "https://a/", PAGE), (2, "https://b/", None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in parse_pages(rows).collect()}
    assert got[1].hrefs == ["/l"] and got[1].meta.title == "First" and got[1].nodes[1].text == "one"
    assert got[2].body_text == "" and got[2].hrefs == []
    assert parse_pages(rows, strict_structure=True).where("page_id = 1").count() == 0


ROBOTS = """# pond rules
User-agent: otter
Disallow: /
User-agent: heron # two agents, one group
User-agent: *
Disallow: /nest
Allow: /nest/open
Disallow: /eggs/*/raw$
crawl-delay: 4
Allow: /eggs
Sitemap: http://pond.test/no.xml
Sitemap: https://pond.test/yes.xml

User-agent: coot
Disallow: /reeds
crawl-delay: none
"""


def test_robots_file():
    r = robots.parse(ROBOTS)
    assert r.crawl_delay == 4 and r.sitemaps == ("https://pond.test/yes.xml",)
    assert [(x.allow, x.first, x.middle, x.end) for x in r.rules] == [(True, "/nest/open", (), False), (False, "/nest", (), False), (False, "/eggs/", ("/raw",), True), (True, "/eggs", (), False)]
    for path, ok in (("/", True), ("/nest", False), ("/nests/3", False), ("/nest/opening", True), ("/eggs/3/raw", False), ("/eggs/3/raw/x", True), ("/reeds", True)):
        assert robots.allowed(r, path) is ok
    assert robots.allowed(robots.parse(None), "/nest")
    assert robots.lines("Who: me # c\rwhat :  7\r\n\nno colon") == [("who", "me"), ("what", "7")]


def test_robots_rules(spark):
    rule = lambda p: robots.pattern_rule(p, False)
    assert rule("/mud") == (False, "/mud", (), False)
    assert rule("/%6Dud+1") == (False, "/mud 1", (), False)
    assert rule("*") == (False, "", ("",), False)
    assert rule("/fish*") == (False, "/fish", (), False)
    assert rule("/a*b*c$") == (False, "/a", ("b", "c"), True)
    assert rule("") == (False, "", (), False)
    assert rule("/%g1") is None
    cases = [
        ("/mud", "/mudflat", True), ("/mud", "/Mud", False), ("/%6Dud", "/mud", True), ("*scale", "/fish/scales", True), ("/f*h*s", "/fresh/s", True), ("/f*h*s", "/fish", False),
        ("/mud$", "/mud", True), ("/mud$", "/mudflat", False), ("*.xml$", "/pond.xml", True), ("*.xml$", "/pond.xml?x", False), ("*ab$", "/abab", False), ("", "/any", True),
    ]
    for pattern, path, ok in cases:
        assert robots.matches(rule(pattern), path) is ok, (pattern, path)
        assert spark.range(1).select(F.lit(path).rlike(robots.rule_regex(rule(pattern)))).first()[0] is ok


def test_walk():
    seen = []
    walk(parse("<body><nav><a>x</a></nav><p>y</p></body>").children[1], lambda e: seen.append(e.tag) or e.tag == "nav")
    assert seen == ["body", "nav", "p", None]

"""The core queries and their SQL. Each callable takes (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from websift.functions import html, keys, robots, urls
from websift.functions.text import escape_html, limit_text
from websift.operators import decide, links, postings, rank, search, state
from websift.schema import STATE_NAMES
from websift.sources.tables import fake_store, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Words -----------------------------------------------------------------------------------------------------------------

def _words_sql(table: str, key: str, text: str = "text") -> str:
    return f"""w AS (SELECT k, lower(raw) AS word FROM (SELECT {key} AS k, unnest(regexp_split_to_array({text}, '[^\\p{{L}}\\p{{N}}-]+')) AS raw FROM {table})
        WHERE strlen(raw) >= 3 AND replace(raw, raw[1], '') <> '')"""


DOC_WORDS = _words_sql("documents", "doc_id")


def _doc_postings(spark: SparkSession, d: str) -> DataFrame:
    return postings.postings(read(spark, d, "documents").select("doc_id", "text"), "doc_id")


@query(f"WITH {DOC_WORDS} SELECT word, count(*) AS n FROM w GROUP BY word")
def vocab_count(spark: SparkSession, d: str) -> DataFrame:
    return postings.vocabulary(read(spark, d, "documents"))


@query(f"WITH {DOC_WORDS} SELECT count(*) AS n_tokens, count(DISTINCT word) AS n_words FROM w")
def vocab_totals(spark: SparkSession, d: str) -> DataFrame:
    return postings.vocabulary_totals(vocab_count(spark, d))


@query(f"WITH {DOC_WORDS} SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 100")
def vocab_top100(spark: SparkSession, d: str) -> DataFrame:
    return postings.top_words(vocab_count(spark, d))


@query(f"WITH {DOC_WORDS} SELECT word, k AS doc_id, count(*)::DOUBLE AS tf FROM w GROUP BY word, k")
def doc_postings(spark: SparkSession, d: str) -> DataFrame:
    return _doc_postings(spark, d)


@query(f"""WITH {DOC_WORDS}, p AS (SELECT word, k, count(*)::BIGINT AS tf, count(*) OVER (PARTITION BY word) AS df FROM w GROUP BY word, k),
    b AS (SELECT *, CASE WHEN df > 50000 THEN left(sha256(k::VARCHAR), ceil(ln(df / 50000) / ln(16))::INTEGER) ELSE '' END AS bucket FROM p)
    SELECT word, bucket, count(*) AS n_items, string_agg(k::VARCHAR || ':' || tf::VARCHAR, ' ' ORDER BY k) AS items FROM b GROUP BY word, bucket""")
def posting_lists(spark: SparkSession, d: str) -> DataFrame:
    lists = postings.posting_lists(_doc_postings(spark, d), "doc_id")
    item = lambda x: F.concat(x["doc_id"].cast("string"), F.lit(":"), x["f32"].cast("long").cast("string"))
    return lists.select("word", "bucket", F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", item), " ").alias("items"))


@query(f"WITH {DOC_WORDS} SELECT word, count(DISTINCT k) AS df FROM w GROUP BY word")
def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    return postings.document_frequency(_doc_postings(spark, d))


@query(f"""WITH {_words_sql("nodes", "page_id")} SELECT word, k AS page_id, count(*)::DOUBLE AS tf FROM w GROUP BY word, k""")
def node_postings(spark: SparkSession, d: str) -> DataFrame:
    return postings.postings(read(spark, d, "nodes").select("page_id", "text"), "page_id")


@query("SELECT page_id, count(*) AS n_nodes, max(node_depth) AS depth, count(text) AS n_texts FROM nodes GROUP BY page_id")
def node_tree(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nodes").groupBy("page_id").agg(F.count("*").alias("n_nodes"), F.max("node_depth").alias("depth"), F.count("text").alias("n_texts"))


# Search ----------------------------------------------------------------------------------------------------------------

#: The words of the searches; the rank of a document is 1 / its number of characters.
ASK = "the valley"
RANKS = "r AS (SELECT doc_id, 1.0::DOUBLE / n_chars AS rank FROM documents WHERE n_chars > 0)"
HITS = f"""WITH {DOC_WORDS}, p AS (SELECT word, k, count(*)::DOUBLE AS tf FROM w WHERE word IN ('the', 'valley') GROUP BY word, k), {RANKS},
    h AS (SELECT a.k AS doc_id, a.tf FROM p a WHERE a.word = 'the' AND a.k IN (SELECT k FROM p WHERE word = 'valley')),
    s AS (SELECT h.doc_id, round(h.tf + coalesce(r.rank, 0), 9) AS score FROM h LEFT JOIN r USING (doc_id))"""


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("n_chars > 0").select("doc_id", (F.lit(1.0) / F.col("n_chars")).alias("rank"))


def _hits(spark: SparkSession, d: str, ask: str = ASK) -> DataFrame:
    terms = search.parse_query(ask)
    # The words asked for are filtered before they are counted.
    words = postings.words(read(spark, d, "documents"), "doc_id").where(F.col("word").isin(sorted(set(terms))))
    posts = words.groupBy("word", "doc_id").agg(F.count("*").cast("double").alias("tf"))
    scored = search.score(search.retrieve(terms, posts, "doc_id"), _ranks(spark, d), "doc_id")
    return scored.select("doc_id", F.round("score", 9).alias("score"))


@query("SELECT 'hello' AS word, 0 AS position UNION ALL SELECT 'aab-1', 1 UNION ALL SELECT 'éa', 2")
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = search.parse_query(" \t HELLO aaa zz\n AAB-1, 7 Éa!")
    return spark.createDataFrame(list(enumerate(terms)), "position int, word string").select("word", "position")


@query(HITS.replace("h AS (SELECT a.k AS doc_id, a.tf FROM p a WHERE a.word = 'the' AND a.k IN (SELECT k FROM p WHERE word = 'valley'))", "h AS (SELECT k AS doc_id, tf FROM p WHERE word = 'valley')") + " SELECT * FROM s")
def search_one(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "Valley")


@query(HITS + " SELECT * FROM s")
def search_and(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d)


@query(HITS + " SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 10 OFFSET 10")
def search_page1(spark: SparkSession, d: str) -> DataFrame:
    return search.page_of(_hits(spark, d), 1, "doc_id")


@query(HITS + ", t AS (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 10) SELECT t.doc_id, t.score, p.url, m.title, m.description FROM t JOIN pages p ON p.page_id = t.doc_id JOIN page_meta m ON m.page_id = t.doc_id")
def search_results(spark: SparkSession, d: str) -> DataFrame:
    top = F.broadcast(search.page_of(_hits(spark, d), 0, "doc_id").withColumnRenamed("doc_id", "page_id"))  # ten rows
    pages = read(spark, d, "pages").select("page_id", "url").join(top, "page_id")
    return read(spark, d, "page_meta").select("page_id", "title", "description").join(F.broadcast(pages), "page_id").select(F.col("page_id").alias("doc_id"), "score", "url", "title", "description")


@query(HITS + " SELECT count(*) AS n, ceil(count(*) / 10)::BIGINT AS chunks FROM s")
def search_counts(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).agg(F.count("*").alias("n"), F.ceil(F.count("*") / 10).alias("chunks"))


@query("SELECT 'Stone ' || i AS title, 100.0::DOUBLE - i AS score FROM range(10, 20) t(i)")
def search_51_pages(spark: SparkSession, d: str) -> DataFrame:
    s = fake_store(spark)
    hits = search.score(search.retrieve(search.parse_query("Pebble?"), s["postings"]), s["rank"])
    return search.page_of(hits, 1).join(s["pages"], "page_key").select("title", "score")


# Pages -----------------------------------------------------------------------------------------------------------------

BODY = r"""regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)', 1), '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<[^>]*>', ' ', 'g'),
    '&(amp|lt|gt|quot|nbsp|copy|middot|#39|#x27|#[0-9]+|hellip|ndash|mdash|raquo|laquo);', ' ', 'g')"""


@query(f"""WITH {_words_sql(f"(SELECT page_id, {BODY} AS body FROM pages)", "page_id", "body")} SELECT word, k AS page_id, count(*)::DOUBLE AS tf FROM w GROUP BY word, k""")
def page_text_postings(spark: SparkSession, d: str) -> DataFrame:
    return postings.postings(html.parse_pages(read(spark, d, "pages"), columns=("body_text",)).select("page_id", "body_text"), "page_id", "body_text")


UNESCAPE = "replace(replace(replace(replace(replace({}, '&#x27;', ''''), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query(f"SELECT page_id, {UNESCAPE.format("regexp_extract(html, '(?s)<html lang=\"([^\"]*)\"', 1)")} AS lang, {UNESCAPE.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title FROM pages")
def page_heads(spark: SparkSession, d: str) -> DataFrame:
    return html.parse_pages(read(spark, d, "pages"), columns=("meta",)).select("page_id", "meta.lang", "meta.title")


@query(f"SELECT page_id, {UNESCAPE.format('href')} AS href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*?href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY ALL")
def page_hrefs(spark: SparkSession, d: str) -> DataFrame:
    parsed = html.parse_pages(read(spark, d, "pages"), columns=("hrefs",)).select("page_id", F.explode("hrefs").alias("href"))
    return parsed.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("SELECT page_id, url FROM pages JOIN page_meta USING (page_id) WHERE NOT no_index AND lower(langage) IN ('fr', 'fr-fr')")
def page_lang_filter(spark: SparkSession, d: str) -> DataFrame:
    kind = decide.page_decision(F.col("no_index"), [~F.coalesce(F.lower("langage").isin("fr", "fr-fr"), F.lit(False))])
    keep = read(spark, d, "page_meta").where(kind == 4).select("page_id")
    return read(spark, d, "pages").select("page_id", "url").join(keep, "page_id")


@query(r"""SELECT page_id, CASE WHEN path IN ('/robots.txt', '/favicon.ico') THEN -1 WHEN host LIKE 'shop.%' THEN 130 WHEN no_index THEN 133
    WHEN NOT coalesce(lower(langage) LIKE 'fr%', false) THEN 131 ELSE 4 END AS decision
    FROM (SELECT page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host FROM pages) JOIN page_meta USING (page_id)""")
def crawl_decision(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages").select("page_id", "url").join(read(spark, d, "page_meta").select("page_id", "no_index", "langage"), "page_id")
    host = F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1))
    before = decide.url_decision(F.col("url"), [host.like("shop.%")], F.lit(True))
    after = decide.page_decision(F.col("no_index"), [~F.coalesce(F.lower("langage").like("fr%"), F.lit(False))])
    return pages.select("page_id", F.coalesce(before, after).alias("decision"))


@query("SELECT page_id, no_follow, count(*) AS n FROM page_meta JOIN nodes USING (page_id) WHERE tag = 'a' AND NOT no_follow AND NOT no_index GROUP BY ALL")
def follow_links(spark: SparkSession, d: str) -> DataFrame:
    ok = read(spark, d, "page_meta").where("not no_follow and not no_index").select("page_id", "no_follow")
    anchors = read(spark, d, "nodes").where("tag = 'a'").groupBy("page_id").agg(F.count("*").alias("n"))
    return anchors.join(ok, "page_id").select("page_id", "no_follow", "n")


# URLs and keys ---------------------------------------------------------------------------------------------------------

@query("SELECT page_id, sha256(url) AS url_key, sha256(url) < repeat('8', 64) AS low FROM pages")
def url_keys(spark: SparkSession, d: str) -> DataFrame:
    k = keys.key_hex(F.col("url"))
    return read(spark, d, "pages").select("page_id", k.alias("url_key"), (k < F.lit("8" * 64)).alias("low"))


QUEUE = r"lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || ':' || regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), '^.*@', ''), ':$', '')"


@query(f"SELECT {QUEUE} AS queue, count(DISTINCT url) AS n, min(url) AS first_url, max(url) AS last_url FROM pages GROUP BY queue")
def host_queues(spark: SparkSession, d: str) -> DataFrame:
    return decide.host_queues(read(spark, d, "pages"))


def _parts_sql(table: str, url: str = "url") -> str:
    """Scheme, host, path and sorted query of a column of URLs."""
    return f"""SELECT *, lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host,
        regexp_extract({url}, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path, array_to_string(list_sort(string_split(regexp_extract({url}, '\\?([^#]*)', 1), '&')), '&') AS q FROM {table}"""


CLEANED = "scheme || '://' || host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END"
EXPANDED = f"""unnest(list_concat([{CLEANED}, scheme || '://' || host || path],
        list_transform(list_filter(range(1, length(path) + 1), lambda i: path[i] = '/'), lambda i: scheme || '://' || host || path[1:i]),
        list_transform(range(CASE WHEN contains(host, ':') THEN 0 ELSE 1 END, greatest(len(string_split(split_part(host, ':', 1), '.')) - 1, 1)), lambda i: scheme || '://' || array_to_string(string_split(split_part(host, ':', 1), '.')[i + 1:], '.') || '/'),
        [scheme || '://www.' || array_to_string(string_split(split_part(host, ':', 1), '.')[-2:], '.') || '/']))"""


@query(f"SELECT page_id, {CLEANED} AS url FROM ({_parts_sql('pages')})")
def url_clean(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", urls.clean_url("url").alias("url"))


@query(f"SELECT DISTINCT {EXPANDED} AS url FROM ({_parts_sql('pages')})")
def url_parents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select(F.explode(urls.expand_url("url")).alias("url")).distinct()


RESOLVED = f"""(SELECT page_id, CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '/%' THEN regexp_extract(base, '^[^:]*://[^/?#]*') || href WHEN href = '#' THEN base END AS link
    FROM (SELECT page_id, url AS base, {UNESCAPE.format('href')} AS href FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1)) AS href FROM pages)))"""


@query(f"SELECT DISTINCT page_id, {EXPANDED} AS link FROM ({_parts_sql(RESOLVED, 'link')})")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Resolved links with their parents, each once a page."""
    return html.parse_pages(read(spark, d, "pages"), columns=("hrefs",)).select("page_id", F.explode(urls.links_of("url", "hrefs")).alias("link"))


@query("SELECT page_id, CASE WHEN strlen(title) <= 50 THEN title WHEN length(title) > 50 THEN title[1:50] || '...' ELSE title END AS short FROM page_meta")
def limit_title(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "page_meta").select("page_id", limit_text(F.col("title"), 50).alias("short"))


@query("SELECT page_id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '''', '&#39;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;') AS title FROM page_meta")
def escape_title(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "page_meta").select("page_id", escape_html(F.col("title")).alias("title"))


@query("SELECT host_name, least(greatest(coalesce(crawl_delay, 0)::DOUBLE, 0.5), 10) AS delay FROM sites")
def crawl_delays(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "sites").select("host_name", decide.clamp_delay(F.col("crawl_delay")).alias("delay"))


ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /2018/\nDisallow: /20\nDisallow: /~ # homes\nCrawl-delay: 2\nDisallow: /en/\nAllow: /en/1\nSitemap: https://example.com/sitemap.xml\n"


@query("""SELECT * FROM (VALUES (0, false, '/~'), (1, true, '/en/1'), (2, false, '/en/'), (3, true, '/2018/'), (4, false, '/20')) t(position, allow, prefix)""")
def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    file = spark.createDataFrame([(ROBOTS,)], "content string").select(robots.parse_robots("content").alias("r"))
    return file.select(F.posexplode("r.rules").alias("position", "rule")).select("position", "rule.allow", F.col("rule.first").alias("prefix"))


TARGET = r"regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) || regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"


@query(f"""SELECT page_id, CASE WHEN starts_with(t, '/~') THEN false WHEN starts_with(t, '/en/1') THEN true WHEN starts_with(t, '/en/') THEN false
    WHEN starts_with(t, '/2018/') THEN true WHEN starts_with(t, '/20') THEN false ELSE true END AS allowed FROM (SELECT page_id, {TARGET} AS t FROM pages)""")
def robots_allow(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", robots.robots_allow(F.lit(ROBOTS), urls.path_and_query(F.col("url"))).alias("allowed"))


@query(SQL["robots_allow"])
def robots_allow_native(spark: SparkSession, d: str) -> DataFrame:
    """The same decision inside the JVM: rules as regular expressions with atomic groups, first match in rule order."""
    target = urls.path_and_query(F.col("url"))
    allow = F.lit(True)
    for r in reversed(robots.parse(ROBOTS).rules):
        allow = F.when(target.rlike(robots.rule_regex(r)), F.lit(r.allow)).otherwise(allow)
    return read(spark, d, "pages").select("page_id", allow.alias("allowed"))


# States ----------------------------------------------------------------------------------------------------------------

CURRENT = "l AS (SELECT DISTINCT * FROM url_states), c AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY seq DESC) = 1), s AS (SELECT * FROM c WHERE state_type <> 0)"


def _current(spark: SparkSession, d: str) -> DataFrame:
    return state.current(read(spark, d, "url_states"))


@query(f"WITH {CURRENT} SELECT url_key, seq, state_type, state_time, dest_key, blob_position, blob_length FROM s")
def state_current(spark: SparkSession, d: str) -> DataFrame:
    return _current(spark, d).select("url_key", "seq", "state_type", "state_time", "dest_key", "blob_position", "blob_length")


NAMES = "CASE state_type " + " ".join(f"WHEN {code} THEN '{name}'" for code, name in STATE_NAMES.items()) + " ELSE 'type' || state_type END"


@query(f"""WITH {CURRENT}, g AS (SELECT state_type, count(*) AS n, sum(CASE WHEN state_type >= 3 AND state_type < 128 THEN coalesce(blob_length, 0) ELSE 0 END)::BIGINT AS bytes FROM s GROUP BY state_type)
    SELECT state_type, {NAMES} AS name, n, (n * 100 // (SELECT sum(n) FROM g))::BIGINT AS percent, bytes, coalesce(bytes * 100 // nullif((SELECT sum(bytes) FROM g), 0), 0)::BIGINT AS percent_bytes FROM g""")
def state_stats(spark: SparkSession, d: str) -> DataFrame:
    return state.statistics(_current(spark, d))


@query(f"""WITH {CURRENT} SELECT count(*) AS total, count(*) FILTER (state_type >= 3 AND state_type < 128) AS total_file, count(*) FILTER (state_type >= 128) AS total_error,
    coalesce(sum(blob_length) FILTER (state_type >= 3 AND state_type < 128), 0)::BIGINT AS total_bytes, count(*) FILTER (state_type = 4) AS n_html FROM s""")
def state_totals(spark: SparkSession, d: str) -> DataFrame:
    return state.totals(_current(spark, d))


@query(f"WITH {CURRENT} SELECT url_key FROM s WHERE state_type = 1")
def known_keys(spark: SparkSession, d: str) -> DataFrame:
    return state.known(_current(spark, d))


@query(f"WITH {CURRENT} SELECT DISTINCT sha256(url) AS url_key FROM pages WHERE sha256(url) NOT IN (SELECT url_key FROM s)")
def new_keys(spark: SparkSession, d: str) -> DataFrame:
    found = read(spark, d, "pages").select(keys.key_hex(F.col("url")).alias("url_key"))
    return state.unknown(found, _current(spark, d))


@query(f"WITH {CURRENT} SELECT p.page_id, s.state_time FROM pages p JOIN s ON s.url_key = sha256(p.url) WHERE s.state_type = 4")
def html_scan(spark: SparkSession, d: str) -> DataFrame:
    entries = state.html_entries(_current(spark, d)).select("url_key", "state_time")
    return read(spark, d, "pages").select("page_id", keys.key_hex(F.col("url")).alias("url_key")).join(entries, "url_key").select("page_id", "state_time")


@query(f"""WITH {CURRENT}, k AS (SELECT DISTINCT sha256(url) AS url_key FROM pages)
    SELECT k.url_key, CASE WHEN s.state_type IS NULL THEN 'notExist' WHEN s.state_type >= 3 AND s.state_type < 128 THEN 'ok' ELSE 'notFile' END AS status,
    CASE WHEN s.state_type >= 3 AND s.state_type < 128 THEN s.state_time END AS state_time FROM k LEFT JOIN s USING (url_key)""")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "pages").select(keys.key_hex(F.col("url")).alias("url_key")).distinct()
    return state.lookup(asked, _current(spark, d))


@query(f"""WITH RECURSIVE {CURRENT}, walk AS (SELECT url_key, dest_key AS here, 1 AS i FROM s WHERE state_type = 2
    UNION ALL SELECT w.url_key, s.dest_key, i + 1 FROM walk w JOIN s ON s.url_key = w.here WHERE s.state_type = 2 AND i < 10)
    SELECT w.url_key, s.url_key AS target FROM walk w JOIN s ON s.url_key = w.here WHERE s.state_type >= 3 AND s.state_type < 128 AND i < 10""")
def redirect_targets(spark: SparkSession, d: str) -> DataFrame:
    return state.redirect_targets(_current(spark, d))


# Links and rank --------------------------------------------------------------------------------------------------------

GRAPH = """e0 AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem),
    n AS (SELECT DISTINCT l_partkey AS page_key FROM lineitem), e AS (SELECT src, dst FROM e0 WHERE dst IS NOT NULL AND src <> dst AND dst IN (SELECT page_key FROM n)),
    w AS (SELECT src, dst, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY src) AS w FROM e GROUP BY src, dst)"""


def _rank_sql(steps: int) -> str:
    out = f"WITH {GRAPH}, r0 AS (SELECT page_key, 1.0::DOUBLE AS rank FROM n)"
    for k in range(1, steps + 1):
        out += f", r{k} AS (SELECT n.page_key, coalesce(g.x, 0) AS rank FROM n LEFT JOIN (SELECT w.dst AS page_key, sum(r.rank * w.w) AS x FROM w JOIN r{k - 1} r ON r.page_key = w.src GROUP BY w.dst) g USING (page_key))"
    return out


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return links.build(items.select(F.col("l_partkey").alias("src"), nxt.alias("dst"))), items.select(F.col("l_partkey").alias("page_key")).distinct()


@query(f"WITH {GRAPH} SELECT src, dst, count(*) AS n FROM e GROUP BY src, dst")
def link_filter(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = _graph(spark, d)
    return links.keep_known(edges, nodes).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {CURRENT}, r AS (SELECT url_key AS src, dest_key AS dst FROM s WHERE state_type = 2), e AS (SELECT sha256(a.url) AS src, sha256(b.url) AS dst FROM pages a JOIN pages b ON b.page_id = a.page_id + 7) SELECT e.src, coalesce(r.dst, e.dst) AS dst FROM e LEFT JOIN r ON r.src = e.dst")
def link_redirects(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "pages").select((F.col("page_id") + 7).alias("page_id"), keys.key_hex(F.col("url")).alias("src"))
    b = read(spark, d, "pages").select("page_id", keys.key_hex(F.col("url")).alias("dst"))
    moved = _current(spark, d).where("state_type = 2").select(F.col("url_key").alias("src"), F.col("dest_key").alias("dst"))
    return links.build(a.join(b, "page_id"), moved)


@query(f"WITH {GRAPH}, o AS (SELECT page_key, count(src) AS degree FROM n LEFT JOIN e ON src = page_key GROUP BY page_key), h AS (SELECT degree, count(*) AS n FROM o GROUP BY degree) SELECT x AS degree, coalesce(n, 0) AS n FROM range(0, (SELECT max(degree) + 1 FROM h)) t(x) LEFT JOIN h ON degree = x")
def outdegree_hist(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = _graph(spark, d)
    return links.degree_histogram(links.keep_known(edges, nodes), nodes)


@query(_rank_sql(1) + " SELECT page_key, round(rank, 6) AS rank FROM r1")
def rank_1(spark: SparkSession, d: str) -> DataFrame:
    return rank.iterate(*_graph(spark, d), 1).select("page_key", F.round("rank", 6).alias("rank"))


@query(_rank_sql(5) + " SELECT page_key, round(rank, 6) AS rank FROM r5")
def rank_5(spark: SparkSession, d: str) -> DataFrame:
    return rank.iterate(*_graph(spark, d), 5).select("page_key", F.round("rank", 6).alias("rank"))


@query(_rank_sql(5) + " SELECT page_key, round(rank, 6) AS rank, 'part:' || page_key AS url FROM r5 ORDER BY round(rank, 6) DESC, page_key LIMIT 30")
def rank_top30(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = _graph(spark, d)
    ranks = rank.iterate(edges, nodes, 5).select("page_key", F.round("rank", 6).alias("rank"))
    return rank.top_pages(ranks, nodes.withColumn("url", F.concat(F.lit("part:"), "page_key")))


@query(_rank_sql(2) + " SELECT round(sum(pow(a.rank - b.rank, 2)), 5) AS norm FROM r1 a JOIN r2 b USING (page_key)")
def rank_norm(spark: SparkSession, d: str) -> DataFrame:
    _, one, two = rank.steps(*_graph(spark, d), 2)
    return rank.squared_distance(one, two).select(F.round("norm", 5).alias("norm"))


from websift import queries_store  # noqa: E402, F401  registers its queries

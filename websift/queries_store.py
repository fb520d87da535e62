"""Queries of the store, the fetcher, the crawl, the robots rules and the renderers, with their SQL."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from websift import schema as S
from websift.functions import html, keys, render, robots, urls
from websift.functions.text import escape_html
from websift.operators import decide, links, rank, search, state
from websift.plans.crawl import CrawlConfig, Store, crawl, plan
from websift.queries import ASK, CURRENT, GRAPH, HITS, _doc_postings, _graph, _hits, _rank_sql, query
from websift.session import shared_folder
from websift.sources import binary, logs
from websift.sources.fetch import Response, fetch, fetch_following, redirect_location
from websift.sources.tables import memory_store, process, read, url_list
from websift.streaming import stats

T0 = datetime(2026, 1, 1)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _rows(rows: list[tuple]) -> str:
    """VALUES of a small table."""
    say = lambda v: "NULL" if v is None else str(v) if isinstance(v, bool | int | float) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows) + ")"


# Store -----------------------------------------------------------------------------------------------------------------

LAST = "SELECT url_key, state_type, state_time FROM s"


@query(f"WITH {CURRENT} {LAST}")
def store_states(spark: SparkSession, d: str) -> DataFrame:
    """A store opened, filled in two appends, compacted between them, and opened again."""
    log, folder = read(spark, d, "url_states"), _folder(spark, "store")
    store = Store(spark, folder)
    half = log.agg(F.floor(F.avg("seq"))).first()[0]
    store.append("state", log.where(F.col("seq") <= half))
    store.compact(half)
    store.append("state", log.where(F.col("seq") > half))
    both = store.current().unionByName(Store(spark, folder).current()).groupBy("url_key", "state_type", "state_time").agg(F.count("*").alias("k"))
    return both.where("k = 2").drop("k")


@query(f"WITH {CURRENT}, m AS (SELECT url_key FROM s WHERE state_type <> 4) SELECT DISTINCT url FROM pages WHERE sha256(url) NOT IN (SELECT url_key FROM m)")
def store_known_urls(spark: SparkSession, d: str) -> DataFrame:
    """The store knows the states of all but pages; the pages' URLs are added: those without a state become known."""
    store = Store(spark, _folder(spark, "store"))
    store.append("state", state.current(read(spark, d, "url_states")).where(F.col("state_type") != S.FILE_HTML))
    store.add_unknown(read(spark, d, "pages").select("url"), 1 << 40)
    return store.known_urls().join(read(spark, d, "pages").select("url").distinct(), "url", "left_semi").select("url")


MEMORY = [(1, "a", 1), (2, "b", 4), (3, "a", 0), (4, "c", 2), (5, "b", 131), (5, "b", 131), (6, "c", 4), (0, "c", 0)]


@query("SELECT * FROM (VALUES ('b', 131), ('c', 4)) t(url_key, state_type)")
def memory_states(spark: SparkSession, d: str) -> DataFrame:
    rows = [(seq, key, kind, T0, None, None, None) for seq, key, kind in MEMORY]
    return state.current(memory_store(spark, rows)).select("url_key", F.col("state_type").cast("int").alias("state_type"))


def _with_digest(log: DataFrame) -> DataFrame:
    """The log with the digest that the binary format keeps: the target of a redirect, else the last 20 bytes of a hash of the key."""
    digest = F.when(F.col("state_type") == S.REDIRECT, F.col("dest_key")).when(S.is_file(F.col("state_type")), F.right(F.sha2("url_key", 256), F.lit(40)))
    return log.withColumn("digest", digest)


@query(f"""WITH {CURRENT} SELECT url_key, state_type::INTEGER AS state_type, CASE WHEN state_type < 2 THEN 0 ELSE epoch(date_trunc('second', state_time))::BIGINT END AS seconds,
    CASE WHEN state_type = 2 THEN dest_key END AS dest_key, CASE WHEN state_type >= 3 AND state_type < 128 THEN blob_length END AS blob_length,
    CASE WHEN state_type = 2 THEN dest_key WHEN state_type >= 3 AND state_type < 128 THEN right(sha256(url_key), 40) END AS digest FROM s""")
def state_log_files(spark: SparkSession, d: str) -> DataFrame:
    """The state log written to binary files in seq order, read back and folded: the last record of the last file counts."""
    folder = _folder(spark, "log")
    binary.write_state_log(_with_digest(read(spark, d, "url_states").distinct()), folder)
    log = binary.load_state_log(spark, folder)
    last = log.groupBy("url_key").agg(F.max_by(F.struct("state_type", "state_time", "dest_key", "blob_length", "digest"), "seq").alias("x")).select("url_key", "x.*").where("state_type <> 0")
    return last.select("url_key", F.col("state_type").cast("int").alias("state_type"), F.unix_timestamp("state_time").alias("seconds"), "dest_key", "blob_length", "digest")


RECORDS = [(0, 0, "", 33), (1, 0, "", 33), (128, 9, "", 40), (133, 1_700_000_001, "", 40), (2, 5, "ab", 72), (4, 6, "cd", 72), (7, 7, "ef", 72)]


@query(f"SELECT k AS state_type, n AS bytes, CASE WHEN k < 2 THEN 0 ELSE t END AS seconds, CASE WHEN k = 2 THEN repeat(x, 32) WHEN k IN (4, 7) THEN repeat(x, 20) END AS digest FROM {_rows(RECORDS)} r(k, t, x, n)")
def state_record_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Records of each kind encoded and decoded."""
    out = []
    for kind, time, digit, _ in RECORDS:
        data = binary.state_record(bytes(32), kind, time, bytes.fromhex(digit * 32), 3, 4)
        (r,) = binary.state_records(data)
        out.append((r["state_type"], len(data), r["time"], r["digest"]))
    return spark.createDataFrame(out, "state_type int, bytes int, seconds int, digest string")


@query(f"WITH {CURRENT}, u AS (SELECT DISTINCT url FROM pages) SELECT url FROM u JOIN s ON s.url_key = sha256(url) WHERE state_type IN (1, 4, 130)")
def url_list_accepted(spark: SparkSession, d: str) -> DataFrame:
    """A text file of URLs and other lines, by the states that are accepted."""
    lines = read(spark, d, "pages").select(F.col("url").alias("value")).distinct().unionByName(read(spark, d, "page_meta").select(F.col("title").alias("value")).where("value is not null"))
    return url_list(lines, state.current(read(spark, d, "url_states")), [S.KNOW, S.FILE_HTML, S.ERROR_FILTER_URL]).select("url")


@query("SELECT 'bytes' AS name, sum(strlen(html))::BIGINT AS value FROM pages UNION ALL SELECT 'hosts', count(DISTINCT regexp_extract(url, '://([^/?#]*)', 1)) FROM pages UNION ALL SELECT 'pages', count(*) FROM pages")
def scan_processors(spark: SparkSession, d: str) -> DataFrame:
    """One scan feeds three processors."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    processors = {"pages": lambda p: p.agg(F.count("*").alias("value")), "bytes": lambda p: p.agg(F.sum(F.octet_length("html")).alias("value")), "hosts": lambda p: p.agg(F.count_distinct(host).alias("value"))}
    out = process(read(spark, d, "pages").select("url", "html"), processors)
    scan = out.pop("scan")
    rows = [(name, df.first()["value"]) for name, df in out.items()]
    scan.unpersist()
    return spark.createDataFrame(rows, "name string, value long")


@query(f"""WITH {CURRENT}, k AS (SELECT DISTINCT sha256(url) AS url_key FROM pages), v AS (SELECT sha256(url) AS url_key, max(html) AS html FROM pages WHERE html NOT LIKE '%<blockquote>%' GROUP BY 1),
    o AS (SELECT DISTINCT sha256(url) AS url_key FROM pages WHERE html LIKE '%<blockquote>%'), x AS (SELECT k.url_key, state_type, html FROM k LEFT JOIN s USING (url_key) LEFT JOIN (SELECT * FROM v WHERE url_key NOT IN (SELECT url_key FROM o)) USING (url_key))
    SELECT url_key, CASE WHEN state_type IS NULL THEN 'notExist' WHEN state_type NOT BETWEEN 3 AND 127 THEN 'notFile' WHEN html IS NULL THEN 'damaged' ELSE 'ok' END AS status,
    CASE WHEN state_type BETWEEN 3 AND 127 THEN strlen(html) END AS bytes FROM x""")
def lookup_values(spark: SparkSession, d: str) -> DataFrame:
    """The stored page of every URL, with its digest checked; the digests of pages with a quotation are wrong ones."""
    key = keys.key_hex(F.col("url")).alias("url_key")
    pages = read(spark, d, "pages").select(key, "html")
    contents = pages.groupBy("url_key").agg(F.max("html").alias("content"), F.max(F.col("html").contains("<blockquote>")).alias("quoted"))
    contents = contents.select("url_key", "content", F.sha2(F.when(F.col("quoted"), F.lit("?")).otherwise(F.col("content")), 256).alias("digest"))
    got = state.values(pages.select("url_key").distinct(), state.current(read(spark, d, "url_states")), contents)
    return got.select("url_key", "status", F.octet_length("content").cast("long").alias("bytes"))


@query(f"""WITH {CURRENT} SELECT url_key, CASE WHEN state_type = 4 THEN 131 WHEN state_type = 2 THEN 2 ELSE 4 END AS state_type, CASE WHEN state_type = 2 THEN url_key END AS dest_key,
    CASE WHEN state_type <> 4 AND state_type <> 2 THEN 7 END AS blob_length FROM s WHERE state_type < 128""")
def state_changes(spark: SparkSession, d: str) -> DataFrame:
    """Pages become filtered, redirects lead to themselves, errors are deleted, other keys get a page."""
    log = read(spark, d, "url_states")
    now = state.current(log)
    kind = F.col("state_type")
    files = now.where((kind != S.FILE_HTML) & (kind != S.REDIRECT) & (kind < 128)).select("url_key", F.lit(0).alias("blob_position"), F.lit(7).alias("blob_length"))
    changes = [state.set_simple(now.where(kind == S.FILE_HTML).select("url_key"), S.ERROR_FILTER_PAGE, 1 << 40), state.set_redirect(now.where(kind == S.REDIRECT).select("url_key", F.col("url_key").alias("dest_key")), 1 << 41)]
    changes += [state.set_simple(now.where(kind >= 128).select("url_key"), S.NOTHING, 1 << 42), state.set_value(files, S.FILE_HTML, 1 << 43)]
    for c in changes:
        log = log.select(*c.columns).unionByName(c)
    return state.current(log).select("url_key", kind.cast("int").alias("state_type"), "dest_key", "blob_length")


WORDS = "w AS (SELECT k, lower(raw) AS word FROM (SELECT doc_id AS k, unnest(regexp_split_to_array(text, '[^\\p{L}\\p{N}-]+')) AS raw FROM documents) WHERE strlen(raw) >= 3 AND replace(raw, raw[1], '') <> '')"


@query(f"WITH {WORDS} SELECT sha256(word) AS word_key, sha256(k::VARCHAR) AS page_key, count(*)::DOUBLE AS tf FROM w GROUP BY word, k")
def index_files(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index written to key/value files and read back."""
    folder = _folder(spark, "index")
    binary.write_index(_doc_postings(spark, d).select(keys.key_hex(F.col("word")).alias("word_key"), keys.key_hex(F.col("doc_id").cast("string")).alias("page_key"), "tf"), folder)
    return binary.load_index(spark, folder).select("word_key", "page_key", F.col("tf").cast("double").alias("tf"))


@query("SELECT sha256(doc_id::VARCHAR) AS page_key, (n_chars / 4.0)::FLOAT::DOUBLE AS rank FROM documents WHERE n_chars IS NOT NULL")
def rank_files(spark: SparkSession, d: str) -> DataFrame:
    """Ranks written to key/value files and read back."""
    folder = _folder(spark, "rank")
    ranks = read(spark, d, "documents").where("n_chars is not null").select(keys.key_hex(F.col("doc_id").cast("string")).alias("page_key"), (F.col("n_chars") / 4).alias("rank"))
    binary.write_rank(ranks, folder)
    return binary.load_rank(spark, folder).select("page_key", F.col("rank").cast("double").alias("rank"))


# Fetching --------------------------------------------------------------------------------------------------------------

def _mirror():  # noqa: ANN202
    """A transport that answers by the URL alone; a function of its own, so that it is sent to the workers by value."""
    from websift.sources.fetch import Response

    def transport(url: str) -> Response:
        if "?" in url:
            return Response(302, b"", url.partition("?")[0])
        if "/~" in url:
            raise OSError("no route")
        if url.endswith("/"):
            return Response(404)
        return Response(200, url.encode())

    return transport


FETCHED = """CASE WHEN contains(url, '?') THEN 'redirect ' || lower(split_part(url, '://', 1)) || '://' || split_part(split_part(url, '://', 2), '?', 1) WHEN contains(url, '/~') THEN 'error no route' WHEN url LIKE '%/' THEN 'error status 404' ELSE 'body ' || left(url, 60) END"""


@query(f"SELECT DISTINCT url, {FETCHED} AS got FROM pages")
def fetch_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every URL fetched over a transport that answers by the URL, bodies cut at 60 bytes."""
    transport = _mirror()

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            got = [fetch(transport, u, 60) for u in b.url]
            yield b.assign(got=[f"body {g.body.decode()}" if g.body is not None else f"redirect {g.redirect}" if g.redirect else f"error {g.error}" for g in got])

    return read(spark, d, "pages").select("url").distinct().mapInPandas(run, "url string, got string")


HOPS = [(0, "body end", 1), (1, "body end", 2), (4, "body end", 5), (5, "error too many redirects", 5)]


@query(f"SELECT * FROM {_rows(HOPS)} t(redirects, got, requests)")
def fetch_hops(spark: SparkSession, d: str) -> DataFrame:
    """Chains of redirects followed for five requests; each request is logged and the log read back."""
    out, said = [], []
    for n, _, _ in HOPS:
        said.clear()
        transport = logs.logged(lambda u: Response(200, b"end") if u.endswith("/0") else Response(307, b"", str(int(u.rpartition("/")[2]) - 1)), lambda msg, attrs: said.append((T0, "INFO", msg, {k: str(v) for k, v in attrs.items()})))
        got = fetch_following(transport, f"https://hop.test/{n}", 5)
        folder = _folder(spark, "requests")
        logs.write_log(spark.createDataFrame(list(said), logs.LOG), folder)
        out.append((n, f"body {got.body.decode()}" if got.body else f"error {got.error}", logs.read_log(spark, folder).where("msg = 'fetch.ok'").count()))
    return spark.createDataFrame(out, "redirects int, got string, requests int")


LOCATIONS = [("/b", "https://loc.test/b"), ("//x.test/?b=1&a=2", "https://x.test/?a=2&b=1"), ("?q#f", "https://loc.test/d/a?q="), ("a", None), (None, None), ("mailto:x", None)]


@query(f"SELECT * FROM {_rows(LOCATIONS)} t(location, target)")
def redirect_locations(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(x, redirect_location("https://loc.test/d/a", x)) for x, _ in LOCATIONS], "location string, target string")


@query("SELECT * FROM (VALUES ('fetch.ok', 'https://log.test/a', '200', NULL), ('fetch.ok', 'https://log.test/b', '404', NULL), ('fetch.err', 'https://log.test/c', NULL, 'down')) t(msg, url, status, err)")
def request_log(spark: SparkSession, d: str) -> DataFrame:
    said: list[tuple] = []

    def answer(url: str) -> Response:
        if url.endswith("c"):
            raise OSError("down")
        return Response(200 if url.endswith("a") else 404)

    transport = logs.logged(answer, lambda msg, attrs: said.append((T0, "INFO", msg, {k: str(v) for k, v in attrs.items()})))
    for u in "abc":
        fetch(transport, f"https://log.test/{u}")
    folder = _folder(spark, "log")
    logs.write_log(spark.createDataFrame(said, logs.LOG), folder)
    return logs.read_log(spark, folder).select("msg", F.col("attrs")["url"].alias("url"), F.col("attrs")["status"].alias("status"), F.col("attrs")["err"].alias("err"))


# URLs ------------------------------------------------------------------------------------------------------------------

PORTS = [("https://port.test:/a", "https://port.test/a"), ("https://port.test:8/a:/", "https://port.test:8/a:/"), ("https://u:@port.test:", "https://u:@port.test"), ("port:", "port:")]


@query(f"SELECT * FROM {_rows(PORTS)} t(url, bare) UNION ALL SELECT DISTINCT url, url FROM pages")
def url_empty_ports(spark: SparkSession, d: str) -> DataFrame:
    given = spark.createDataFrame([(u,) for u, _ in PORTS], "url string").unionByName(read(spark, d, "pages").select("url").distinct())
    return given.select("url", urls.without_empty_port(F.col("url")).alias("bare"))


PARSED = [("https://ok.test/?b=1&a=1", "https://ok.test/?a=1&b=1"), ("no url", "error"), ("http://[bad/", "error"), ("//host/x", "error"), ("ftp://u@h/x#f", "ftp://h/x")]


@query(f"SELECT * FROM {_rows(PARSED)} t(given, parsed)")
def url_parse(spark: SparkSession, d: str) -> DataFrame:
    """Texts parsed one by one; what is no absolute URL raises an error."""
    out = []
    for given, _ in PARSED:
        try:
            out.append((given, urls.parse_all([given])[0]))
        except ValueError:
            out.append((given, "error"))
    return spark.createDataFrame(out, "given string, parsed string")


QUEUE = r"lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || ':' || regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), '^.*@', ''), ':$', '')"


@query(f"SELECT {QUEUE} AS queue, left(sha256(url), 2) AS bucket, string_agg(DISTINCT url, ' ' ORDER BY url) AS urls FROM pages GROUP BY queue, bucket")
def host_url_lists(spark: SparkSession, d: str) -> DataFrame:
    """The sorted URLs of every host queue, in buckets by key."""
    return decide.host_lists(read(spark, d, "pages")).select("queue", "bucket", F.array_join("urls", " ").alias("urls"))


@query(f"WITH {CURRENT}, k AS (SELECT url_key FROM s WHERE state_type <> 4) SELECT DISTINCT url FROM pages WHERE sha256(url) NOT IN (SELECT url_key FROM k) UNION SELECT 'https://seed.test/'")
def crawl_plan(spark: SparkSession, d: str) -> DataFrame:
    """What a crawl begins with: known URLs of the store and seeds, each once."""
    store = Store(spark, _folder(spark, "store"))
    store.append("state", state.current(read(spark, d, "url_states")).where(F.col("state_type") != S.FILE_HTML))
    store.add_unknown(read(spark, d, "pages").select("url"), 1 << 40)
    return plan(store, spark.createDataFrame([("https://seed.test/#x",), ("https://seed.test/",), ("none",)], "url string")).select("url")


# Pages -----------------------------------------------------------------------------------------------------------------

@query("SELECT page_id FROM pages WHERE NOT regexp_matches(html, '[^>]</(script|style|title|noscript)></head>')")
def pages_strict(spark: SparkSession, d: str) -> DataFrame:
    """The pages whose body a search that climbs one level can reach."""
    return html.parse_pages(read(spark, d, "pages"), strict_structure=True, columns=("meta",)).select("page_id")


@query("SELECT page_id, tag, coalesce(elem_id, '') AS elem_id, array_to_string(classes, ' ') AS classes, count(*) AS n FROM nodes WHERE tag IS NOT NULL AND tag <> 'html' GROUP BY ALL")
def page_elements(spark: SparkSession, d: str) -> DataFrame:
    """The elements of the parsed pages with id and classes; the table of nodes holds the same tree."""
    nodes = html.parse_pages(read(spark, d, "pages"), columns=("nodes",)).select("page_id", F.explode("nodes").alias("x")).select("page_id", "x.*").where("tag is not null")
    return nodes.groupBy("page_id", "tag", F.coalesce("elem_id", F.lit("")).alias("elem_id"), F.array_join("classes", " ").alias("classes")).agg(F.count("*").alias("n"))


@query("SELECT page_id, tag, key, value, count(*) AS n FROM (SELECT page_id, tag, unnest(map_entries(attrs), recursive := true) FROM nodes WHERE tag IS NOT NULL AND tag <> 'html') GROUP BY ALL")
def page_attributes(spark: SparkSession, d: str) -> DataFrame:
    nodes = html.parse_pages(read(spark, d, "pages"), columns=("nodes",)).select("page_id", F.explode("nodes").alias("x")).where("x.tag is not null")
    return nodes.select("page_id", "x.tag", F.explode("x.attrs").alias("key", "value")).groupBy("page_id", "tag", "key", "value").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE under AS (SELECT page_id, node_id FROM nodes WHERE tag IN ('nav', 'header', 'footer', 'aside') UNION SELECT n.page_id, n.node_id FROM nodes n JOIN under u ON n.page_id = u.page_id AND n.parent_id = u.node_id)
    SELECT page_id, count(*) AS n FROM (SELECT page_id, node_id FROM nodes WHERE tag IS NOT NULL AND tag <> 'html' EXCEPT SELECT page_id, node_id FROM under) GROUP BY page_id""")
def page_pruned(spark: SparkSession, d: str) -> DataFrame:
    """How many elements a walk meets that skips navigation, headers, footers and side columns."""
    skipped = ("nav", "header", "footer", "aside")

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            counts = []
            for text in b.html:
                met = []
                html.walk(html.parse(text).children[1], lambda x: x.tag in skipped or met.append(x.tag is not None and not html._dropped(x)) or html._dropped(x))  # noqa: B023
                counts.append(sum(met))
            yield b[["page_id"]].assign(n=counts)

    return read(spark, d, "pages").select("page_id", "html").mapInPandas(run, "page_id long, n long")


TREE = "<body class='x y' id=b><p>One<p>Two <i title=t lang=en>three</i> four<ul><li>5<li><a href=/6>6</a></ul><!-- 7 --><script>8</script></body>"
TREE_LINES = ["<body> #b .x .y", "= <p> 'One'", "= <p>", "== 'Two'", "== <i> lang=en title=t 'three'", "== 'four'", "= <ul>", "== <li> '5'", "== <li>", "=== <a> href=/6 '6'"]


@query(f"SELECT * FROM {_rows(list(enumerate(TREE_LINES)))} t(position, line)")
def page_dump(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(html.print_lines(html.parse(TREE).children[1]))), "position int, line string")


@query("SELECT page_id, coalesce(og_title, '') AS og_title, coalesce(og_locale, '') AS og_locale, coalesce(og_site_name, '') AS og_site_name, coalesce(no_follow, false) AS no_follow, coalesce(no_index, false) AS no_index FROM page_meta")
def page_og(spark: SparkSession, d: str) -> DataFrame:
    """OpenGraph values and robots directives, written into a head and read back by the parser."""
    value = lambda name, c: F.concat(F.lit(f'<meta property="og:{name}" content="'), escape_html(F.coalesce(c, F.lit(""))), F.lit('">'))
    robots_meta = F.concat(F.lit('<meta name="robots" content="x'), F.when(F.col("no_index"), ",noindex").otherwise(""), F.when(F.col("no_follow"), " nofollow").otherwise(""), F.lit('">'))
    head = F.concat(F.lit("<head>"), value("title", F.col("og_title")), value("locale", F.col("og_locale")), value("site_name", F.col("og_site_name")), robots_meta, F.lit("</head>"))
    pages = read(spark, d, "page_meta").select("page_id", F.lit("https://og.test/").alias("url"), head.alias("html"))
    return html.parse_pages(pages, columns=("meta",)).select("page_id", "meta.og_title", "meta.og_locale", "meta.og_site_name", "meta.no_follow", "meta.no_index")


HEADS = [
    ("<meta name=robots content='index, nofollow'><meta property='og:title' content=A><meta property='og:title' content=B>", "A", "", "", False, True),
    ("<meta name=robots content='NOINDEX none'><meta property='og:image' content=i.png><meta property='og:description' content=''>", "", "i.png", "", True, True),
    ("<meta name=robots content=all><script type='application/ld+json'>{ \"k\": [1, 2] }</script><script type='application/ld+json'>7 </script>", "", "", "7 {\"k\":[1,2]}", False, False),
    ("<meta name=description property='og:title' content=no><meta name=robots content=noindex,x>", "", "", "", True, False),
]


@query(f"SELECT * FROM {_rows([(i, *x[1:]) for i, x in enumerate(HEADS)])} t(page_id, og_title, og_image, linked, no_index, no_follow)")
def page_heads_edge(spark: SparkSession, d: str) -> DataFrame:
    """First OpenGraph value, directives that add up, linked data in compact form, last first."""
    pages = spark.createDataFrame([(i, "https://head.test/", f"<head>{h[0]}</head><body>x") for i, h in enumerate(HEADS)], "page_id long, url string, html string")
    m = html.parse_pages(pages, columns=("meta",))
    return m.select(F.col("page_id").cast("int").alias("page_id"), "meta.og_title", "meta.og_image", F.array_join("meta.linked_data", " ").alias("linked"), "meta.no_index", "meta.no_follow")


# Robots ----------------------------------------------------------------------------------------------------------------

PATTERNS = ["/*.html$", "/*/en/*", "/*?ref=", "/a/*f", "/index.php*s=1", "/~*/1", "*club", "/%7Egicole", ""]
TARGET = r"regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) || regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
PATTERN_SQL = [r"^/(.*?)\.html$", "^/.*?/en/", r"^/.*?\?ref=", "^/a/.*?f", r"^/index\.php.*?s=1", "^/~.*?/1", "^.*?club", "^/~gicole", "^"]


@query(f"SELECT page_id, i AS rule, regexp_matches(t, p) AND (i <> 0 OR length(t) - length(replace(t, '.html', '')) = 5) AS matched FROM (SELECT page_id, {TARGET} AS t FROM pages), {_rows(list(enumerate(PATTERN_SQL)))} r(i, p)")
def robots_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Every page against patterns with '*', '$' and escapes."""
    target = urls.path_and_query(F.col("url"))
    checks = [F.struct(F.lit(i).alias("rule"), target.rlike(robots.rule_regex(robots.pattern_rule(p, True))).alias("matched")) for i, p in enumerate(PATTERNS)]
    return read(spark, d, "pages").select("page_id", F.explode(F.array(*checks)).alias("x")).select("page_id", "x.rule", "x.matched")


HOST = r"regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), ':[0-9]*$', '')"


@query(f"""SELECT page_id, CASE WHEN host NOT LIKE 'news.%' AND host NOT LIKE 'blog.%' THEN true WHEN host LIKE 'news.%' THEN NOT (t LIKE '/index.php%') ELSE t LIKE '%/20%' OR NOT (t LIKE '/%-%') END AS allowed
    FROM (SELECT page_id, {HOST} AS host, {TARGET} AS t FROM pages)""")
def robots_by_host(spark: SparkSession, d: str) -> DataFrame:
    """Every page by the robots file of its host; hosts without one allow all. The files are joined by host, the rules matched after it."""
    pages = read(spark, d, "pages").select("page_id", "url", F.regexp_replace(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1), ":[0-9]*$", "").alias("host"))
    news, blog = "User-agent: *\nDisallow: /index.php\n", "User-agent: *\nAllow: /*/20\nAllow: /20\nDisallow: /*-\n"
    hosts = pages.select("host").distinct()
    files = hosts.select("host", F.when(F.col("host").startswith("news."), news).when(F.col("host").startswith("blog."), blog).alias("content")).where("content is not null")
    return pages.join(files, "host", "left").select("page_id", robots.robots_allow("content", urls.path_and_query(F.col("url"))).alias("allowed"))


@query(f"SELECT DISTINCT queue FROM (SELECT {QUEUE} AS queue, fetched_at FROM pages) GROUP BY queue HAVING max(fetched_at) <= TIMESTAMP '2026-01-01' - INTERVAL 24 HOUR")
def robots_cache(spark: SparkSession, d: str) -> DataFrame:
    """The hosts whose robots file has to be fetched again, if it was fetched with their last page."""
    queues = read(spark, d, "pages").select(urls.host_queue(F.col("url")).alias("queue"), "fetched_at")
    return decide.robots_needed(queues, queues, F.lit(T0), F.lit(timedelta(hours=24)))


# Search ----------------------------------------------------------------------------------------------------------------

@query(f"WITH {WORDS}, q AS (SELECT * FROM (VALUES (0, 'the'), (1, 'valley'), (2, 'the'), (3, 'xyzzyx')) t(position, word)) SELECT position, q.word, count(DISTINCT k) AS df FROM q LEFT JOIN w USING (word) GROUP BY ALL")
def search_df(spark: SparkSession, d: str) -> DataFrame:
    return search.query_terms(search.parse_query(ASK + " The XYZZYX"), _doc_postings(spark, d))


PARAMS = [("a", "", "a 0"), ("a b", "7", "a b 7"), ("", "3", "start"), ("a", "-1", "error"), ("a", "1.5", "error"), ("a", "x", "error")]


@query(f"SELECT * FROM {_rows(PARAMS)} t(q, page, got)")
def search_params(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for q, page, _ in PARAMS:
        try:
            got = search.parse_params(q, page)
            out.append((q, page, "start" if got is None else f"{got[0]} {got[1]}"))
        except ValueError:
            out.append((q, page, "error"))
    return spark.createDataFrame(out, "q string, page string, got string")


def _escaped(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '''', '&#39;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;')"


def _short(x: str, n: int) -> str:
    return f"CASE WHEN strlen({x}) <= {n} THEN {x} WHEN length({x}) > {n} THEN {x}[1:{n}] || '...' ELSE {x} END"


@query(HITS + f""", t AS (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 10) SELECT t.doc_id, '<li><a href="' || {_escaped('p.url')} || '">' || {_escaped(_short("coalesce(m.title, '')", 60))} || '</a><p>' || {_escaped(_short("coalesce(m.description, '')", 160))} || '</p></li>' AS item
    FROM t JOIN pages p ON p.page_id = t.doc_id JOIN page_meta m ON m.page_id = t.doc_id""")
def search_page_html(spark: SparkSession, d: str) -> DataFrame:
    """The first results as list items of a page."""
    top = F.broadcast(search.page_of(_hits(spark, d), 0, "doc_id").withColumnRenamed("doc_id", "page_id"))  # ten rows
    rows = read(spark, d, "page_meta").select("page_id", "title", "description").join(F.broadcast(read(spark, d, "pages").select("page_id", "url").join(top, "page_id")), "page_id")
    return rows.select(F.col("page_id").alias("doc_id"), render.result_item(F.col("url"), F.col("title"), F.col("description")).alias("item"))


# Rank and crawl --------------------------------------------------------------------------------------------------------

STEPS, EPSILON = 12, 5000.0


def _converged_sql() -> str:
    norms = " UNION ALL ".join(f"SELECT {k} AS k, (SELECT sum(pow(a.rank - b.rank, 2)) FROM r{k - 1} a JOIN r{k} b USING (page_key)) AS norm" for k in range(1, STEPS + 1))
    ranks = " UNION ALL ".join(f"SELECT {k} AS k, page_key, rank FROM r{k}" for k in range(1, STEPS + 1))
    return f"{_rank_sql(STEPS)}, d AS ({norms}), l AS (SELECT coalesce(min(k) FILTER (norm <= {EPSILON}), {STEPS}) AS k FROM d) SELECT page_key, round(rank, 6) AS rank FROM ({ranks}) JOIN l USING (k)"


@query(_converged_sql())
def rank_converged(spark: SparkSession, d: str) -> DataFrame:
    """Iterated until the squared change is small or the steps are used up."""
    return rank.rank(*_graph(spark, d), STEPS, EPSILON).select("page_key", F.round("rank", 6).alias("rank"))


MARSH = {
    "/": "<html lang=nl><body><a href='a/b'>1</a> <a href='/no/x'>2</a> <a href='//away.test/'>3</a> <a href='/moved'>4</a> <a href='/robots.txt'>5</a></body></html>",
    "/a/": "<html lang=nl><head><meta name=robots content=noindex></head><body>6</body></html>",
    "/a/b": "<html lang=nl><head><meta name=robots content=nofollow></head><body><a href='/never'>7</a></body></html>",
    "/new": "<html lang=nl><body><a href='/gone'>8</a><a href='/it'>9</a></body></html>",
    "/it": "<html lang=it><body>10</body></html>",
    "/robots.txt": "User-agent: *\nDisallow: /no\n",
}
MARSH_STATES = [("/", 4), ("/a/", 133), ("/a/b", 4), ("/new", 4), ("/it", 131), ("/robots.txt", 3), ("/moved", 2), ("/gone", 128), ("/no/", 132), ("/no/x", 132), ("//away.test/", 130), ("//www.away.test/", 130), ("//www.fen.test/", 130)]


def _fen(pages: dict[str, str]):  # noqa: ANN202
    from websift.sources.fetch import Response

    def transport(url: str) -> Response:
        path = url.removeprefix("https://fen.test")
        if path == "/moved":
            return Response(301, b"", "/new")
        return Response(200, pages[path].encode()) if path in pages else Response(410)

    return transport


@query(f"SELECT sha256(CASE WHEN path LIKE '//%' THEN 'https:' || path ELSE 'https://fen.test' || path END) AS url_key, state_type FROM {_rows(MARSH_STATES)} t(path, state_type)")
def crawl_states(spark: SparkSession, d: str) -> DataFrame:
    """A small site crawled to its end."""
    store = Store(spark, _folder(spark, "crawl"))
    away = F.regexp_extract("url", "^https?://([^/]*)", 1) != "fen.test"
    crawl(store, spark.createDataFrame([("https://fen.test/",)], "url string"), CrawlConfig(_fen(MARSH), [away], [F.col("lang") != "nl"], sleep=None), T0)
    return store.current().select("url_key", F.col("state_type").cast("int").alias("state_type"))


@query(f"WITH {GRAPH} SELECT src, count(*) AS n, count(DISTINCT dst) AS targets, min(dst) AS first, max(dst) AS last FROM e GROUP BY src")
def link_lists(spark: SparkSession, d: str) -> DataFrame:
    """The links of each page between known pages, parallel ones kept."""
    edges, nodes = _graph(spark, d)
    return links.keep_known(edges, nodes).groupBy("src").agg(F.count("*").alias("n"), F.count_distinct("dst").alias("targets"), F.min("dst").alias("first"), F.max("dst").alias("last"))


@query(f"WITH {CURRENT} SELECT state_type::INTEGER AS state_type, count(*) AS n FROM s GROUP BY state_type")
def state_stream(spark: SparkSession, d: str) -> DataFrame:
    """The current states counted by a stream over the log: a key that changes its state moves from one count to the other."""
    folder = _folder(spark, "stream")
    read(spark, d, "url_states").select(*S.STATE_LOG.names).repartitionByRange(4, "seq").write.parquet(folder + "/log")
    table = folder + "/current"
    stats.follow_current(stats.state_stream(spark, folder + "/log", 1), table, folder + "/checkpoint", once=True).awaitTermination()
    return stats.latest(spark, table).groupBy(F.col("state_type").cast("int").alias("state_type")).agg(F.count("*").alias("n"))

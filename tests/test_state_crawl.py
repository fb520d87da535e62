from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from websift import schema as S
from websift.functions.keys import key_hex
from websift.operators import decide, state
from websift.plans.crawl import CrawlConfig, Store, crawl, plan
from websift.sources import binary, logs
from websift.sources.fetch import Response, fetch, fetch_following, redirect_location
from websift.sources.tables import memory_store, process, url_list
from websift.streaming import stats

T0 = datetime(2025, 1, 1)


def log(spark, rows):
    return memory_store(spark, [(s, k, t, T0, d, p, n) for s, k, t, d, p, n in rows])


def test_current_and_redirects(spark):
    df = log(spark, [(1, "a", 1, None, None, None), (2, "b", 2, "c", None, None), (3, "c", 4, None, 0, 9), (4, "d", 128, None, None, None), (5, "a", 0, None, None, None), (5, "a", 0, None, None, None), (6, "e", 2, "b", None, None), (7, "f", 2, "g", None, None), (8, "h", 2, "h", None, None)])
    now = state.current(df)
    assert {r.url_key for r in now.collect()} == set("bcdefh")
    assert {tuple(r) for r in state.redirect_targets(now).collect()} == {("b", "c"), ("e", "c")}
    assert {r.url_key for r in state.unknown(spark.createDataFrame([("a",), ("b",), ("a",)], "url_key string"), now).collect()} == {"a"}
    asked = spark.createDataFrame([("a",), ("c",), ("d",)], "url_key string")
    assert {r.url_key: r.status for r in state.lookup(asked, now).collect()} == {"a": "notExist", "c": "ok", "d": "notFile"}


def test_long_redirects(spark):
    chain = [(i, f"k{i:02}", 2, f"k{i + 1:02}", None, None) for i in range(12)] + [(99, "k12", 3, None, 0, 1)]
    got = {r.url_key for r in state.redirect_targets(state.current(log(spark, chain))).collect()}
    assert got == {f"k{i:02}" for i in range(3, 12)}


def test_statistics(spark):
    rows = [(i, f"k{i}", t, None, 0, n) for i, (t, n) in enumerate([(1, 0), (1, 0), (2, 0), (3, 30), (4, 50), (4, 20), (130, 0)])]
    now = state.current(log(spark, rows))
    got = {r.state_type: (r["name"], r.n, r.percent, r["bytes"], r.percent_bytes) for r in state.statistics(now).collect()}
    assert got == {1: ("know", 2, 28, 0, 0), 2: ("redirect", 1, 14, 0, 0), 3: ("fileRobots", 1, 14, 30, 30), 4: ("fileHTML", 2, 28, 70, 70), 130: ("errorFilterURL", 1, 14, 0, 0)}
    assert tuple(state.totals(now).first()) == (7, 3, 1, 100, 2)
    assert state.statistics(now.where("false")).count() == 0


def test_changes(spark):
    keys = spark.createDataFrame([("a",)], "url_key string")
    assert state.set_simple(keys, S.KNOW, 1).first().state_type == 1
    with pytest.raises(ValueError):
        state.set_simple(keys, S.FILE_HTML, 1)
    with pytest.raises(ValueError):
        state.set_value(keys, S.KNOW, 1)
    assert state.set_redirect(keys.withColumn("dest_key", F.lit("b")), 2).first().dest_key == "b"


def test_url_list(spark):
    lines = spark.createDataFrame([("https://tern.test/",), ("https://gull.test/",), ("https://auk.test/",), ("no url",)], "value string")
    kinds = {"https://tern.test/": 1, "https://gull.test/": 4, "https://auk.test/": 129}
    now = lines.where("value <> 'no url'").select(key_hex(F.col("value")).alias("url_key"), F.create_map(*[F.lit(x) for p in kinds.items() for x in p])[F.col("value")].alias("state_type"))
    assert {r.url for r in url_list(lines, now, [1, 129]).collect()} == {"https://tern.test/", "https://auk.test/"}


def test_records():
    k, d = bytes(range(100, 132)), bytes(range(200, 232))
    when = 1_700_000_001
    at = when.to_bytes(7, "big")
    assert binary.state_record(k, 0) == k + b"\0" and binary.state_record(k, 1) == k + b"\1"
    assert binary.state_record(k, 133, when) == k + b"\x85" + at
    assert binary.state_record(k, 2, when, d) == k + b"\2" + at + d
    assert binary.state_record(k, 7, when, d, 3 << 33, 513) == k + b"\7" + at + b"\0\0\0\6\0\0\0\0" + b"\0\0\2\1" + d[12:]
    data = b"".join([binary.state_record(k, 1), binary.state_record(k, 4, 5, d, 7, 8), binary.state_record(k, 2, 5, d)])
    want = [(1, 0, None), (4, 5, 8), (2, 5, None)]
    assert [(r["state_type"], r["time"], r["blob_length"]) for r in binary.state_records(data + b"cut")] == want
    pieces = [data[i : i + 7] for i in range(0, len(data), 7)]
    assert [(r["state_type"], r["time"], r["blob_length"]) for r in binary.state_records(pieces)] == want


def test_index_files(spark, tmp_path):
    k, p = bytes(range(32)), [bytes([i] * 32) for i in range(3)]
    with pytest.raises(ValueError):
        list(binary.read_key_values(binary.key_values([(k, b"12345")])[:-1]))
    assert list(binary.read_key_values(binary.key_values([(k, b"abc"), (p[0], b"")]))) == [(k, b"abc")]
    (tmp_path / "words.db").write_bytes(binary.key_values([(k, binary.posting_bytes([(p[0], 1.0), (p[1], 2.5)]))]))
    assert {(r.word_key, r.page_key, r.tf) for r in binary.load_index(spark, str(tmp_path / "words.db")).collect()} == {(k.hex(), p[0].hex(), 1.0), (k.hex(), p[1].hex(), 2.5)}
    (tmp_path / "rank.db").write_bytes(binary.key_values([(p[0], b"\xbe\x80\0\0")]))
    assert binary.load_rank(spark, str(tmp_path / "rank.db")).first()["rank"] == -0.25
    (tmp_path / "urls.meta").write_bytes(binary.state_record(k, 4, 5, p[1], 7, 8))
    assert binary.load_state_log(spark, str(tmp_path / "urls.meta")).first().blob_position == 7
    stored, digest = binary.blob(b"page")
    assert binary.unblob(stored, digest[12:]) == b"page"
    with pytest.raises(ValueError):
        binary.unblob(stored, b"0" * 20)


HOST = "https://marsh.test"
SITE = {
    "/": "<html lang=nl><body><a href='birds/heron'>H</a> <a href='/nest/eggs'>E</a> <a href='//dune.test/x'>D</a> <a href='/favicon.ico'>i</a> <a href='/moved'>m</a></body></html>",
    "/birds/": "<html lang=nl><head><meta name=robots content=noindex></head><body>list <a href='/unseen'>m</a></body></html>",
    "/birds/heron": "<html lang=nl><head><meta name=robots content=nofollow></head><body>heron <a href='/unseen'>u</a></body></html>",
    "/new": "<html lang=nl><body>moved here <a href='/gone'>g</a><a href='/broken'>b</a><a href='/it'>i</a></body></html>",
    "/it": "<html lang=it><body>in italiano</body></html>",
    "/left": "<html lang=nl><body>known before</body></html>",
    "/robots.txt": "User-agent: *\nDisallow: /nest\nCrawl-delay: 7\n",
}


def site_transport():
    """A function of its own, so that it is sent to the workers by value."""

    def transport(url):
        path = url.removeprefix("https://marsh.test")
        if path == "/moved":
            return Response(301, b"", "/new")
        if path == "/broken":
            raise OSError("line cut")
        return Response(200, SITE[path].encode()) if path in SITE else Response(410)

    return transport


transport = site_transport()


def test_fetch():
    assert fetch(transport, HOST + "/broken").error == "line cut"
    assert fetch(transport, HOST + "/gone").error == "status 410"
    assert fetch(transport, HOST + "/moved").redirect == HOST + "/new"
    assert fetch_following(transport, HOST + "/moved").body == SITE["/new"].encode()
    assert fetch_following(lambda u: Response(302, b"", u + "x"), HOST + "/", hops=3).error == "too many redirects"
    assert len(fetch(transport, HOST + "/", max_length=5).body) == 5
    assert redirect_location("https://a/b", "https://a/b") is None and redirect_location("https://a/b", "c") == "https://a/c" and redirect_location("https://a/b", None) is None


@pytest.mark.parametrize("rounds", [1, 10])
def test_crawl(spark, tmp_path, rounds):
    store = Store(spark, str(tmp_path / "store"))
    seed = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    store.add_unknown(seed(HOST + "/left"), 0)
    assert {r.url for r in plan(store, seed("https://me@marsh.test/?", "no url")).collect()} == {HOST + "/left", HOST + "/"}
    away = F.regexp_extract("url", "^https?://([^/]*)", 1) != "marsh.test"
    crawl(store, seed(HOST + "/"), CrawlConfig(transport, [away], [F.col("lang") != "nl"], sleep=None, compact_rounds=rounds), T0, 1)
    got = {r.state_type: r.n for r in store.current().groupBy("state_type").agg(F.count("*").alias("n")).collect()}
    # /favicon.ico stays known; dune.test, www.dune.test, dune.test/x and www.marsh.test are struck; /nest/ and /nest/eggs by robots.
    assert got == {S.KNOW: 1, S.REDIRECT: 1, S.FILE_ROBOTS: 1, S.FILE_HTML: 4, S.ERROR_NETWORK: 2, S.ERROR_FILTER_URL: 4, S.ERROR_FILTER_PAGE: 1, S.ERROR_ROBOT: 2, S.ERROR_NO_INDEX: 1}
    pages = store.table("pages")
    assert {r.url.removeprefix(HOST) for r in pages.collect()} == {"/", "/birds/heron", "/new", "/left"}
    asked = pages.select("url_key")
    contents = pages.select("url_key", F.col("html").alias("content"), F.when(F.col("url") == HOST + "/new", F.lit("00" * 32)).otherwise(F.col("digest")).alias("digest"))
    assert sorted(r.status for r in state.values(asked, store.current(), contents).collect()) == ["damaged", "ok", "ok", "ok"]


def test_waits_between_fetches_of_a_host(spark):
    from websift.plans.crawl import _fetch_pages

    waits = []
    frame = pd.DataFrame([("k", HOST + p, 7.0, q) for p, q in (("/left", "a"), ("/new", "a"), ("/it", "b"))], columns=["url_key", "url", "delay", "queue"])
    rows = pd.concat(_fetch_pages(CrawlConfig(transport, sleep=waits.append))(iter([frame])))
    assert waits == [7.0] and rows.kind.tolist() == [S.FILE_HTML] * 3
    strict = CrawlConfig(lambda u: Response(200, b"<head><title>t</title></head><body>x"), sleep=None, strict_structure=True)
    assert pd.concat(_fetch_pages(strict)(iter([frame]))).kind.tolist() == [S.ERROR_PARSING] * 3


def test_decisions(spark):
    df = spark.createDataFrame([(None,), (3,), (60,)], "d int")
    assert [r[0] for r in df.select(decide.clamp_delay(F.col("d"))).collect()] == [0.5, 3.0, 10.0]
    df = spark.createDataFrame([(True, "fr"), (False, "en"), (False, "fr"), (False, None)], "no_index boolean, lang string")
    assert [r[0] for r in df.select(decide.page_decision(F.col("no_index"), [F.col("lang") != "fr"])).collect()] == [133, 131, 4, 4]


def test_process(spark):
    out = process(spark.range(4), {"n": lambda p: p.agg(F.count("*").alias("n")), "s": lambda p: p.agg(F.sum("id").alias("s"))})
    assert out["n"].first().n == 4 and out["s"].first().s == 6
    out["scan"].unpersist()


def test_stream(spark, tmp_path):
    rows = log(spark, [(1, "a", 1, None, None, None), (2, "b", 4, None, 0, 1), (3, "c", 4, None, 0, 1)])
    rows.write.parquet(str(tmp_path / "log"))
    q = stats.start_statistics(stats.state_stream(spark, str(tmp_path / "log")), "state_counts", str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    assert {r.state_type: r.n for r in spark.table("state_counts").collect()} == {1: 1, 4: 2}
    assert stats.windowed(rows.unionByName(rows)).agg(F.sum("n")).first()[0] == 3


def test_written_files(spark, tmp_path):
    k = [bytes([i] * 32).hex() for i in range(4)]
    posts = spark.createDataFrame([(k[0], k[2], 1.0), (k[0], k[1], 2.0), (k[3], k[1], 1.5)], "word_key string, page_key string, tf double")
    binary.write_index(posts, str(tmp_path / "words"))
    assert {tuple(r) for r in binary.load_index(spark, str(tmp_path / "words")).collect()} == {tuple(r) for r in posts.collect()}
    ranks = spark.createDataFrame([(k[0], 0.5), (k[1], 2.0)], "page_key string, rank double")
    binary.write_rank(ranks, str(tmp_path / "rank"))
    assert {tuple(r) for r in binary.load_rank(spark, str(tmp_path / "rank")).collect()} == {tuple(r) for r in ranks.collect()}
    key, digest = bytes(range(32)), bytes(range(32))
    old = b"".join([binary.state_record(bytes(32), 1), binary.state_record(key, 4, 5, digest, 7, 8)])
    new = b"".join([binary.state_record(key, 2, 5, digest), binary.state_record(bytes(32), 128, 9)])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "urls-2.meta").write_bytes(new)
    (tmp_path / "in" / "urls-1.meta").write_bytes(old)
    log = binary.load_state_log(spark, str(tmp_path / "in"))
    # The later file counts, whatever the places of the records in their files.
    assert {r.url_key: r.state_type for r in state.current(log).collect()} == {key.hex(): 2, bytes(32).hex(): 128}
    binary.write_state_log(log, str(tmp_path / "out"))
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("urls-*.meta"))) == old + new
    assert not list((tmp_path / "out").glob("_*"))


def test_logs(spark, tmp_path):
    said = []
    get = logs.logged(transport, lambda msg, attrs: said.append((msg, attrs)))
    get(HOST + "/gone")
    with pytest.raises(OSError):
        get(HOST + "/broken")
    assert said == [("fetch.ok", {"status": 410, "url": HOST + "/gone"}), ("fetch.err", {"err": "line cut", "url": HOST + "/broken"})]
    logs.write_log(spark.createDataFrame([(T0, "INFO", "fetch.ok", {"status": "200"})], logs.LOG), str(tmp_path / "log"))
    assert logs.read_log(spark, str(tmp_path / "log")).first().attrs == {"status": "200"}

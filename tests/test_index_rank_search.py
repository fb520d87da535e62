import pytest
from pyspark.sql import functions as F

from websift.functions.keys import key_hex
from websift.operators import links, postings, rank, search
from websift.plans import index
from websift.sources.tables import fake_store


def test_vocabulary(spark):
    t = "Mossy wall, mossy roof; OLD roof -- 33 a ss"
    v = postings.vocabulary(spark.createDataFrame([(t,), ("wall",), (None,)], "text string"))
    assert [tuple(r) for r in postings.top_words(v, 3).collect()] == [("mossy", 2), ("roof", 2), ("wall", 2)]
    assert tuple(postings.vocabulary_totals(v).first()) == (7, 4)


def test_postings(spark):
    docs = spark.createDataFrame([("x", "Fern fern"), ("y", " moss\nFERN"), ("z", "")], "k string, text string")
    p = postings.postings(docs, "k")
    assert {tuple(r) for r in p.collect()} == {("fern", "x", 2.0), ("fern", "y", 1.0), ("moss", "y", 1.0)}
    lists = {r["word"]: [tuple(i) for i in r["items"]] for r in postings.posting_lists(p, "k").collect()}
    assert lists == {"fern": [("x", 2.0), ("y", 1.0)], "moss": [("y", 1.0)]}
    assert {r["word"]: r["df"] for r in postings.document_frequency(p).collect()} == {"fern": 2, "moss": 1}


def test_hot_word_in_buckets(spark):
    posts = spark.createDataFrame([("hot", i, 1.0) for i in range(600)] + [("cold", i, 1.0) for i in range(9)], "word string, k long, tf double")
    rows = postings.posting_lists(posts, "k", most=20).collect()
    hot = [r for r in rows if r["word"] == "hot"]
    assert len(hot) > 16 and all(len(r["bucket"]) == 2 for r in hot) and sorted(i["k"] for r in hot for i in r["items"]) == list(range(600))
    assert [(r["bucket"], len(r["items"])) for r in rows if r["word"] == "cold"] == [("", 9)]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def nodes(spark, names="abcd"):
    return spark.createDataFrame([(n,) for n in names], "page_key string")


def test_links(spark):
    got = links.build(edges(spark, [("p", "old"), ("p", "q"), ("p", "q"), (None, "q")]), edges(spark, [("old", "new")]))
    assert sorted(map(tuple, got.collect())) == [("p", "new"), ("p", "q"), ("p", "q")]
    known = links.keep_known(edges(spark, [("p", "q"), ("q", "q"), ("q", "out"), ("r", "p"), ("r", "p")]), nodes(spark, "pqr"))
    assert sorted(map(tuple, known.collect())) == [("p", "q"), ("r", "p"), ("r", "p")]
    assert sorted(map(tuple, links.degree_histogram(edges(spark, [("p", "q"), ("p", "r"), ("q", "p")]), nodes(spark, "pqrs")).collect())) == [(0, 2), (1, 1), (2, 1)]


def ranks(df):
    return {r.page_key: round(r["rank"], 6) for r in df.collect()}


def test_rank(spark):
    # A ring of three with a way out: s gets a third of r and gives nothing on.
    e = edges(spark, [("p", "q"), ("q", "r"), ("r", "p"), ("r", "p"), ("r", "s"), ("q", "q"), ("s", "away")])
    one, two = {"p": 2 / 3, "q": 1.0, "r": 1.0, "s": 1 / 3}, {"p": 2 / 3, "q": 2 / 3, "r": 1.0, "s": 1 / 3}
    rounded = lambda x: {k: round(v, 6) for k, v in x.items()}
    assert ranks(rank.iterate(e, nodes(spark, "pqrs"), 1)) == rounded(one)
    assert [ranks(x) for x in rank.steps(e, nodes(spark, "pqrs"), 2)[1:]] == [rounded(one), rounded(two)]
    assert ranks(rank.rank(e, nodes(spark, "pqrs"), 2, 0.0)) == rounded(two)
    # The first step changes by 1/9 + 4/9, the second by 1/9: the iteration ends after the second.
    assert ranks(rank.rank(e, nodes(spark, "pqrs"), 50, 0.2)) == rounded(two)


def test_search(spark):
    rows = [("red", k, float(k)) for k in (2, 4, 6, 8)] + [("kite", k, 1.0) for k in (3, 4, 8, 9)]
    p = spark.createDataFrame(rows, "word string, page_key long, tf double")
    terms = search.parse_query("RED kite red")
    assert {r.page_key: r.tf for r in search.retrieve(terms, p).collect()} == {4: 4.0, 8: 8.0}
    assert [tuple(r) for r in search.query_terms([*terms, "swan"], p).orderBy("position").collect()] == [(0, "red", 4), (1, "kite", 4), (2, "red", 4), (3, "swan", 0)]
    assert search.retrieve([], p).count() == 0
    a, b = (p.where(F.col("word") == w).select("page_key", "tf") for w in ("red", "kite"))
    assert {r.page_key: r.tf for r in search.intersect(a, b).collect()} == {4: 4.0, 8: 8.0}
    hits = spark.createDataFrame([(k, 1.0) for k in (5, 6, 7, 8)], "page_key long, tf double")
    r = spark.createDataFrame([(6, 0.5), (8, 0.5), (99, 9.0)], "page_key long, rank double")
    assert [x.page_key for x in search.page_of(search.score(hits, r), 0).collect()] == [6, 8, 5, 7]


def test_search_pages(spark):
    s = fake_store(spark)
    got = search.search("Pebble!", 1, s["postings"], s["rank"], s["pages"])
    assert [r["page_key"] for r in got["results"]] == list(range(10, 20)) and (got["n"], got["chunks"]) == (51, 6) and got["terms"][0]["df"] == 51
    assert search.search("of", 0, s["postings"], s["rank"], s["pages"])["results"] == []
    for q, page in (("of", 1), ("pebble", 9), ("pebble", -2)):
        with pytest.raises(ValueError):
            search.search(q, page, s["postings"], s["rank"], s["pages"])
    with pytest.raises(ValueError):
        search.search("pebble", 0, s["postings"], s["rank"], s["pages"].where("page_key > 3"))


def test_index(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://a.b/", "<body><a href='/c/'>word</a></body>"), (2, "https://a.b/c/", "<body>word word other<a href='/'>x</a></body>")], "page_id long, url string, html string")
    t = index.build(pages, None, str(tmp_path))
    key = pages.select("page_id", key_hex(F.col("url")).alias("k")).collect()
    names = {r.k: r.page_id for r in key}
    assert {(r.word, names[r.page_key], r.tf) for r in t["postings"].collect()} == {("word", 1, 1.0), ("word", 2, 2.0), ("other", 2, 1.0)}
    assert {names[r.page_key]: r["rank"] for r in t["rank"].collect()} == {1: 1.0, 2: 1.0}


def test_params():
    assert search.parse_params(None, None) is None and search.parse_params("a", None) == ("a", 0) and search.parse_params("a", "3") == ("a", 3)
    for page in ("-1", "x", "1.5"):
        with pytest.raises(ValueError):
            search.parse_params("a", page)


def test_result_page(spark):
    from websift.functions import render

    s = fake_store(spark, 12)
    page = render.result_page(search.search("pebble", 1, s["postings"], s["rank"], s["pages"]), 'peb"ble', 1)
    assert page.count("<li>") == 2 and "<b>1</b>" in page and "peb&quot;ble" in page and "pebble (12)" in page
    item = spark.range(1).select(render.result_item(F.lit("https://a/?b&c"), F.lit("T" * 70), F.lit(None).cast("string"))).first()[0]
    assert item == f'<li><a href="https://a/?b&amp;c">{"T" * 60}...</a><p></p></li>'

import math
import random

from websift.llm import termfreq, topn

COUNTS = "page_id long, word string, word_count long, clash string"


def marked(df, **kw):
    n = df.selectExpr("count(distinct page_id)").first()[0]
    return {r.word: (r.total, r.records, r["mark"]) for r in termfreq.mark_terms(termfreq.term_frequency(df), n, **kw).collect()}


def test_terms(spark):
    rows = [(1, " Foo ", 2, "a"), (1, " Foo ", 2, "a"), (1, "foo\u00a0", 3, "a"), (2, "FOO", 1, "a"), (2, "bar", 1, "a"), (3, None, 5, "a"), (3, "  ", 5, "a"), (4, "x", None, "a"), (5, "x", 0, "a"), (6, "x", -1, "a"), (None, "y", 4, "a")]
    assert marked(spark.createDataFrame(rows, COUNTS)) == {"foo": (6, 2, "common"), "bar": (1, 1, "rare")}
    assert marked(spark.createDataFrame([], COUNTS)) == {}


def test_terms_against_brute_force(spark):
    rng = random.Random(1)
    # One word holds a third of all rows, and more rows than an Arrow batch spans several ranges.
    rows = [(rng.randrange(3000), "hot" if rng.random() < 0.33 else f"w{rng.randrange(2000)}", rng.randrange(0, 3), str(i)) for i in range(30_000)]
    total, pages = {}, {}
    for p, w, n, _ in rows:
        if n >= 1:
            total[w] = total.get(w, 0) + n
            pages.setdefault(w, set()).add(p)
    want = {w: (total[w], len(pages[w])) for w in total}
    got = {w: x[:2] for w, x in marked(spark.createDataFrame(rows, COUNTS).repartition(7)).items()}
    assert got == want


ITEMS = "word string, item_key long, f32 float, i int, s string"


def top(df, n, **kw):
    return sorted((r.word, r.item_key) for r in topn.top_n(df, "word", "item_key", "f32", n, **kw).collect())


def test_top(spark):
    rows = [("a", 1, 1.0, 0, "x"), ("a", 2, 1.0, 0, "x"), ("a", 2, 5.0, 0, "x"), ("a", 3, None, 0, "x"), ("a", 4, math.nan, 0, "x"), ("a", 5, 1.0, 0, "x"), (None, 6, 1.0, 0, "x"), ("b", None, 1.0, 0, "x"), ("b", 7, -2.0, 0, "x"), ("c", 8, math.inf, 0, "x"), ("c", 9, -math.inf, 0, "x")]
    df = spark.createDataFrame(rows, ITEMS)
    assert top(df, 2) == [("a", 1), ("a", 2), ("b", 7), ("c", 8), ("c", 9)]
    assert top(df, 0) == [] and top(df.where("false"), 3) == []


def test_top_against_brute_force(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.33 else f"w{int(rng.paretovariate(0.7)) % 300}", rng.randrange(400), float(rng.choice([1, 1, 1, 2, 2, 3, rng.randrange(50), -0.0, 0.0])), 0, "x") for _ in range(8000)]
    best = {}
    for g, i, s, _, _ in rows:
        best[g, i] = max(best.get((g, i), -1e9), s)
    groups = {}
    for (g, i), s in best.items():
        groups.setdefault(g, []).append((-s, i))
    want = sorted((g, i) for g, x in groups.items() for _, i in sorted(x)[:5])
    assert top(spark.createDataFrame(rows, ITEMS), 5) == want


def test_hot_group_over_all_bands(spark):
    """A third of the rows are of one group and end up in a late band: it is ranked in parts."""
    rows = [("hot", i, 1.0, 0, "x") for i in range(4000)] + [(f"g{i % 900}", i, float(i), 0, "x") for i in range(8000)]
    df = spark.createDataFrame(rows, ITEMS)
    got = top(df, 3, hot_rows=500)
    assert got == top(df, 3)
    assert [x for x in got if x[0] == "hot"] == [("hot", 0), ("hot", 1), ("hot", 2)]
    assert len(got) == 3 * 901

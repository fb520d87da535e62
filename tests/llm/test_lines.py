import random
import re

from websift.llm import lines

NODES = "page_id long, host_name string, node_id int, text string, line string"


def found(df, **kw):
    return sorted((r.page_id, r.node_id) for r in lines.repeated_lines(df, **kw).collect())


def test_same_lines(spark):
    shapes = ["Print this page", "• PRINT  this page »", "print this page (12)", "Print this page!"]
    rows = [(p, "h", 1, shapes[p % 4], "x") for p in range(8)] + [(p, "h", 2, f"unlike{'abcdefgh'[p]} number{'abcdefgh'[p]}", "x") for p in range(8)]
    rows += [(p, "h", 3, f"Written by {n} on {p}.3.2020", "x") for p, n in enumerate(["Ana Bol", "Cid", "Dan Eck", "Fay Gil", "Hal Ivo", "Jon Kay"])]
    rows += [(8, "h", 1, None, "x"), (9, "h", 1, "", "x"), (9, "h", 2, "123 !", "x"), (1, None, 9, "Print this page", "x"), (0, "h", 1, shapes[0], "x")]
    df = spark.createDataFrame(rows, NODES)
    assert set(found(df)) == {(p, 1) for p in range(8)} | {(p, 3) for p in range(6)}
    assert found(df.where("false")) == []
    assert len(found(df)) == 14  # each node once


def test_thresholds(spark):
    rows = [(p, "small", 1, "same line" if p < 2 else f"other {chr(97 + p)}", "x") for p in range(4)] + [(p, "big", 1, "same line" if p < 103 else f"o{chr(97 + p % 26)} {chr(97 + p // 26)}", "x") for p in range(100, 130)]
    assert found(spark.createDataFrame(rows, NODES), max_filled_words=0) == []
    assert len(found(spark.createDataFrame(rows, NODES), max_filled_words=0, min_share=0.1)) == 3


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for p in range(600):
        h = "hot" if p % 3 else f"h{p % 7}"
        for n in range(6):
            rows.append((p, h, n, rng.choice([f"Menu {rng.randrange(99)}", f"word{rng.choice('abcdefghij')} line{rng.choice('abcdefghijklmnopqrstuvwxyz')} two", "ÉTÉ 5", "été"]), "x"))
    norm = lambda t: re.sub(r"[\W\d_]+", " ", t.lower()).strip()
    pages, hosts = {}, {}
    for p, h, _, t, _ in rows:
        pages.setdefault((h, norm(t)), set()).add(p)
        hosts.setdefault(h, set()).add(p)
    want = sorted((p, n) for p, h, n, t, _ in rows if len(pages[h, norm(t)]) >= max(3, 0.2 * len(hosts[h])))
    assert [x for x in found(spark.createDataFrame(rows, NODES), max_filled_words=0)] == want


def sequences(df, **kw):
    return sorted((len(r["lines"]), r["pages"]) for r in lines.frequent_sequences(df, **kw).collect())


def test_sequences(spark):
    # Five lines in order on every page, with another rare and another frequent line between them.
    five = ["alpha", "beta", "gamma", "delta", "epsilon"]
    rows = [(p, "h", 10 * n, t, "x") for p in range(10) for n, t in enumerate(five)]
    rows += [(p, "h", 15, f"rare {chr(97 + p)}{chr(98 + p)}", "x") for p in range(10)] + [(p, "h", 1 + 10 * (p % 4), "share", "x") for p in range(10)] + [(p, "h", 0, "beta", "x") for p in range(10, 14)]
    got = sequences(spark.createDataFrame(rows, NODES), max_filled_words=0)
    assert (5, 10) in got and (1, 14) in got
    assert max(n for n, _ in got) == 6
    assert sequences(spark.createDataFrame([], NODES)) == []


def test_sequences_against_brute_force(spark):
    import itertools

    rng = random.Random(11)
    pages = [("s", [rng.randrange(6) for _ in range(rng.randrange(7))], rng.randrange(1, 3)) for _ in range(14)] + [("t", [1, 2, 3, 4], 5), ("t", [1, 9, 3, 4], 2)]
    got = lines.prefix_span(spark.createDataFrame([(0 if s == "s" else 1, r, n) for s, r, n in pages], "site bigint, rest array<bigint>, n bigint"), spark.createDataFrame([(0, 4), (1, 3)], "site bigint, least bigint"))
    got = {(r.site, tuple(r["lines"])): r.pages for r in got.collect()}
    support = {}
    for s, r, n in pages:
        for q in {c for k in range(1, len(r) + 1) for c in itertools.combinations(r, k)}:
            support[int(s == "t"), q] = support.get((int(s == "t"), q), 0) + n
    frequent = {k: v for k, v in support.items() if v >= (4, 3)[k[0]]}
    inside = lambda a, b: a != b and all(x in it for it in [iter(b)] for x in a)
    closed = {k: v for k, v in frequent.items() if not any(s == k[0] and w == v and inside(k[1], q) for (s, q), w in frequent.items())}
    assert closed.items() <= got.items() <= frequent.items()
    # What the sequences delete is what single lines delete.
    assert {(s, x) for s, q in got for x in q} == {(s, q[0]) for s, q in frequent if len(q) == 1}


def test_remove(spark):
    rows = [(p, "h", n, t, "x") for p in range(5) for n, t in enumerate(["alpha", f"own {chr(97 + p)}{chr(99 + p)} text"])]
    df = spark.createDataFrame(rows, NODES)
    assert {r.node_id for r in lines.remove_lines(df, lines.repeated_lines(df, max_filled_words=0)).collect()} == {1}


def test_filled_long_lines(spark, monkeypatch):
    names = ["Ana Bol", "Cid", "Dan Eck", "Fay Gil", "Hal Ivo", "Jon Kay"]
    notice = "All texts on this page are the property of {} and may not be copied in whole or in part without a written permission"
    article = "of and the {0}a {0}b {0}c {0}d in {0}e {0}f {0}g to {0}h {0}i {0}j {0}k a {0}l"
    rows = [(p, "h", 1, notice.format(n), "x") for p, n in enumerate(names)] + [(p, "h", 2, article.format("abcdef"[p] * 3), "x") for p in range(6)]
    df = spark.createDataFrame(rows, NODES)
    assert found(df) == [(p, 1) for p in range(6)]
    monkeypatch.setattr(lines, "BROADCAST_ROWS", -1)
    assert found(df) == [(p, 1) for p in range(6)]

import random
import re

import pytest

from websift.llm import truncation

DOCS = "doc_id long, text string, source string, reason string"
WHO = ["The old harbour", "The village library", "Every gardener", "The small museum", "The ferry company"]
DOES = ["opens its doors again", "needs more volunteers", "measures rainfall every morning", "prepares a large exhibition"]
WHERE = ["in the valley", "along the canal", "behind the station", "next to the town hall"]


def text(rng, n=6):
    return "A headline\n" + "\n".join(f"{rng.choice(WHO)} {rng.choice(DOES)} {rng.choice(WHERE)}. {rng.choice(WHO)} {rng.choice(DOES)} {rng.choice(WHERE)}." for _ in range(n))


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, 3 + i % 6), "whole", "x") for i in range(400)]
    rows += [(1000 + i, text(rng, 9)[:500], "cut", "x") for i in range(120)]
    extra = {
        2000: "The village library needs more volunteers along the ca", 2001: "The old harbour opens its doors again in the&am", 2002: "The old harbour opens its doors again along the", 2003: "The old harbour opens its do [...]", 2004: "Every gardener measures rainf …",
        3000: "The old harbour opens its doors again in the valley …", 3001: text(rng) + "\nPrint this page", 3002: text(rng) + "\n#tag", 3003: text(rng) + "\n(2.3.2020)", 3004: text(rng) + "\nhttps://a.example/1", 3005: None, 3006: "", 3007: " \n ", 3008: text(rng) + "\n– Marola", 3009: text(rng) + "\nthe small museum", 3010: "The old harbour needs more volunteers along the canal:",
        3011: text(rng) + "\nPrint this page", 3012: text(rng) + "\nPrint this page", 3013: "東の港で小さな市が開かれる",
    }
    rows += [(k, t, "extra", "x") for k, t in extra.items()] + [(None, "The village library needs more volunteers along the ca", None, "x"), (2005, "The village library needs more volunteers along the ca", None, "x"), (2005, "The village library needs more volunteers along the ca", None, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    cut = truncation.truncated(docs)
    return {r.doc_id: r.reason for r in cut.collect()}, {r.source: r for r in truncation.cut_shares(docs, cut).collect()}, rows


def test_found(found):
    got, _, rows = found
    assert {k for k in got if k >= 2000} == {2000, 2001, 2002, 2003, 2004, 2005}
    assert not any(k < 1000 for k in got)
    open_ends = {k for k, t, s, _ in rows if s == "cut" and not t.rstrip().endswith(".")}
    assert len(open_ends - set(got)) <= 0.02 * len(open_ends)
    assert not {k for k, t, s, _ in rows if s == "cut" and t.rstrip().endswith(".")} & set(got)


def test_shares(found):
    got, shares, _ = found
    assert shares["whole"].n_cut == 0 and shares["cut"].share > 0.8 and shares[None].n_cut == 1
    assert sum(r.n_cut for r in shares.values()) == len(got)


def test_hazards(spark):
    rng = random.Random(1)
    lengths = [("a", "chars", rng.randrange(200, 2000)) for _ in range(3000)] + [("a", "chars", 1000)] * 60 + [("b", "chars", rng.randrange(200, 2000)) for _ in range(3000)] + [("b", "chars", 1000)]
    got = truncation.hazards(spark.createDataFrame(lengths, "source string, unit string, length long")).collect()
    assert [(r.source, r.length) for r in got] == [("a", 1000)]


def test_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert truncation.truncated(docs).count() == 0 and truncation.cut_shares(docs, truncation.truncated(docs)).count() == 0


def test_whole_looking_ends_at_a_limit(spark):
    rng = random.Random(7)
    rows = [(i, text(rng, 3 + i % 6), "cut", "x") for i in range(300)] + [(1000 + i, text(rng, 9)[:500], "cut", "x") for i in range(60)]
    ends = {2000: " (Sobaru, 25.2.20", 2001: " It took 800 hours, 43", 2002: " They bring three things:", 3000: " It closed early (2.3.2020).", 3001: " 東の港で小さな市が開かれる。"}
    rows += [(k, text(rng, 9)[: 500 - len(t)] + t, "cut", "x") for k, t in ends.items()]
    rows += [(2003, ("東の港で小さな市が開かれる。" * 50)[:500 - 5] + "東の港で小", "cut", "x")]
    rows += [(3002, text(rng, 4) + ends[2000] + "2", "cut", "x"), (3003, "東の港で小さな市が開かれる", "cut", "x")]
    got = {r.doc_id for r in truncation.truncated(spark.createDataFrame(rows, DOCS)).collect()}
    assert {k for k in got if k >= 2000} == {2000, 2001, 2002, 2003}


def test_marks_of_any_length(spark):
    rng = random.Random(9)
    rows = [(i, text(rng, 3 + i % 6), "cut", "x") for i in range(200)]
    open_end = "The old harbour opens its doors again along the ca"
    rows += [(2000, open_end + "." * 90, "cut", "x"), (2001, open_end + "\ufffd" * 90, "cut", "x"), (2002, open_end + " [" + " " * 60 + "..." + " " * 60 + "]", "cut", "x"), (2003, open_end + " " * 90 + "\u2026", "cut", "x")]
    rows += [(3000, "The old harbour opens its doors again along the canal " + "." * 90, "cut", "x")]
    got = {r.doc_id for r in truncation.truncated(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {2000, 2001, 2002, 2003}


def test_hot_sentence_start(spark):
    """A third of all word pairs begin a sentence; each asked word meets its own beginnings only."""
    rows = [("." if i % 3 else f"w{i % 50}", f"{'abc'[i % 3]}{'xyz'[i % 7 % 3] * (i % 9)}", 1 + i % 4, i % 2) for i in range(3000)]
    asked = [(".", "a"), (".", "bx"), ("w7", "cz"), (".", "none"), ("w7", "c")]
    table = spark.createDataFrame(rows, "prev string, word string, n long, n_end long").groupBy("prev", "word").sum("n", "n_end").toDF("prev", "word", "n", "n_end")
    got = {(r.prev, r.last): (r.n or 0, r.n_longer or 0, r.n_any or 0) for r in truncation.continuations(table, spark.createDataFrame(asked, "prev string, last string")).collect()}
    for p, w in asked:
        follow = [x for x in rows if x[0] == p and x[1].startswith(w)]
        assert got[p, w] == (sum(x[2] for x in follow if x[1] == w), sum(x[2] for x in follow if x[1] != w), sum(x[2] for x in rows if x[1] == w))


def test_word_pairs_against_plain_python(spark):
    rng = random.Random(4)
    texts = [text(rng, rng.randrange(4)) + rng.choice(["", ".", " open end", "!?", " ...", "\n\n", " 3.5 x"]) for _ in range(300)] + [None, "", " . ", "...", "one", "Eins. zwei", "a\n\nb: c", "日本。語 é́x", ".start", "a . b"]
    want = {}
    for t in texts:
        if t is None:
            continue
        t = t.rstrip()
        t = re.sub(truncation.MARK.replace("\\x{FFFD}", "\ufffd"), "", t)
        stream = ["."]
        for part in re.split(r"[^\w.]+|_", re.sub("[!?:…]", ".", t.lower()).replace("\n", ". ").replace("\u0301", "")):
            stream += [x for x in (part.rstrip("."), "." if part.endswith(".") else "") if x]
        for i in range(len(stream) - 2):
            if stream[i + 1] != ".":
                n, k = want.get((stream[i], stream[i + 1]), (0, 0))
                want[stream[i], stream[i + 1]] = (n + 1, k + (stream[i + 2] == "."))
    df = spark.createDataFrame([(t.replace("\u0301", "") if t else t,) for t in texts], "text string")
    got = {(r.prev, r.word): (r.n, r.n_end) for r in truncation.word_pairs(df).collect()}
    assert got == want

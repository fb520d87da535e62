import pytest

from websift.llm import mixing

DOCS = "doc_id long, text string, source string, position string"
TARGETS = "mix_id int, source string, target_share double, max_repeats int"


@pytest.fixture(scope="module")
def result(spark):
    docs = [(i, "some words in a text " * (1 + i % 7), "hot" if i % 3 else "cold", "x") for i in range(900)]
    docs += [(i, "a small source has few words", "small", "x") for i in range(900, 910)] + [(1000, None, "small", "x"), (1001, "", "small", "x"), (None, "a", "small", "x"), (1002, "a", None, "x"), (900, "a small source has few words", "small", "x")]
    targets = [(1, "hot", 0.6, 1), (1, "cold", 0.4, 2), (2, "small", 0.5, 3), (2, "hot", 0.5, 1), (3, "absent", 0.5, 4), (3, "hot", 0.25, 1), (3, "cold", 0.25, 1), (3, "small", 0.0, 1), (4, "absent", 1.0, 1), (5, "hot", None, 1), (None, "hot", 1.0, 1)]
    positions, plan = mixing.mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), rows_a_bucket=50)
    return positions.collect(), {(r.mix_id, r.source): r for r in mixing.shares(positions, plan).collect()}, positions


def test_shares(result):
    rows, shares, _ = result
    want = {(1, "hot"): 0.6, (1, "cold"): 0.4, (2, "small"): 0.5, (2, "hot"): 0.5, (3, "absent"): 0, (3, "hot"): 0.5, (3, "cold"): 0.5, (3, "small"): 0, (4, "absent"): 0, (5, "hot"): 0}
    assert shares.keys() == want.keys() and all(abs(shares[k].reached_share - v) < 0.02 for k, v in want.items())
    assert all(r.most_repeats <= (r.max_repeats or 1) for r in shares.values())
    assert shares[2, "small"].most_repeats == 3 and shares[2, "small"].documents_used == 30
    uses = [(r.mix_id, r.source, r.doc_id, r.copy) for r in rows]
    assert len(uses) == len(set(uses)) and all(0 <= r.position <= 1 for r in rows)


def test_curriculum(result):
    rows, _, positions = result
    # What may be repeated more comes later, and at each time the two sources together have met the demand so far.
    mean = lambda s: sum(r.position * r.n_tokens for r in rows if r.mix_id == 1 and r.source == s) / sum(r.n_tokens for r in rows if r.mix_id == 1 and r.source == s)
    assert mean("cold") > 0.52 > 0.5 > mean("hot")
    total = sum(r.n_tokens for r in rows if r.mix_id == 1)
    for t in (0.25, 0.5, 0.75):
        assert abs(sum(r.n_tokens for r in rows if r.mix_id == 1 and r.position < t) / total - t) < 0.02
    ordered = [(r.mix_id, r.position) for r in mixing.order_by_position(positions).collect()]
    assert ordered == sorted(ordered)


def test_nothing(spark):
    positions, plan = mixing.mix(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a", 1.0, 1)], TARGETS))
    assert positions.count() == 0 and mixing.shares(positions, plan).first().reached_share == 0
    positions, plan = mixing.mix(spark.createDataFrame([(1, "a b", "a", "x")], DOCS), spark.createDataFrame([], TARGETS))
    assert positions.count() == 0 and mixing.shares(positions, plan).count() == 0


def test_given_schedule(spark):
    sizes = spark.createDataFrame([("a", 1000, 10), ("b", 1000, 10)], "source string, tokens long, docs long")
    slopes = lambda a, b: {r.source: round(r.slope, 6) for r in mixing.plan(sizes, spark.createDataFrame([(1, "a", 0.5, 1, a), (1, "b", 0.5, 1, b)], TARGETS + ", slope double")).collect()}
    assert slopes(0.4, -0.4) == {"a": 0.4, "b": -0.4} and slopes(0.6, 0.0) == {"a": 0.3, "b": -0.3} and slopes(9.0, -9.0) == {"a": 1.0, "b": -1.0} and slopes(None, None) == {"a": 0.0, "b": 0.0}

import hypothesis.strategies as st
import pytest
from hypothesis import given, settings

from websift.llm import encode


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=80))
def test_ids_and_round_trip(reference, text):
    ids = encode.encoder().encode([text])[0]
    assert ids == reference.encode(text, add_special_tokens=False).ids
    assert encode.encoder().decode(ids) == text


def test_edges(reference):
    texts = ["a\x1cb \x1d\x85", "<|endoftext|> x", "x" * 20_000, " " * 3000 + "x", "I'LL don't", "\r\n\r\n a", "日本語" * 200, "👩‍👩‍👧", "\x00"]
    assert encode.encoder().encode(texts) == [reference.encode(t, add_special_tokens=False).ids for t in texts]
    assert encode.encoder().encode([None, "", " "]) == [[], [], [220]]


def test_table(spark):
    df = spark.createDataFrame([(1, "a b", 5), (2, None, 5), (3, "", 5), (None, "a", 5), (1, "a b", 5)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id or 0, r.ids) for r in encode.token_ids(df).collect())
    assert got == [(0, [64]), (1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    assert encode.token_ids(df.where("false")).count() == 0
    assert {r.doc_id: r.n_tokens for r in encode.token_counts(df).collect()} == {1: 2, 2: 0, 3: 0, None: 1}

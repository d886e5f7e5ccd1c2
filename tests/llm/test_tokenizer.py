import base64

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from threshline.llm.tokenizer import DEFAULT_VOCABULARY, PATTERN, Encoder, encode_corpus


@pytest.fixture(scope="module")
def both():
    with open(DEFAULT_VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Encoder(DEFAULT_VOCABULARY), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.sampled_from(["the ", "  \n", "don't", "<|endoftext|>", "aaaa", "\x1c", "　", "漢字かな", "👩‍👩‍👧", "0x1f", "́"])), max_size=12))
def test_agrees_with_the_public_encoder(both, parts):
    text = "".join(parts)
    text = text.encode("utf-8", "ignore").decode()
    assert both[0].encode(text) == both[1].encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 5000, "=-" * 3000, "ab" * 999 + "é" * 999, "\n" * 4000, "漢" * 700, "x" * 129, "x" * 130, "x" * 131, "q z" * 50])
def test_long_pretokens(both, text):
    assert both[0].encode(text) == both[1].encode_ordinary(text)


def test_batches_keep_their_rows(both):
    texts = ["one two", None, "", "two one", "one two"]
    ids, offsets = both[0].encode_batch(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [both[1].encode_ordinary(t) if t else [] for t in texts]


def test_corpus(spark, both):
    rows = [(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (1, "hello world", "x"), (None, "a", None)]
    got = encode_corpus(spark.createDataFrame(rows, "doc_id LONG, text STRING, ids STRING")).collect()
    assert sorted((r.doc_id or 0, tuple(r.ids)) for r in got) == sorted((d or 0, tuple(both[1].encode_ordinary(t)) if t else ()) for d, t, _ in rows)
    assert encode_corpus(spark.createDataFrame([], "doc_id LONG, text STRING")).collect() == []

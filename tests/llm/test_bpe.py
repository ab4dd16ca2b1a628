from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lithoscope.llm import bpe

pytestmark = pytest.mark.skipif(not Path(bpe.TOKENIZER_DIR).exists(), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    e = bpe.Encoder()
    return e, lambda s: t.encode(s, add_special_tokens=False).ids


TEXTS = ["", "Hello world", "<|endoftext|> ordinary", "a" * 4000, " " * 2000 + "x", "ab" * 3000, "naïve café 日本語 🙂🇺🇳", "\x00\x01\x7f", "I've x'LL 12³", "\r\n\t  \n a", "e\u0301" * 500]


@pytest.mark.parametrize("text", TEXTS)
def test_known(pair, text):
    e, reference = pair
    assert e.encode(text) == reference(text)


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_any_text(text):
    e = test_any_text.__dict__.setdefault("e", bpe.Encoder())
    ids = e.encode(text)
    assert b"".join(e.token[i] for i in ids).decode("utf-8", "replace") == text.encode("utf-8", "replace").decode("utf-8", "replace")


def test_queue():
    q = bpe.RankQueue(50_000)
    for r, p in ((49_999, 1), (3, 2), (64, 3), (3, 4), (4096, 5)):
        q.push(r, p)
    assert [q.pop() for _ in range(5)] == [(3, [2, 4]), (64, [3]), (4096, [5]), (49_999, [1]), None]


def test_operator(spark):
    rows = [(1, "ab cd", "x", "y"), (2, None, "x", "y"), (3, "", "x", "y"), (1, "ab cd", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, __text string")
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.encode_texts(df, ["doc_id"]).collect())
    e = bpe.Encoder()
    assert got == [(1, e.encode("ab cd"))] * 2 + [(2, []), (3, [])]
    assert bpe.encode_texts(df.limit(0), ["doc_id"]).count() == 0
    assert {r.tokens for r in bpe.encode_texts(df, ["doc_id"], lengths_only=True).collect()} == {0, 2}

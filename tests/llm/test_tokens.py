import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Public

from pointlake.llm import bpe, tokens


@pytest.fixture(scope="module")
def mine():
    return bpe.load(bpe.default_path())


@pytest.fixture(scope="module")
def public():
    t = Public.from_file(bpe.default_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


ODD = ["", " ", "\n\n  x", "don't I'LL we've", "<|endoftext|> is text", "a" * 5000, "=" * 3000, "あいう 🧭🧪 ไทย", "\x00\x01é é", "x    y​", "1234567890" * 300, "\r\n\t mixed ", "ＡＢＣ　ｄ", "\U0010ffff"]


@pytest.mark.parametrize("text", ODD)
def test_as_the_public_library(mine, public, text):
    assert mine.encode(text) == public(text)
    assert "".join(bpe.decode(mine.merges, mine.encode(text))) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=400))
def test_any_text(mine, public, text):
    text = text.encode("utf-8", "ignore").decode()
    assert mine.encode(text) == public(text)


def test_the_lookahead_suffices(mine):
    """Whatever follows, tokens that end the lookahead before a window's end stay."""
    rng, m = random.Random(3), mine.merges
    assert 0 < m.lookahead < 2000
    for alphabet in (b"ab", b"the anding ", b"=-*/#", bytes(range(97, 123)), bytes(range(256)), b" \n"):
        for _ in range(25):
            data = bytes(rng.choice(alphabet) for _ in range(m.lookahead * 2 + rng.randrange(300)))
            short, long = m.encode_window(data), m.encode_window(data + bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, 400))))
            end = 0
            for a, b in zip(short, long):
                end += len(m.bytes_of[a])
                if end > len(data) - m.lookahead:
                    break
                assert a == b


def test_constant_memory(mine):
    t, seen = bpe.Transducer(mine.merges, block=64), []
    piece = "".join(random.Random(1).choice("abcdefgh") for _ in range(20_000)).encode()
    for i in range(0, len(piece), 10):
        seen += t.feed(piece[i : i + 10])
        assert len(t.window) <= mine.merges.lookahead + 64 + 10
    assert seen + t.finish() == mine.merges.encode_window(piece)


def test_decoder_keeps_split_characters(mine):
    d, out = bpe.ByteToText(mine.merges), []
    for i in mine.encode("🧭é"):
        out.append(d.feed([i]))
    assert "".join(out) + d.finish() == "🧭é" and "�" not in "".join(out)


def test_tables(spark):
    docs = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (3, None), (None, "x"), (5, "long " * 50_000)], "doc_id bigint, text string").selectExpr("*", "'clash' as ids", "1 as _id", "2 as n_tokens")
    got = [(r["doc_id"], r["ids"]) for r in tokens.encode(docs).collect()]
    assert sorted((k, len(v)) for k, v in got if k) == [(1, 2), (2, 0), (3, 0), (3, 0), (5, 50_001)] and all(v is not None for _, v in got)
    assert dict(tokens.encode(docs).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count(docs).collect()}[5] == 50_001
    back = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(docs)).collect()}
    assert back[1] == "Hello world" and back[3] == "" and back[5] == "long " * 50_000
    assert tokens.encode(docs.limit(0)).count() == 0

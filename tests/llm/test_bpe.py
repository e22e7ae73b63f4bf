import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import bpe, queries

V = bpe.Vocabulary.read(public_tokenizers.path(queries.VOCABULARY))
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=V.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=60), st.binary(max_size=10), st.integers(0, 60), st.integers(0, 20))
def test_appends_and_edits_match_the_definition(data, more, start, removed):
    e = bpe.PrefixEncoder(V, data)
    assert e.tokens() == V.merge(data)
    for i in range(0, len(data), 7):
        assert e.tokens(i) == V.merge(data[:i])
    e.append(more)
    data += more
    assert e.tokens() == V.merge(data)
    start = min(start, len(data))
    removed = min(removed, len(data) - start)
    e.edit(start, removed, more)
    assert e.tokens() == V.merge(data[:start] + more + data[start + removed:])


def test_edits_stay_near():
    data = " ".join(str(i * 37 % 1000) for i in range(2000)).encode()
    e = bpe.PrefixEncoder(V, data)
    assert e.edit(3000, 2, b"xyz") < 200 and e.tokens() == bpe.PrefixEncoder(V, data[:3000] + b"xyz" + data[3002:]).tokens()
    with pytest.raises(ValueError):
        e.edit(len(e.data), 1, b"")


def test_neighbours_match_the_definition():
    rng = random.Random(0)
    short = [r for t, r in V.ranks.items() if len(t) < 4 and not t.strip(b"aeitnsr ")]
    for i in range(20_000):
        a, b = rng.choices(short if i % 2 else list(V.ranks.values())[:3000], k=2)
        assert V.follows(a, b) == (V.merge(V.bytes_of[a] + V.bytes_of[b]) == [a, b])


def test_query_matches_the_library(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.byte_pairs(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        t = docs[r["doc_id"]]
        ids = TIKTOKEN.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_odd_texts(spark):
    texts = [None, "", "  \n\n x", "<|endoftext|>", "é" * 3000, "a" * 5000, "🙂   中文字符", "it's they'LL"]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id int, text string, n_tokens int")
    got = {r["doc_id"]: r for r in bpe.encode_bpe(df, "text", public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == TIKTOKEN.encode_ordinary(t or "")
    assert bpe.encode_bpe(df.limit(0), "text", public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN).count() == 0


def test_whole_tokens_are_not_filled(monkeypatch):
    """Pieces that are tokens stand for themselves without a pass over their bytes; others, and the empty one, keep their order."""
    from paperloom.llm import bpe

    v = bpe.Vocabulary({bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"cd": 258})
    seen, fill = [], bpe.fill
    monkeypatch.setattr(bpe, "fill", lambda v, text, last: seen.append(text) or fill(v, text, last))
    pieces = [b"abc", b"abcd", b"", b"ab", b"cdab", b"x"]
    assert bpe.encode_all(v, pieces) == [v.merge(p) for p in pieces]
    assert seen == ["abcdĀĀcdab"]

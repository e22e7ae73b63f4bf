"""What happens to very long texts, and to rows that are repeated."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from paperloom.llm import bpe, flac, mil, ordinal, queries, simhash


def wave(n):
    return (np.arange(n, dtype=np.int64) ** 2 // 900 % 97 + 30).astype(np.uint8).tobytes()


@pytest.mark.parametrize("size", [1, 2047, 2048, 2049, 6144, 10_001])
def test_runs_of_frames_give_the_same_stream(monkeypatch, size):
    p = wave(size)
    whole = flac.encode_batch([p, b"x"])
    monkeypatch.setattr(flac, "CHUNK", 2048)
    assert flac.encode_batch([p, b"x"]) == whole
    assert [b"".join(b[3] for b in d[0]) for d in flac.decode_batch(whole)] == [p, b"x"]


def test_thinned_seek_tables(monkeypatch):
    p = wave(20_000)
    whole = flac.encode_batch([p])[0]
    monkeypatch.setattr(flac, "MOST_POINTS", 7)
    thin = flac.encode_batch([p])[0]
    assert len(whole) - len(thin) == 18 * (40 - 7)  # 40 frames, every sixth has a point
    (blocks, _, error), = flac.decode_batch([thin])
    assert error is None and b"".join(b[3] for b in blocks) == p and len(blocks) == 40


@pytest.mark.parametrize("words", [1, 3, 5])
@pytest.mark.parametrize("most", [1, 2, 7, 30])
def test_shingles_of_blocks(words, most):
    rng = random.Random(words * 100 + most)
    for n in (0, 1, 2, 3, 4, 5, 6, 40, 300):
        text = "".join(rng.choice(["", " ", "\n\t "]) + "".join(rng.choice("abCé") for _ in range(rng.randrange(1, 12))) + rng.choice(" \r\x0b") for _ in range(n)).encode()
        w = text.lower().split()
        want = [b" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
        assert [s for block in simhash.shingle_blocks(text, words, most) for s in block] == want


def test_texts_of_megabytes(spark):
    rng = random.Random(3)
    few = ["alpha", "Bravo's", "12345", "été", "delta\n\n", "…", "  x"]
    long = " ".join(rng.choice(few) + str(rng.randrange(1000)) for _ in range(260_000))
    assert len(long) > 8 * bpe.BLOCK and len(long.encode()) > flac.CHUNK
    df = spark.createDataFrame([(0, long), (1, "short"), (2, long)], "doc_id int, text string")
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Vocabulary.read(public_tokenizers.path(queries.VOCABULARY)).ranks, special_tokens={})
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode_bpe(df, "text", public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN).collect()}
    assert ids[0] == ids[2] == known.encode_ordinary(long) and ids[1] == known.encode_ordinary("short")
    prints = {r["doc_id"]: r["fingerprint"] for r in simhash.simhash(df, "text", 3).collect()}
    w = long.lower().encode().split()
    h = simhash._hashes([b" ".join(w[i:i + 3]) for i in range(len(w) - 2)])
    bits = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    assert prints[0] == prints[2] and prints[0] & (1 << 64) - 1 == bits
    media = flac.encode_flac(df.withColumn("payload", df["text"].cast("binary")), "payload")
    back = {r["doc_id"]: b"".join(bytes(b["pcm"]) for b in r["blocks"]) for r in flac.decode_flac(media).collect()}
    assert {k: hashlib.sha256(v).hexdigest() for k, v in back.items()} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in ((0, long), (1, "short"), (2, long))}


def test_repeated_rows_are_scored_alike(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["good", "fine", "bad", "vilo", "plain"]) for _ in range(30 + i)) for i in range(40)] + ["", "tie"]
    rows = [(i % 42, texts[i % 42]) for i in range(126)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, quality int")
    scored = mil.score(df, "text", mil.train(df, labels, "doc_id", "text", "quality")).collect()
    severe = ordinal.score(df, "text", ordinal.train(df, labels, "doc_id", "text", "quality")).collect()
    for rows, name in ((scored, "score"), (severe, "severity")):
        by_text = {}
        for r in rows:
            by_text.setdefault(r["text"], []).append(r[name])
        assert len(rows) == 126 and all(len(v) % 3 == 0 and max(v) - min(v) < 1e-9 for v in by_text.values())

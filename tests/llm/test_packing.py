"""Packing against the tokenizers library itself, plain best-fit, and bounds on the number of sequences."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from paperloom.llm import packing
from paperloom.llm.packing import Packer, WordEncoder, pack_texts, sequences

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda x: tokenizer.encode(x, add_special_tokens=False).ids


ODD = ["", " ", "\n\n", "Don't, DON'T!? it's''s", "  two  spaces \t tab\x0bvt nbsp em\x85nel\x1cfs", "ΑΣ ΣΑΣ. Σ, İI ıi.", "é e ́x ñ. ≮ a̸.", "12 3½, ⅷ. ٣. 四, x²!", "<|startoftext|> a<|endoftext|>, </w>",
       "»...« é»... naïve!!! Ünïcödé###", "日本語 テスト。 한국어, עברית.", "👍🏽, 👨‍👩‍👧.", "a" * 5000, "ab1c2--d_e", "﻿bom ​zero. ﬁ ǅ.", "ß. ẞ! Ǆ, K. Å."]


def test_words_as_the_library_encodes_texts(plain):
    encoder = WordEncoder(PATH)
    for _ in range(2):
        for x, ids in zip(ODD, encoder.encode(ODD)):
            assert np.frombuffer(ids, "<u4").tolist() == plain(x), x


def test_random_texts_and_a_small_memory(plain, monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 40)
    rng = random.Random(3)
    letters = "abcDEZ019 '.,#\n\t ́éÉßİΣσ 本̸<&-_"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(400)]
    encoder = WordEncoder(PATH)
    for at in range(0, 400, 7):
        for x, ids in zip(texts[at : at + 7], encoder.encode(texts[at : at + 7])):
            assert np.frombuffer(ids, "<u4").tolist() == plain(x), repr(x)


def best_fit(lengths, room, most):
    """Plain best-fit over a list of open sequences."""
    held, out = [], []
    for n in lengths:
        fits = [h for h in held if sum(h) + n <= room]
        if fits:
            h = max(fits, key=sum)
        else:
            if len(held) == most and n < room:
                out.append(held.pop(max(range(len(held)), key=lambda i: sum(held[i]))))
            held.append(h := [])
        h.append(n)
        if sum(h) == room:
            out.append(h)
            held = [x for x in held if x is not h]
    return out, held


@pytest.mark.parametrize("most", [1, 3, 50])
def test_packer_against_plain_best_fit(most):
    rng = random.Random(most)
    lengths = [min(100, int(rng.expovariate(1 / 30)) + 1) for _ in range(700)]
    packer, closed = Packer(100, most), []
    for n in lengths:
        closed += packer.add(n, n)
        assert packer.open <= most
    rest = list(packer.rest())
    want, open_ = best_fit(lengths, 100, most)
    # of sequences that are equally full, either may be taken, which leaves the same fill
    assert Counter(sum(n for _, n in s) for s in closed) == Counter(map(sum, want))
    assert sorted(sum(n for _, n in s) for s in rest) == sorted(map(sum, open_))
    for s in [*closed, *rest]:
        assert [o for o, _ in s] == np.cumsum([0, *[n for _, n in s][:-1]]).tolist()


def whole(got, texts, plain, room):
    """Every document's pieces cover it, and every sequence's pieces lie without gaps."""
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        ids = [*plain(texts[d] or ""), 1]
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // room)))
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == room * r["piece"] and r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        assert all(r["length"] == room for r in own[:-1])
    for own in by_seq.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= room
    return len(by_seq)


def test_documents(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = pack_texts(docs, "doc_id", "text", PATH).collect()
    n = whole(got, texts, plain, 4096)
    assert n <= 1.02 * sum(r["length"] for r in got) / 4096 + 1


def test_rests_are_packed_in_steps(spark, plain, monkeypatch):
    monkeypatch.setattr(packing, "OPEN", 2)
    monkeypatch.setattr(packing, "SHRINK", 2)
    rng = random.Random(5)
    texts = {i: " ".join(rng.choices(["one", "two", "three!"], k=rng.choice([0, 1, 5, 9, 40]))) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(23)
    got = pack_texts(docs, "doc_id", "text", PATH, room=16).collect()
    n = whole(got, texts, plain, 16)
    assert n <= 1.25 * sum(r["length"] for r in got) / 16


def test_odd_rows_and_clashing_names(spark, plain):
    rows = [(None, "a b", 1, True), (7, None, 2, False), (7, "", 3, None), (8, "x " * 9000, 4, None), (9, "same text", 5, None), (9, "same text", 6, None)]
    docs = spark.createDataFrame(rows, "id long, t string, piece int, open boolean")
    got = pack_texts(docs, "id", "t", PATH, with_ids=True)
    seen = got.collect()
    assert got.columns == ["id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    assert Counter(r["id"] for r in seen) == {None: 1, 7: 2, 8: 3, 9: 2}
    joined = sequences(got).collect()
    assert sum(r["n_tokens"] for r in joined) == sum(r["length"] for r in seen) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in joined)
    by = {r["sequence_id"]: r["ids"] for r in joined}
    for r in seen:
        assert by[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"]
    assert pack_texts(docs.limit(0), "id", "t", PATH).collect() == []

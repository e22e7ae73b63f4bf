import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import flac, queries


def joined(decoded):
    return b"".join(b[3] for b in decoded[0])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=1500), min_size=1, max_size=4))
def test_round_trip(payloads):
    coded = flac.encode_batch(payloads, (0, 1, 2, 3, 4))
    assert [joined(d) for d in flac.decode_batch(coded)] == payloads
    assert coded == [flac.encode_batch([p], (0, 1, 2, 3, 4))[0] for p in payloads]


def test_signals_use_every_kind_of_frame():
    rng = random.Random(1)
    wave = bytes(int(128 + 90 * ((i % 200) / 200 - 0.5) ** 2) for i in range(3000))
    for p in (bytes(3000), wave, bytes((i * i // 700) % 256 for i in range(2500)), bytes(rng.randrange(256) for _ in range(2000)), b"x" * 511 + b"y"):
        coded = flac.encode_batch([p], (0, 1, 2, 3, 4))
        blocks, rate, error = flac.decode_batch(coded)[0]
        assert error is None and rate == flac.RATE and b"".join(b[3] for b in blocks) == p
        assert [b[0] for b in blocks] == list(range(0, len(p), flac.BLOCK))
        for offset, n, at, pcm in blocks:  # every offset can be reached by itself
            first, size, head = flac._parse_header(coded[0], at + 0, flac.BLOCK)
            assert (first, size) == (offset, n) == (offset, len(pcm))


def test_damage_is_found_and_seek_table_is_optional():
    p = bytes((i * 7 + i * i // 50) % 251 for i in range(4000))
    whole = flac.encode_batch([p])[0]
    for at in (60, len(whole) // 2, len(whole) - 1):
        bad = bytearray(whole)
        bad[at] ^= 1
        blocks, _, error = flac.decode_batch([bytes(bad)])[0]
        assert error or b"".join(b[3] for b in blocks) == p  # a seek point may be wrong without harm
    assert flac.decode_batch([whole[:-1]])[0][2] and flac.decode_batch([b"RIFF"])[0][2] and flac.decode_batch([whole[:30]])[0][2]
    table = int.from_bytes(whole[43:46], "big")
    bare = whole[:4] + bytes([0x80]) + whole[5:42] + whole[46 + table:]
    assert joined(flac.decode_batch([bare])[0]) == p


def test_checksums():
    assert flac.crc8(b"123456789") == 0xF4
    import numpy as np
    data = np.frombuffer(b"123456789" + bytes(range(256)) * 40, np.uint8)
    got = flac.crc16_of_ranges(data, np.array([0, 0, 9]), np.array([9, len(data), len(data)]))

    def slow(x):
        out = 0
        for b in x:
            out = int(flac._T16[out >> 8 ^ b]) ^ out << 8 & 0xFFFF
        return out
    assert got[0] == 0xFEE8 and got.tolist() == [slow(data[a:b].tolist()) for a, b in ((0, 9), (0, len(data)), (9, len(data)))]


def test_columns_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(1, b"abc", "x"), (2, None, "y"), (3, b"", None)], "id int, payload binary, media string")
    coded = flac.encode_flac(df, "payload")
    rows = {r["id"]: r for r in flac.decode_flac(coded).collect()}
    assert rows[1]["blocks"][0]["pcm"] == b"abc" and rows[2]["blocks"] is None and rows[3]["media"] is None
    assert flac.pcm_blocks(flac.decode_flac(coded), "id").count() == 1
    assert flac.decode_flac(flac.encode_flac(df.limit(0), "payload")).count() == 0


def test_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.media(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        b = docs[r["doc_id"]].encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        coded = flac.encode_batch([p])[0]
        assert (r["media_bytes"], r["media_sha256"], r["error"]) == (len(coded), hashlib.sha256(coded).hexdigest(), None)

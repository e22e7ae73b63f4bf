"""FLAC streams put together bit by bit here, after the format's description, with checksums of their own; and op1's feature."""

import hashlib
import zlib

import pytest

from paperloom.llm import flac, queries

BLOCK = 16


class Bits:
    def __init__(self):
        self.s = ""

    def add(self, value, width):
        self.s += format(value & (1 << width) - 1, f"0{width}b") if width else ""

    def rice(self, residuals, k):
        for r in residuals:
            u = 2 * r if r >= 0 else -2 * r - 1
            self.s += "0" * (u >> k) + "1"
            self.add(u, k)

    def bytes(self):
        s = self.s + "0" * (-len(self.s) % 8)
        return int(s, 2).to_bytes(len(s) // 8, "big")


def crc(data, poly, width):
    out = 0
    for b in data:
        out ^= b << width - 8
        for _ in range(8):
            out = (out << 1 ^ (poly if out >> width - 1 else 0)) & (1 << width) - 1
    return out


def frame(number, n, body):
    """Header with an 8-bit block size, the subframe that `body` writes, padding, checksum."""
    head = bytes([0xFF, 0xF8, 0x60, 0x02, number, n - 1])
    b = Bits()
    body(b)
    whole = head + bytes([crc(head, 0x07, 8)]) + b.bytes()
    return whole + crc(whole, 0x8005, 16).to_bytes(2, "big")


def stream(frames, samples):
    info = BLOCK.to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big")
    info += hashlib.md5(bytes(x & 255 for x in samples)).digest()
    return b"fLaC" + bytes([0x80, 0, 0, len(info)]) + info + b"".join(frames)


def differences(x, order):
    for _ in range(order):
        x = [b - a for a, b in zip(x, x[1:])]
    return x


SMOOTH = [3 * i - 40 + i * i // 5 for i in range(BLOCK)]
ROUGH = [(i * 37 + 11) % 120 - 60 for i in range(BLOCK)]


def fixed_with_escape(b):
    """Order 2 in two partitions: one Rice-coded, one of raw residuals."""
    b.add(0b0_001010_0, 8)
    for x in SMOOTH[:2]:
        b.add(x, 8)
    r = differences(SMOOTH, 2)
    b.add(0, 2), b.add(1, 4)
    b.add(2, 4), b.rice(r[:6], 2)
    b.add(15, 4), b.add(6, 5)
    for x in r[6:]:
        b.add(x, 6)


def linear(b):
    """Two coefficients of five bits, shifted by two."""
    b.add(0b0_100001_0, 8)
    for x in SMOOTH[:2]:
        b.add(x, 8)
    b.add(4, 4), b.add(2, 5), b.add(7, 5), b.add(-3, 5)
    b.add(0, 2), b.add(0, 4), b.add(3, 4)
    b.rice([SMOOTH[i] - (7 * SMOOTH[i - 1] - 3 * SMOOTH[i - 2] >> 2) for i in range(2, BLOCK)], 3)


def verbatim(b):
    b.add(0b0_000001_0, 8)
    for x in ROUGH:
        b.add(x, 8)


def constant(b):
    b.add(0, 8), b.add(-7, 8)


def wide_rice(b):
    """Order 0, with parameters of five bits."""
    b.add(0b0_001000_0, 8)
    b.add(1, 2), b.add(0, 4), b.add(4, 5), b.rice(ROUGH[:5], 4)


CASES = {"fixed": (fixed_with_escape, SMOOTH), "linear": (linear, SMOOTH), "verbatim": (verbatim, ROUGH), "constant": (constant, [-7] * BLOCK), "wide": (wide_rice, ROUGH[:5])}


@pytest.mark.parametrize("kinds", [[k] for k in CASES] + [["fixed", "linear", "verbatim", "constant", "wide"]])
def test_streams_made_by_hand(kinds):
    samples = [x for k in kinds for x in CASES[k][1]]
    whole = stream([frame(i, len(CASES[k][1]), CASES[k][0]) for i, k in enumerate(kinds)], samples)
    blocks, rate, error = flac.decode_batch([whole])[0]
    assert error is None and rate == 8000
    assert b"".join(b[3] for b in blocks) == bytes(x + 128 for x in samples) and [b[0] for b in blocks] == [BLOCK * i for i in range(len(kinds))]
    bad = whole[:-3] + bytes([whole[-3] ^ 1]) + whole[-2:]
    assert flac.decode_batch([bad])[0][2] == "frame checksum"


def test_feature(spark, sf):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.media(spark, sf).select("doc_id", "feature").collect():
        b = docs[r["doc_id"]]
        p = b + bytes(-len(b) % 64 if b else 64)
        starts = range(0, len(p), flac.BLOCK)
        n, offset, at, total = map(int, r["feature"].split(":"))
        assert (n, offset, total) == (len(starts), starts[-1], sum(zlib.crc32(p[i:i + flac.BLOCK]) for i in starts))
        assert flac.encode_batch([p])[0][at:at + 2] == b"\xff\xf8"

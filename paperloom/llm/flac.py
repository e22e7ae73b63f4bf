"""FLAC media columns: encode bytes as 8-bit mono FLAC, decode FLAC to PCM blocks with seekable offsets.

Frames are independent of one another, so the numeric work runs over all frames of an Arrow batch at once:
the bit fields of a frame are written by vector scatter, and Rice codes and predictors are decoded in lockstep,
one sample of every frame at a time.  Stream layout: STREAMINFO, a SEEKTABLE with one point for each frame, frames.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 512
RATE = 8000
PRECISION, SHIFT = 12, 10  # of the quantised predictor coefficients
CHUNK = 1 << 19  # samples that are worked on at once
MOST_POINTS = 900_000  # of a seek table, whose length has 24 bits

# Fixed values of the format: the predictors of orders 0 to 4.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))

BLOCK_TYPE = T.ArrayType(T.StructType([
    T.StructField("sample_offset", T.LongType()), T.StructField("n_samples", T.IntegerType()),
    T.StructField("byte_offset", T.LongType()), T.StructField("pcm", T.BinaryType())]))
DECODED = [T.StructField("blocks", BLOCK_TYPE), T.StructField("sample_rate", T.IntegerType()), T.StructField("error", T.StringType())]


# ---- checksums -------------------------------------------------------------------------------------------------

def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, (out << 1) ^ poly, out << 1) & ((1 << bits) - 1)
    return out.astype(np.uint16)


_T8, _T16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_STEP = 4096


@lru_cache(1)
def _by_distance() -> np.ndarray:
    """[d, b]: what byte b adds to the CRC-16 when d bytes follow it (a CRC is linear over XOR)."""
    out = np.empty((_STEP, 256), np.uint16)
    out[0] = _T16
    for d in range(1, _STEP):
        out[d] = _T16[out[d - 1] >> 8] ^ (out[d - 1] << 8)
    return out


def crc8(data: bytes) -> int:
    out = 0
    for b in data:
        out = int(_T8[out ^ b])
    return out


def crc16_of_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of each data[start:end]; long ranges are taken in steps, carried over by the remaining table rows."""
    size = end - start
    out = np.zeros(len(start), np.uint16)
    table = _by_distance()
    done = np.zeros(len(start), np.int64)
    while len(todo := np.flatnonzero(done < size)):
        n = np.minimum(size[todo] - done[todo], _STEP)
        first = np.cumsum(n) - n
        where = np.arange(n.sum()) - np.repeat(first - start[todo] - done[todo], n)
        away = np.repeat(first + n, n) - 1 - np.arange(n.sum())
        part = np.bitwise_xor.reduceat(table[away, data[where]], first)
        # the value so far acts as if XORed into the next two bytes
        high, low = out[todo] >> 8, out[todo] & 255
        carry = np.where(n >= 2, table[n - 1, high] ^ table[np.maximum(n - 2, 0), low], table[0, high] ^ (low << 8))
        out[todo] = part ^ carry.astype(np.uint16)
        done[todo] += n
    return out


# ---- encoding --------------------------------------------------------------------------------------------------

def _coded_number(n: int) -> bytes:
    """A number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 6
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        room -= 1
        if n < 1 << room:
            return bytes([(0xFF << (room + 1)) & 0xFF | n, *reversed(tail)])


@lru_cache(1 << 16)
def _frame_header(number: int, size: int) -> bytes:
    full = size == BLOCK
    head = bytes([0xFF, 0xF8, (0b1001 if full else 0b0111) << 4 | 0b0100, 0b0000_001_0]) + _coded_number(number)
    head += b"" if full else struct.pack(">H", size - 1)
    return head + bytes([crc8(head)])


def _segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of concatenated segments: the start of each, and the place of every element in its segment."""
    first = np.cumsum(lengths) - lengths
    return first, np.arange(lengths.sum()) - np.repeat(first, lengths)


def _rice(total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A parameter for codes with that sum and number, and about how many bits they take."""
    mean = total / np.maximum(count, 1)
    k = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1e-9) + 1e-12)) + 1, 0, 14).astype(np.int64)
    return k, count * (1 + k) + (total >> k)


def _zigzag(x: np.ndarray) -> np.ndarray:
    return (x << 1) ^ (x >> 31)


def _scatter(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: np.ndarray | int) -> None:
    """Write each value, most significant bit first, into `width` bits at `at`."""
    width = np.broadcast_to(np.asarray(width), value.shape)
    for b in range(int(width.max(initial=0))):
        ok = width > b
        if ok.all():
            bits[at + width - 1 - b] = value >> b & 1
        else:
            bits[(at + width - 1 - b)[ok]] = (value >> b & 1)[ok]


def _lpc(x: np.ndarray, first: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order-2 predictor of each frame from its autocorrelation, quantised; and its residual."""
    lag1 = np.where(place >= 1, np.roll(x, 1), 0)
    lag2 = np.where(place >= 2, np.roll(x, 2), 0)
    r0, r1, r2 = (np.add.reduceat((x * y).astype(np.int64), first).astype(float) for y in (x, lag1, lag2))
    r0 = r0 * (1 + 1e-9) + 1
    det = r0 * r0 - r1 * r1
    c1, c2 = r1 * (r0 - r2) / det, (r0 * r2 - r1 * r1) / det
    c = np.clip(np.rint(np.stack([c1, c2]) * (1 << SHIFT)), -(1 << PRECISION - 1), (1 << PRECISION - 1) - 1).astype(np.int32)
    return c, x - (np.repeat(c[0], n) * lag1 + np.repeat(c[1], n) * lag2 >> SHIFT)


def encode_batch(payloads: list[bytes], fixed: tuple[int, ...] = (0, 1, 2)) -> list[bytes]:
    """FLAC streams of non-empty byte strings, taken as unsigned 8-bit samples.  Each depends on its payload alone.

    A frame takes the cheapest of the fixed predictors of these orders, an order-2 linear predictor, raw or constant.
    Payloads of more than CHUNK samples are worked on in runs of frames, the others together.
    """
    short = iter(_frames([p for p in payloads if len(p) <= CHUNK], 0, fixed))
    out = []
    for p in payloads:
        runs = [next(short)] if len(p) <= CHUNK else [_frames([p[at:at + CHUNK]], at // BLOCK, fixed)[0] for at in range(0, len(p), CHUNK)]
        out.append(_stream(p, runs))
    return out


def _stream(payload: bytes, runs: list[tuple[bytes, np.ndarray, np.ndarray]]) -> bytes:
    """A stream of the runs' frames: STREAMINFO, a SEEKTABLE with a point for each frame (of very many, every k-th)."""
    size, n = np.concatenate([r[1] for r in runs]), np.concatenate([r[2] for r in runs])
    packed = (RATE << 44) | (0 << 41) | (7 << 36) | (len(payload) if len(payload) < 1 << 36 else 0)
    info = struct.pack(">HH", BLOCK, BLOCK) + int(size.min()).to_bytes(3, "big") + int(size.max()).to_bytes(3, "big") + packed.to_bytes(8, "big")
    digest = hashlib.md5()
    for at in range(0, len(payload), CHUNK):
        digest.update((np.frombuffer(payload, np.uint8, min(CHUNK, len(payload) - at), at) ^ 128).tobytes())
    some = np.arange(0, len(n), -(-len(n) // MOST_POINTS))
    points = np.zeros(len(some), np.dtype([("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")]))
    points["sample"], points["offset"], points["size"] = some * BLOCK, (np.cumsum(size) - size)[some], n[some]
    seek = points.tobytes()
    return b"".join([b"fLaC", bytes([0]), (34).to_bytes(3, "big"), info, digest.digest(), bytes([0x80 | 3]), len(seek).to_bytes(3, "big"), seek, *(r[0] for r in runs)])


def _frames(payloads: list[bytes], number_from: int, fixed: tuple[int, ...]) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
    """(frames, bytes of each, samples of each) of every payload; the first frame has the number `number_from`."""
    if not payloads:
        return []
    sizes = np.array([len(p) for p in payloads], np.int64)
    frames = (sizes + BLOCK - 1) // BLOCK
    owner = np.repeat(np.arange(len(payloads)), frames)
    _, number = _segments(frames)
    n = np.where(number == frames[owner] - 1, sizes[owner] - number * BLOCK, BLOCK)
    x = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    first, place = _segments(n)

    # the residual of every predictor, and the best of them for each frame
    choices, diff = {}, x
    for o in range(max(fixed) + 1):
        if o in fixed:
            choices[o] = diff
        diff = diff - np.roll(diff, 1)
    coefs, choices[5] = _lpc(x, first, place, n)
    best, least = np.full(len(n), 6), 8 * n  # 6: verbatim
    for c, e in choices.items():
        o = 2 if c == 5 else c
        u = _zigzag(e)
        if o:
            u[place < o] = 0
        cost = _rice(np.add.reduceat(u, first, dtype=np.int64), n - o)[1] + 8 * o + 10 + (9 + 2 * PRECISION if c == 5 else 0)
        better = (cost < least) & (n > o)
        best, least = np.where(better, c, best), np.where(better, cost, least)
    low, high = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
    best = np.where(low == high, 7, best)  # 7: constant
    order = np.array([0, 1, 2, 3, 4, 2, 0, 0])[best]
    coded = best < 6
    chosen = x.copy()
    for c, e in choices.items():
        if (best == c).any():
            np.copyto(chosen, e, where=np.repeat(best == c, n))

    # Rice parameters: four partitions in full blocks, else one
    parts = np.where(coded & (n == BLOCK), 4, 1)
    u = _zigzag(chosen)
    skip = place < np.repeat(np.where(coded, order, 0), n)
    u[skip] = 0
    first_part = np.cumsum(parts) - parts
    part = place // np.repeat(n // parts, n)
    at_part = np.repeat(first_part, n) + np.minimum(part, np.repeat(parts, n) - 1)
    in_part = np.bincount(at_part, weights=~skip, minlength=parts.sum()).astype(np.int64)
    k_part = _rice(np.bincount(at_part, weights=u, minlength=parts.sum()).astype(np.int64), in_part)[0]
    k = k_part[at_part]
    quotient = u >> k

    # how many bits everything takes, and where it stands
    heads = [_frame_header(int(a) + number_from, int(b)) for a, b in zip(number, n)]
    head_bits = np.array([len(h) for h in heads], np.int64) * 8 + 8
    lead = np.where(coded, order * 8 + np.where(best == 5, 9 + 2 * PRECISION, 0) + 6, 0)
    width = np.where(np.repeat(coded, n), np.where(skip, 0, quotient + 1 + k), np.where(np.repeat(best == 6, n), 8, np.where(place == 0, 8, 0)))
    body = np.add.reduceat(width, first) + np.where(coded, 4 * parts, 0)
    frame_bytes = (head_bits + lead + body + 7) // 8 + 2
    start = np.cumsum(frame_bytes) - frame_bytes
    bits = np.zeros(int(frame_bytes.sum()) * 8, np.uint8)
    bit0 = start * 8

    head_all = np.frombuffer(b"".join(heads), np.uint8)
    hb = head_bits // 8 - 1
    hfirst, hplace = _segments(hb)
    bits.reshape(-1, 8)[np.repeat(start, hb) + hplace] = np.unpackbits(head_all).reshape(-1, 8)
    kind = np.choose(best, [8, 9, 10, 11, 12, 33, 1, 0])
    _scatter(bits, bit0 + head_bits - 8, kind << 1, 8)
    warm = skip
    _scatter(bits, (np.repeat(bit0 + head_bits, n) + 8 * place)[warm], (x & 255)[warm], 8)
    after = bit0 + head_bits + 8 * order
    lpc = best == 5
    _scatter(bits, after[lpc], np.full(lpc.sum(), PRECISION - 1 << 5 | SHIFT), 9)
    for j in range(2):
        _scatter(bits, after[lpc] + 9 + PRECISION * j, coefs[j][lpc] & ((1 << PRECISION) - 1), PRECISION)
    _scatter(bits, (bit0 + head_bits + lead - 6)[coded], np.where(parts == 4, 2, 0)[coded], 6)
    run = np.cumsum(width) - width
    at = np.repeat(bit0 + head_bits + lead, n) + run - np.repeat(run[first], n) + np.where(np.repeat(coded, n), 4 * (at_part - np.repeat(first_part, n) + 1), 0)
    opens = np.flatnonzero(np.diff(at_part, prepend=-1) != 0)
    opens = opens[np.repeat(coded, n)[opens]]
    _scatter(bits, at[opens] - 4, k[opens], 4)
    rice = np.repeat(coded, n) & ~skip
    at_r, k_r = (at + quotient)[rice], k[rice]
    bits[at_r] = 1
    _scatter(bits, at_r + 1, (u & (1 << k) - 1)[rice], k_r)
    raw = ~np.repeat(coded, n) & (width > 0)
    _scatter(bits, at[raw], (x & 255)[raw], 8)
    data = np.packbits(bits)
    crc = crc16_of_ranges(data, start, start + frame_bytes - 2)
    data[start + frame_bytes - 2], data[start + frame_bytes - 1] = crc >> 8, crc & 255

    out, f = [], 0
    for count in frames.tolist():
        own = slice(f, f + count)
        out.append((data[int(start[f]):int(start[f + count - 1] + frame_bytes[f + count - 1])].tobytes(), frame_bytes[own], n[own]))
        f += count
    return out


# ---- decoding --------------------------------------------------------------------------------------------------

class _Stream:
    """What the metadata of one stream says."""

    def __init__(self, data: bytes):
        self.error = self.md5 = None
        self.points: list[tuple[int, int]] = []
        self.rate = self.total = self.audio = 0
        if data[:4] != b"fLaC":
            self.error = "no FLAC stream"
            return
        at, last, seen = 4, False, False
        while not last:
            if at + 4 > len(data):
                self.error = "metadata ends early"
                return
            last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1:at + 4], "big")
            body = data[at + 4:at + 4 + size]
            at += 4 + size
            if kind == 0 and size >= 34:
                seen = True
                packed = int.from_bytes(body[10:18], "big")
                self.rate, channels, depth, self.total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
                self.md5 = body[18:34]
                self.block = int.from_bytes(body[2:4], "big")
                if channels != 1 or depth != 8:
                    self.error = f"unsupported: {channels} channels of {depth} bits"
            elif kind == 3:
                points = np.frombuffer(body[:size // 18 * 18], np.dtype([("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")]))
                self.points = [(int(p["sample"]), int(p["offset"])) for p in points if int(p["sample"]) != (1 << 64) - 1]
        self.audio = at
        if not seen:
            self.error = "no STREAMINFO"


_SIZES = {1: 192, **{i: 576 << i - 2 for i in range(2, 6)}, **{i: 256 << i - 8 for i in range(8, 16)}}


def _parse_header(data: bytes, at: int, block: int) -> tuple[int, int, int]:
    """(first sample, samples, bytes of the header) of the frame at `at`; ValueError if there is none."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise ValueError("no frame where one was due")
    size_code, rate_code, channels, depth = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    if channels or depth not in (0, 1):
        raise ValueError("unsupported frame")
    lead, i = data[at + 4], at + 5
    number = lead
    if lead >= 0xC0:
        extra = 1
        while lead << extra & 0x40:
            extra += 1
        number = lead & (0x3F >> extra)
        for b in data[i:i + extra]:
            number = number << 6 | b & 0x3F
        i += extra
    elif lead >= 0x80:
        raise ValueError("bad frame number")
    if size_code in (6, 7):
        size = int.from_bytes(data[i:i + size_code - 5], "big") + 1
        i += size_code - 5
    else:
        size = _SIZES.get(size_code, 0)
    i += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if not size or i >= len(data) or crc8(data[at:i]) != data[i]:
        raise ValueError("frame header checksum")
    return (number if data[at + 1] & 1 else number * block), size, i + 1 - at


def _zeros(data: np.ndarray, bit: int) -> int:
    """How many zero bits stand before the next one bit; to the end of the data, if there is none."""
    at, seen = bit >> 3, 0
    rest = int(data[at]) & 0xFF >> (bit & 7) if at < len(data) else 0
    while not rest and at + 1 < len(data):
        at += 1
        rest = int(data[at])
    return 8 * at + 8 - rest.bit_length() - bit if rest else max(0, 8 * len(data) - bit)


def _decode_frames(data: np.ndarray, bit: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decode the subframes that start at `bit`, in lockstep.

    Returns the samples, time by frame; the bit after each frame; and which frames are damaged.
    """
    count, longest = len(bit), int(size.max())
    limit = 8 * len(data)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.zeros(len(data) + 2, np.uint64)
    for j in range(8):
        words <<= np.uint64(8)
        words |= padded[j:j + len(words)]
    def read(at, width):
        """Unsigned fields of up to 32 bits."""
        at = np.minimum(at, limit)
        shifted = words[at >> 3] << (at & 7).astype(np.uint64)
        return np.where(width > 0, shifted >> np.minimum(64 - width, 63).astype(np.uint64), np.uint64(0)).astype(np.int64)

    def signed(v, width):
        return v - ((v >> np.maximum(width - 1, 0) & 1) << width)

    eight = np.full(count, 8)
    head = read(bit, eight)
    kind = head >> 1 & 63
    bad = (head & 0x81 != 0) | ((kind > 12) & (kind < 32)) | ((kind > 1) & (kind < 8))
    constant, verbatim, fixed, lpc = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    order = np.select([fixed, lpc, verbatim, constant], [kind - 8, kind - 31, size, np.ones(count, np.int64)], 0)
    bad |= (order > size)
    at = bit + 8
    start_warm = at.copy()
    at = at + 8 * order
    most = int(np.where(fixed | lpc, order, 0).max(initial=0))
    coef = np.zeros((most, count), np.int64)
    shift = np.zeros(count, np.int64)
    for o in range(1, 5):
        for j, c in enumerate(FIXED[o][:most]):
            coef[j, fixed & (order == o)] = c
    if lpc.any():
        precision = np.where(lpc, read(at, np.full(count, 4)) + 1, 0)
        shift = np.where(lpc, signed(read(at + 4, np.full(count, 5)), np.full(count, 5)), 0)
        bad |= lpc & ((precision > 15) | (shift < 0))
        shift = np.maximum(shift, 0)
        at = at + np.where(lpc, 9, 0)
        for j in range(most):
            own = lpc & (order > j)
            coef[j] = np.where(own, signed(read(at, precision), precision), coef[j])
            at = at + np.where(own, precision, 0)
    rice = fixed | lpc
    method, splits = read(at, np.full(count, 2)), read(at + 2, np.full(count, 4))
    bad |= rice & ((method > 1) | (size % (1 << splits) != 0) | ((size >> splits) < order))
    at = at + np.where(rice, 6, 0)
    step = np.maximum(np.where(rice, size >> splits, size), 1)
    param_bits = 4 + method
    k, escape = np.zeros(count, np.int64), np.full(count, -1)

    # frames whose samples stand there as they are
    out = np.zeros((longest, count), np.int64)
    rice &= ~bad
    raw = np.flatnonzero(verbatim & ~bad & (start_warm + 8 * size <= limit))
    if len(raw):
        f, t = np.repeat(raw, size[raw]), _segments(size[raw])[1]
        out[t, f] = signed(read(start_warm[f] + 8 * t, eight[:1]), eight[:1])
    constant &= ~bad
    if constant.any():
        out[:, constant] = signed(read(start_warm, eight), eight)[constant]

    # coded frames by falling size, so that those still running are a prefix
    own = np.flatnonzero(rice)
    own = own[np.argsort(-size[own], kind="stable")]
    n, a, o, first, step, wide, shift = size[own], at[own], order[own], start_warm[own], step[own], param_bits[own], shift[own]
    coef = coef[:, own]
    x = np.zeros((longest, len(own)), np.int64)
    k, escape = np.zeros(len(own), np.int64), np.full(len(own), -1)
    running = np.searchsorted(-n, -np.arange(longest), side="left").tolist()
    opening = set(np.unique(o).tolist())
    for every in np.unique(step).tolist():
        opening.update(range(0, longest, every))
    warm, escapes = int(o.max(initial=0)), False
    twelve = np.uint64(12)
    for t in range(longest if len(own) else 0):
        m = running[t]
        if m == 0:
            break
        now, kk = a[:m], k[:m]
        if t in opening:
            w = np.flatnonzero((t >= o[:m]) & ((t == o[:m]) | (t % step[:m] == 0)))
            value = read(a[w], wide[w])
            raw = value == (1 << wide[w]) - 1
            a[w] += wide[w]
            escape[w] = np.where(raw, read(a[w], np.full(len(w), 5)), -1)
            a[w] += np.where(raw, 5, 0)
            k[w] = np.where(raw, 0, value)
            escapes = bool((escape[:m] >= 0).any())
            np.minimum(now, limit, out=now)
        window = words[now >> 3] << (now & 7).astype(np.uint64)
        zeros = 52 - np.frexp((window >> twelve).astype(np.float64))[1]
        if (far := zeros > 36).any():  # a code too long for the window
            zeros[far] = [_zeros(data, int(p)) for p in now[far]]
            stop = np.minimum(now + zeros + 1, limit)
            window = words[stop >> 3] << (stop & 7).astype(np.uint64)
        else:
            stop = now + zeros + 1
            window <<= (zeros + 1).astype(np.uint64)
        u = (zeros.astype(np.int64) << kk) | (window >> (64 - kk).astype(np.uint64)).astype(np.int64)
        e = u >> 1 ^ -(u & 1)
        after = np.minimum(stop + kk, limit)
        if escapes:
            raw, width = escape[:m] >= 0, np.maximum(escape[:m], 0)
            e = np.where(raw, signed(read(now, width), width), e)
            after = np.where(raw, now + width, after)
        if most and t:
            acc = coef[0, :m] * x[t - 1, :m]
            for j in range(1, min(most, t)):
                acc += coef[j, :m] * x[t - 1 - j, :m]
            e += acc >> shift[:m]
        if t < warm:
            w8 = np.full(m, 8)
            ready = t >= o[:m]
            e = np.where(ready, e, signed(read(first[:m] + 8 * t, w8), w8))
            after = np.where(ready, after, now)
        x[t, :m], a[:m] = e, after
    out[:, own] = x
    at[own] = a
    return out, at, bad | (at >= limit) | (np.abs(out) > 255).any(0)


def decode_batch(streams: list[bytes]) -> list[tuple[list[tuple[int, int, int, bytes]] | None, int | None, str | None]]:
    """(blocks, sample rate, error) of each stream.  Blocks are (sample offset, samples, byte offset, PCM), unsigned 8-bit.

    Frames that a seek table points at are decoded together; frames without one follow their predecessor.
    Every header's CRC-8, every frame's CRC-16, gaps between frames, the sample count and the MD5 are verified.
    """
    info = [_Stream(s) for s in streams]
    base = np.cumsum([0] + [len(s) for s in streams])
    data = np.frombuffer(b"".join(streams), np.uint8)
    found: list[list] = [[] for _ in streams]
    todo = []
    for i, s in enumerate(info):
        if s.error is None and s.audio < len(streams[i]):
            todo += [(i, s.audio + o) for o in sorted({0, *(o for _, o in s.points)})]
    seen = set(todo)
    while todo:
        heads = []
        now, todo = todo[:CHUNK // BLOCK], todo[CHUNK // BLOCK:]
        for i, at in now:
            try:
                heads.append((i, at, *_parse_header(streams[i], at, info[i].block)))
            except ValueError as e:
                info[i].error = info[i].error or str(e)
        if not heads:
            continue
        who, at, first, n, head = (np.array(x, np.int64) for x in zip(*heads))
        start = base[who] + at
        samples, end, bad = _decode_frames(data, 8 * (start + head), n)
        end = (end + 7) // 8
        bad |= end + 2 > base[who + 1]
        ok = np.flatnonzero(~bad)
        right = np.zeros(len(who), bool)
        if len(ok):
            right[ok] = crc16_of_ranges(data, start[ok], end[ok]) == data[end[ok]].astype(np.uint16) << 8 | data[end[ok] + 1]
        bytes_of = np.ascontiguousarray((samples + 128).astype(np.uint8).T)
        for f in range(len(who)):
            i = int(who[f])
            if not right[f]:
                info[i].error = info[i].error or "frame checksum"
                continue
            stop = int(end[f] + 2 - base[i])
            found[i].append((int(first[f]), int(n[f]), int(at[f]), bytes_of[f, :n[f]].tobytes(), stop))
            if stop < len(streams[i]) and (i, stop) not in seen and info[i].error is None:
                seen.add((i, stop))
                todo.append((i, stop))
    out = []
    for i, s in enumerate(info):
        blocks = sorted(found[i])
        if s.error is None:
            at, sample = s.audio, 0
            for b in blocks:
                if b[2] != at or b[0] != sample:
                    s.error = "gap between frames"
                    break
                at, sample = b[4], sample + b[1]
            else:
                if s.total and sample != s.total or at != len(streams[i]):
                    s.error = "stream ends early"
                elif s.md5 and any(s.md5):
                    digest = hashlib.md5()
                    for b in blocks:
                        digest.update((np.frombuffer(b[3], np.uint8) ^ 128).tobytes())
                    s.error = None if digest.digest() == s.md5 else "audio MD5"
        out.append((None if s.error else [b[:4] for b in blocks], s.rate or None, s.error))
    return out


# ---- DataFrame operators ---------------------------------------------------------------------------------------

def _chunks(values: list, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of a batch that hold about `most` bytes each; a longer value has a range of its own."""
    first = total = 0
    for i, v in enumerate(values):
        size = len(v) if v is not None else 0
        if i > first and total + size > most:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(values):
        yield first, len(values)


def encode_flac(df: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """Add `media`: `payload` (binary) as an 8-bit mono FLAC stream.

    Null or empty payloads give null (the format has no empty stream).  Other columns pass through; a column that
    already has the name `media` is replaced.
    """
    kept = [f for f in df.schema.fields if f.name != media]
    schema = T.StructType([*kept, T.StructField(media, T.BinaryType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(payload).to_pylist()
            for a, b in _chunks(values):
                own = values[a:b]
                coded = iter(encode_batch(full) if (full := [v for v in own if v]) else [])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array([next(coded) if v else None for v in own], pa.binary())], names=[*names, media])

    return df.mapInArrow(run, schema)


_ARROW_BLOCKS = pa.list_(pa.struct([("sample_offset", pa.int64()), ("n_samples", pa.int32()), ("byte_offset", pa.int64()), ("pcm", pa.binary())]))


def decode_flac(df: DataFrame, media: str = "media") -> DataFrame:
    """Add `blocks` (array of sample_offset, n_samples, byte_offset, pcm), `sample_rate` and `error`.

    Damaged or unsupported streams give null blocks and say why in `error`; a null stream gives nulls.  `byte_offset`
    is the frame's place in the stream, so any sample can be reached by one ranged read.
    """
    new = [f.name for f in DECODED]
    kept = [f for f in df.schema.fields if f.name not in new]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(media).to_pylist()
            for a, b in _chunks(values):
                own = values[a:b]
                got = iter(decode_batch([v for v in own if v is not None]))
                rows = [(None, None, None) if v is None else next(got) for v in own]
                blocks = [None if r[0] is None else [dict(zip(("sample_offset", "n_samples", "byte_offset", "pcm"), x)) for x in r[0]] for r in rows]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(blocks, _ARROW_BLOCKS), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=[*names, *new])

    return df.mapInArrow(run, T.StructType([*kept, *DECODED]))


def pcm_blocks(decoded: DataFrame, *keys: str) -> DataFrame:
    """One row for each PCM block of decode_flac's result, ready to be written: keys, block, offsets, pcm."""
    return decoded.select(*keys, F.posexplode("blocks").alias("block", "b")).select(*keys, "block", "b.*")

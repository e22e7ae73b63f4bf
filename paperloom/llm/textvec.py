"""Vectorised words and hashes of many texts at once, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are worked on at once.
CHUNK = 1 << 21
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    first = total = 0
    for i, t in enumerate(texts):
        if i > first and total + len(t) > most:
            yield first, i
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


def _table(keep_digits: bool) -> np.ndarray:
    out = np.full(256, 32, np.uint8)
    out[128:] = np.arange(128, 256)
    out[97:123] = out[65:91] = np.arange(97, 123)
    if keep_digits:
        out[48:58] = np.arange(48, 58)
    return out


LETTERS, LETTERS_AND_DIGITS = _table(False), _table(True)


class Words:
    """The words of a batch of UTF-8 texts: runs of letters (and digits), lower-cased in ASCII and Latin-1.

    `data` holds all normalised bytes, each text followed by a space and the whole preceded by one; `start` and `end`
    are the words' places in it, `owner` their texts.
    """

    def __init__(self, texts: list[bytes], table: np.ndarray):
        raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        data = table[raw]
        latin = (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)
        data[1:][latin] += 0x20
        self.data = data
        self.bounds = np.cumsum([1] + [len(t) + 1 for t in texts])  # where texts start
        inside = (data != 32).astype(np.int8)
        step = np.diff(inside)
        self.start, self.end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
        self.owner = np.searchsorted(self.bounds, self.start, side="right") - 1

    def hashes(self, *prefixes: int) -> list[np.ndarray]:
        """64-bit hashes of all words, and of the first so many bytes of those that are longer (else 0)."""
        n = len(self.data)
        powers = np.empty(n + 1, np.uint64)
        powers[0] = 1
        powers[1:] = _P
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.data.astype(np.uint64) * powers[:-1], out=sums[1:])
        inverse = np.empty(n + 1, np.uint64)
        inverse[0] = 1
        inverse[1:] = _P_INVERSE
        np.multiply.accumulate(inverse, out=inverse)
        back = inverse[self.start]

        def mixed(h: np.ndarray, salt: int) -> np.ndarray:
            h = h ^ np.uint64(salt * 0x9FB21C651E98DF25 & (1 << 64) - 1)
            h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            return h ^ h >> np.uint64(32)

        out = [mixed((sums[self.end] - sums[self.start]) * back, 0)]
        for k in prefixes:
            longer = self.end - self.start > k
            part = mixed((sums[np.minimum(self.start + k, n)] - sums[self.start]) * back, k)
            out.append(np.where(longer, part, np.uint64(0)))
        return out

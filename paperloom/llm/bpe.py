"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that its encoding can end with.  PrefixEncoder stores
that token for each prefix, so the encoding of any prefix is read by walking back, bytes can be appended without
looking at what came before, and an edit is re-encoded only until the stored tokens agree again with the old ones.
Two neighbouring tokens are possible only if the merges of their joint bytes end in just these two.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textvec import chunks

#: Bytes of pieces, in either of two generations, and number of token pairs (about 80 bytes each) that a worker
#: remembers; results do not depend on them.
PIECE_BYTES, PAIRS = 48_000_000, 250_000
#: Pieces of a long text that are worked on at once.
BLOCK = 250_000
#: What the empty prefix ends with.
START = -1


class Vocabulary:
    """Ranks of byte-level tokens, read from lines of base64 and rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: Finds all tokens that end at each byte; bytes are written as the characters of the same numbers.
        self.matches = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.matches.add_word(t.decode("latin-1"), (r, len(t)))
        self.matches.make_automaton()
        #: Bytes of each token.
        self.length_of = {r: len(t) for t, r in ranks.items()}
        top = range(max(self.bytes_of, default=-1) + 1)
        #: By token: its bytes, and its number with a comma.
        self.token_bytes = pa.array([self.bytes_of.get(i, b"") for i in top], pa.binary())
        self.token_names = pa.array([b"%d," % i for i in top], pa.binary())
        #: Pairs of neighbours that are known to be possible, and not.
        self.good: set[int] = set()
        self.bad: set[int] = set()
        self._halves: dict[int, tuple[int, int]] = {}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)})

    def merge(self, data: bytes) -> list[int]:
        """The encoding by definition: merge the neighbours of the lowest rank, leftmost first.  For short strings."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge gives this one, which has two bytes or more."""
        known = self._halves.get(token)
        if known is None:
            data = self.bytes_of[token]
            del self.ranks[data]
            try:
                left, right = self.merge(data)
            finally:
                self.ranks[data] = token
            known = self._halves[token] = left, right
        return known

    def follows(self, left: int, right: int) -> bool:
        """Whether `right` can come after `left` in an encoding.

        Going back in the order of merges, the tokens beside the border are x and y until one of them is merged away
        from it at rank `until`; a lower rank of x + y would have closed the border.  Of equal ranks the leftmost
        goes first: the left token's own merge before x + y, x + y before the right token's own.
        """
        pair = left << 32 | right
        if pair in self.good or pair in self.bad:
            return pair in self.good
        if len(self.good) + len(self.bad) > PAIRS:
            self.good.clear()
            self.bad.clear()
        x, y, until, open_ = left, right, 1 << 60, True
        bytes_of, rank = self.bytes_of, self.ranks.get
        while True:
            if rank(bytes_of[x] + bytes_of[y], 1 << 60) < until:
                open_ = False
                break
            made_x = x if len(bytes_of[x]) > 1 else -1
            made_y = y if len(bytes_of[y]) > 1 else -1
            if made_x > made_y:
                until, x = x, self.halves(x)[1]
            elif made_y >= 0:
                until, y = y + 1, self.halves(y)[0]
            else:
                break
        (self.good if open_ else self.bad).add(pair)
        return open_


def fill(v: Vocabulary, text: str, last: list[int | None]) -> None:
    """Set the gaps (None) of `last[1:]` to the unique valid last token of the prefix that ends with each byte.

    `text` has bytes as characters; `last[i + 1]` belongs to the byte at i.  A character that is no byte ends one string,
    and another starts after it: its place in `last` holds START, as does `last[0]`.  A token that ends at a byte is the
    one looked for if it can follow what ends where it begins.
    """
    good, bad, follows = v.good, v.bad, v.follows
    for end, (token, size) in v.matches.iter(" " + text, 1):
        if last[end] is None:
            left = last[end - size]
            if left < 0:
                last[end] = token
                continue
            pair = left << 32 | token
            if pair in good or pair not in bad and follows(left, token):
                last[end] = token


def walk_back(v: Vocabulary, last: list[int | None], start: int, end: int) -> list[int]:
    out = []
    while end > start:
        out.append(last[end])
        end -= len(v.bytes_of[out[-1]])
    return out[::-1]


class PrefixEncoder:
    """The encoding of a byte string that can grow and be edited; `last[i]` ends the encoding of its first i bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), [START]
        self.append(data)

    def _fill(self, done: int, end: int) -> None:
        """Complete `last` for the prefixes of done + 1 to `end` bytes."""
        first = max(0, done - self.vocabulary.longest)
        part = self.last[first:done + 1] + [None] * (end - done)
        fill(self.vocabulary, self.data[first:end].decode("latin-1"), part)
        if None in part:
            raise ValueError("the vocabulary lacks a single byte")
        self.last[done + 1:end + 1] = part[done + 1 - first:]

    def append(self, more: bytes) -> None:
        at = len(self.data)
        self.data += more
        self._fill(at, len(self.data))

    def edit(self, start: int, removed: int, inserted: bytes) -> int:
        """Replace `removed` bytes at `start`; returns how many prefixes were computed anew."""
        if not 0 <= start <= start + removed <= len(self.data):
            raise ValueError("edit outside the string")
        old_tail = self.last[start + removed + 1:]
        self.data[start:start + removed] = inserted
        del self.last[start + 1:]
        same = 0
        at, first = start, start + len(inserted)
        while at < len(self.data):
            to = min(at + 2 * self.vocabulary.longest, len(self.data))
            self._fill(at, to)
            for end in range(max(at, first) + 1, to + 1):
                # once the longest token fits into the part that agrees, everything after it agrees too
                same = same + 1 if self.last[end] == old_tail[end - first - 1] else 0
            at = to
            if same > self.vocabulary.longest:
                self.last += old_tail[at - first:]
                break
        return at - start

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first `end` bytes (all)."""
        return walk_back(self.vocabulary, self.last, 0, len(self.data) if end is None else end)


@lru_cache(1)
def _pieces(path: str) -> Pieces:
    """Of this worker; it outlives a task."""
    return Pieces(Vocabulary.read(path))


def encode_all(v: Vocabulary, pieces: list[bytes]) -> list[list[int]]:
    """Each piece by itself: a whole token stands for itself, the prefixes of all others are filled in one pass."""
    whole = [v.ranks.get(p) for p in pieces]
    parts = [p for p, token in zip(pieces, whole) if token is None]
    text = "\u0100".join([p.decode("latin-1") for p in parts])
    last: list[int | None] = [None] * (len(text) + 1)
    at, ends = 0, []
    for size in map(len, parts):
        last[at] = START
        at += size + 1
        ends.append(at - 1)
    fill(v, text, last)
    length, found = v.length_of, []
    for start, end in zip([0, *[e + 1 for e in ends]], ends):
        back = []
        while end > start:
            token = last[end]
            back.append(token)
            end -= length[token]
        back.reverse()
        found.append(back)
    filled = iter(found)
    return [next(filled) if token is None else [token] for token in whole]


class Pieces:
    """Token ids of pieces.  Those of the last many are remembered; what was not used for a while is forgotten."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def ids(self, pieces: list[str]) -> pa.ListArray:
        """The ids of each piece, in order."""
        encoded = pa.array(pieces, pa.string()).dictionary_encode()
        distinct = encoded.dictionary.to_pylist()
        found = list(map(self.young.get, distinct))
        unknown = [i for i, f in enumerate(found) if f is None]
        missing = []
        for i in unknown:
            found[i] = self.old.get(distinct[i])
            if found[i] is None:
                missing.append(i)
        for a, b in chunks([distinct[i] for i in missing], 1 << 19):
            for i, ids in zip(missing[a:b], encode_all(self.vocabulary, [distinct[i].encode() for i in missing[a:b]])):
                found[i] = array("i", ids).tobytes()
        for i in unknown:
            if len(found[i]) < 256:
                self.young[distinct[i]] = found[i]
                self.size += 200 + len(distinct[i]) + len(found[i])
        if self.size > PIECE_BYTES:
            self.young, self.old, self.size = {}, self.young, 0
        offsets = np.concatenate([[0], np.cumsum(list(map(len, found)), dtype=np.int64) // 4]).astype(np.int32)
        each = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
        return each.take(encoded.indices)


def _blocks(texts: list[str], pattern: regex.Pattern) -> Iterator[tuple[list[str], list[tuple[int, int, int]]]]:
    """Pieces of many texts, with (text, first, end) of each; a long text comes in several blocks."""
    for a, b in chunks(texts):
        if len(texts[a]) > BLOCK * 8:
            found = pattern.finditer(texts[a])
            while block := [m.group() for m in islice(found, BLOCK)]:
                yield block, [(a, 0, len(block))]
        else:
            pieces, cuts = [], []
            for i in range(a, b):
                at = len(pieces)
                pieces += pattern.findall(texts[i])
                cuts.append((i, at, len(pieces)))
            yield pieces, cuts


def _joined(words: pa.BinaryArray, which: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The chosen words one after another, and where each begins and the last ends."""
    taken = words.take(which)
    ends = np.frombuffer(taken.buffers()[1], np.int32)[:len(taken) + 1] if len(taken) else np.zeros(1, np.int32)
    return memoryview(taken.buffers()[2] or b""), ends


def encode_bpe(df: DataFrame, text: str, vocabulary_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Add `ids` (array<int>, if wanted), `n_tokens`, `ids_sha256` and `decoded_sha256`, the digest of the decoded ids.

    Every match of `pattern` (without groups) is encoded separately, without special tokens.  A null text counts as
    empty: no ids.  Other columns pass through, but those named like a new one are replaced.  The vocabulary file must
    exist under `vocabulary_path` on every node, as part of an installed package does.  A worker holds the pieces of
    about 2 MB of text at once, however long a text is, and the ids of one text if they are wanted.
    """
    new = [*([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    kept = [f for f in df.schema.fields if f.name not in {x.name for x in new}]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _pieces(vocabulary_path)
        v, split = table.vocabulary, regex.compile(pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            counts, parts = [0] * len(texts), [[] for _ in texts]
            names_of, bytes_of = ([hashlib.sha256() for _ in texts] for _ in range(2))
            for pieces, cuts in _blocks(texts, split):
                lists = table.ids(pieces)
                ends, ids = lists.offsets.to_numpy(), lists.flatten()
                (numbers, number_at), (decoded, byte_at) = _joined(v.token_names, ids), _joined(v.token_bytes, ids)
                for i, a, b in cuts:
                    a, b = ends[a] - ends[0], ends[b] - ends[0]
                    if b > a:
                        if counts[i]:
                            names_of[i].update(b",")
                        names_of[i].update(numbers[number_at[a]:number_at[b] - 1])
                        bytes_of[i].update(decoded[byte_at[a]:byte_at[b]])
                        counts[i] += int(b - a)
                        if with_ids:
                            parts[i].append(ids[a:b].to_numpy())
            columns = [pa.array([np.concatenate(p) if p else np.zeros(0, np.int32) for p in parts], pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), *columns, pa.array(counts, pa.int64()), pa.array([h.hexdigest() for h in names_of], pa.string()), pa.array([h.hexdigest() for h in bytes_of], pa.string())],
                names=[*names, *(f.name for f in new)])

    return df.select(*names, F.col(text).alias("__text")).mapInArrow(run, T.StructType([*kept, *new]))

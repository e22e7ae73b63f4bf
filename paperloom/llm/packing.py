"""Best-fit packing of documents' tokens into sequences of a fixed length, with a bounded number of open sequences.

Every task encodes its documents and packs them as they come: a piece goes to the open sequence whose free space fits it
best, found in a bitset keyed by free space; if none has room and as many are open as may be, the fullest one closes.
What a task leaves open is packed again, many tasks' rest in one, until one task has packed the last rest; each step keeps
at most a sixteenth of the sequences open, so the last task's input has a fixed bound and the whole work is linear.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import compress, count, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

#: Sequences that a task holds open, and how many a task of the later steps is given for each that it may hold open.
OPEN, SHRINK = 512, 16
#: Words that a worker remembers, if not longer than LONGEST; results do not depend on them.
WORDS, LONGEST = 800_000, 64
#: How tokens that end a word are written, and ASCII characters that are neither letters, numbers nor white space.
WORD_END, MARKS = "</w>", "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
MARK = frozenset(MARKS)

#: Matches texts whose characters are letters and marks that normalising leaves as they are and whose lower case is one
#: character, which doesn't depend on its neighbours.
PRECOMPOSED = re.compile("[\x00-\u012f\u0131-\u024f]*").fullmatch


class Packer:
    """Sequences of `room` tokens, at most `most` open at a time; pieces are any objects with a length given beside."""

    def __init__(self, room: int, most: int):
        self.room, self.most, self.open = room, most, 0
        #: Bit f is set while an open sequence has f tokens free; `by_free` has these sequences' pieces.
        self.bits = 0
        self.by_free: dict[int, list[list]] = defaultdict(list)

    def _take(self, free: int) -> list:
        same = self.by_free[free]
        out = same.pop()
        if not same:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.open -= 1
        return out

    def add(self, piece: object, length: int) -> Iterator[list]:
        """Place a piece of 1 to `room` tokens; yields the sequences that this closes, as lists of (offset, piece)."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            held = self._take(free)
        else:
            if self.open == self.most and length < self.room:
                yield self._take((self.bits & -self.bits).bit_length() - 1)
            free, held = self.room, []
        held.append((self.room - free, piece))
        free -= length
        if not free:
            yield held
            return
        self.by_free[free].append(held)
        self.bits |= 1 << free
        self.open += 1

    def rest(self) -> Iterator[list]:
        """The sequences still open, the fullest first."""
        while self.bits:
            yield self._take((self.bits & -self.bits).bit_length() - 1)


class WordEncoder:
    """Token ids, as little-endian unsigned 32-bit numbers, by a vocabulary file of the tokenizers library.

    The vocabulary must encode the words between spaces and line feeds apart, and a word's closing ASCII marks apart from
    the Latin letter or number before them, without regard to the case of Latin letters, as those with word ends do.  So each
    word is encoded once while it is remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words: dict[str, bytes] = {"": b""}
        names = self.tokenizer.get_vocab()
        #: Whether a token ends a word.
        self.ends = np.zeros(max(names.values(), default=-1) + 1, bool)
        self.ends[[i for x, i in names.items() if x.endswith(WORD_END)]] = True

    def _new(self, words: list[str]) -> None:
        """Remember the ids of `words`: those of letters alone are encoded many at once and told apart by their ends."""
        plain, odd = [], []
        for x in words:
            (plain if x.isalpha() and (x.isascii() or PRECOMPOSED(x)) else odd).append(x)
        for at in range(0, len(plain), 256):
            some = plain[at : at + 256]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) == len(some):
                data = ids.tobytes()
                self.words.update(zip(some, [data[i:j] for i, j in zip([0, *ends], ends)]))
            else:
                odd += some
        for at in range(0, len(odd), 4096):
            some = odd[at : at + 4096]
            self.words.update((x, np.array(e.ids, "<u4").tobytes()) for x, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)))

    def _learn(self, missing: set[str]) -> None:
        """Remember the ids of `missing` words; those with closing marks by way of the word before the marks."""
        known = self.words
        marked = [x for x in missing if x[-1] in MARK]
        missing.difference_update(marked)
        parts = []
        for word in marked:
            core = word.rstrip(MARKS)
            # the last character must still be one letter or number when it is normalised and lower-cased
            if core and core[-1].isalnum() and PRECOMPOSED(core[-1]):
                tail = word[len(core):]
                parts.append((word, core, tail))
                missing.add(core)
                missing.add(tail)
            else:
                missing.add(word)
        self._new([x for x in missing if x not in known])
        known.update([(word, known[core] + known[tail]) for word, core, tail in parts])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        listed = [(x.lower() if PRECOMPOSED(x) else x).replace("\n", " ").split(" ") for x in texts]
        found = [list(map(self.words.get, words)) for words in listed]
        gaps = [list(compress(count(), map(is_, ids, repeat(None)))) for ids in found]
        missing = {words[i] for words, own in zip(listed, gaps) for i in own}
        long = [x for x in missing if len(x) > LONGEST]
        self._learn(missing)
        known = self.words
        for words, ids, own in zip(listed, found, gaps):
            for i in own:
                ids[i] = known[words[i]]
            yield b"".join(ids)
        for x in long:
            known.pop(x, None)
        if len(known) > WORDS:  # only the last batch's words stay, or none
            last = set().union(*listed)
            self.words = {x: known[x] for x in last if x in known} if len(last) <= WORDS // 2 else {}
            self.words[""] = b""


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _pieces(ids: bytes, end: int, room: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(piece, start, length, ids) of a document's ids and the end token."""
    whole = ids + end.to_bytes(4, "little")
    for number, at in enumerate(range(0, len(whole), 4 * room)):
        part = whole[at : at + 4 * room]
        yield number, at // 4, len(part) // 4, part


FIELDS = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
PLACE = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("open", T.BooleanType())])


def _packed(pieces: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], at_length: int, room: int, most: int, level: int, last: bool) -> Callable:
    """A function for mapInArrow that packs the rows which `pieces` makes and adds sequence_id, offset and open."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = (level << 52) | (TaskContext.get().partitionId() << 32), count()
        packer, out, schema = Packer(room, most), [], []

        def put(held: list, still: bool) -> None:
            sequence = first + next(number)
            out.extend((*row, sequence, offset, still) for offset, row in held)

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema[0])], schema=schema[0])
            out.clear()
            return made

        for row in pieces(batches, schema):
            for held in packer.add(row, row[at_length]):
                put(held, False)
            if len(out) >= 8192:
                yield batch()
        for held in packer.rest():
            put(held, not last)
            if len(out) >= 8192:
                yield batch()
        if out:
            yield batch()

    return run


def pack_texts(df: DataFrame, id_col: str, text: str, vocabulary: str, end: int = 1, room: int = 4096, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and `end`; only documents of over `room` tokens are cut, into pieces of `room` tokens and a
    shorter last one.  Pieces of a sequence lie without gaps from offset 0.  Null and empty texts are the end token alone;
    null and repeated ids are rows like others; an empty table gives none.  Other columns are not read.  Sequence numbers
    are distinct, not gapless.  `with_ids` adds the pieces' ids as little-endian unsigned 32-bit numbers.  A task holds
    OPEN sequences and an Arrow batch of texts; a long text is held whole.
    """
    kept = T.StructField("id", df.schema[id_col].dataType)
    extra = [T.StructField("ids", T.BinaryType())] if with_ids else []
    row = T.StructType([kept, *FIELDS, *extra])
    out = T.StructType([*row, *PLACE])
    places = [(f.name, T_ARROW[type(f.dataType)]) for f in [*FIELDS, *extra, *PLACE]]

    def cut(batches: Iterator[pa.RecordBatch], schema: list) -> Iterator[tuple]:
        encoder = _encoder(vocabulary)
        for b in batches:
            if not schema:
                schema.append(pa.schema([pa.field("id", b.schema.field(0).type), *(pa.field(n, t) for n, t in places)]))
            ids, texts = b.column(0).to_pylist(), [x or "" for x in b.column(1).to_pylist()]
            for own, found in zip(ids, encoder.encode(texts)):
                for number, start, length, part in _pieces(found, end, room):
                    yield (own, number, start, length, zlib.crc32(part), part) if with_ids else (own, number, start, length, zlib.crc32(part))

    def again(batches: Iterator[pa.RecordBatch], schema: list) -> Iterator[tuple]:
        for b in batches:
            if not schema:
                schema.append(pa.schema([pa.field("id", b.schema.field(0).type), *(pa.field(n, t) for n, t in places)]))
            yield from zip(*(c.to_pylist() for c in b.columns))

    now = materialise(df.select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInArrow(_packed(cut, 3, room, OPEN, 0, False), out))
    done = [now.filter("not open")]
    for level in count(1):
        rest = now.filter("open")
        cells = -(-rest.select("sequence_id").distinct().count() // (SHRINK * OPEN))
        if not cells:
            break
        now = materialise(rest.select(*row.names).repartition(cells).mapInArrow(_packed(again, 3, room, OPEN, level, cells == 1), out))
        done.append(now.filter("not open"))
    whole = done[0]
    for x in done[1:]:
        whole = whole.unionByName(x)
    return whole.select(F.col("id").alias(id_col), *FIELDS.names, *[f.name for f in extra], "sequence_id", "offset")


#: Arrow types of the columns that packing makes.
T_ARROW = {T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.BinaryType: pa.binary(), T.BooleanType: pa.bool_()}


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of what `pack_texts` gives with its ids: the tokens of each sequence in order."""
    part = F.struct("offset", "ids")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: F.hex(p["ids"])), "")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.unhex(joined).alias("ids"))

"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within the radius meet in a variant that lies within half the radius of each.  The radius here is 3,
so the halves are 1 and 2; and as fingerprints at an odd distance differ in parity, only those of even parity emit the
larger ball.  Everything in the small ball of a variant links with everything in its large ball, so each variant gives
a star, never all pairs.  Ball hashing of radius 1 on both sides over parts of the bits first sets aside the
fingerprints that can have no partner at all.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, release, shuffle_partitions, utf8
from .graph import connected_components

SEED = 42
RADIUS = 3
_SPACE = re.compile(rb"[ \t-\r]")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_blocks(text: bytes, words: int, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Shingles of the lower-cased words, repeats included, some at a time; words are those of bytes.split.

    A text of fewer words is one shingle, one without words has none.  About `most` bytes are split at once.
    """
    own: list[bytes] = []
    at, found = 0, False
    while at < len(text):
        space = _SPACE.search(text, at + most)
        end = space.start() if space else len(text)
        own += text[at:end].lower().split()  # of bytes: A-Z only, and ASCII white space
        at = end
        if len(own) >= words:
            found = True
            line = b" ".join(own)
            size = np.fromiter(map(len, own), np.int64, len(own)) + 1
            ends = np.cumsum(size)
            yield [line[a:b] for a, b in zip((ends - size)[:len(own) - words + 1].tolist(), (ends[words - 1:] - 1).tolist())]
            own = own[len(own) - words + 1:]
    if own and not found:
        yield [b" ".join(own)]


def shingles_of(text: bytes, words: int) -> list[bytes]:
    return [s for block in shingle_blocks(text, words) for s in block]


def _hashes(shingles: Iterable[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], np.uint64)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[a:a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return total


def _majority(bits: np.ndarray, n: int) -> int:
    """The word of the bits that more than half of `n` hashes have; zero for none."""
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.int64)[0])


def fingerprint_of(text: bytes, words: int) -> int:
    """SimHash, as a signed number: a bit is set if it is in over half the shingles' hashes, repeats included."""
    bits, n = np.zeros(64, np.int64), 0
    for block in shingle_blocks(text, words):
        bits += _bit_counts(_hashes(block))
        n += len(block)
    return _majority(bits, n)


def simhash(df: DataFrame, text: str, words: int, name: str = "fingerprint") -> DataFrame:
    """Add `name`: the 64-bit SimHash (a signed long) of `text` over shingles of `words` words.

    Null and wordless texts get zero.  Words are runs of anything but ASCII white space; A-Z is lower-cased.
    Other columns pass through; one of the same name is replaced.
    """
    kept = [f for f in df.schema.fields if f.name != name]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprint_of(t, words) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.int64())], names=[*names, name])

    return df.select(*names, utf8(text).alias("__utf8")).mapInArrow(run, schema)


# ---- links within Hamming distance 3 ---------------------------------------------------------------------------

def _ball(radius: int) -> list[int]:
    """Masks of all changes of exactly that many of 64 bits."""
    return [_signed(sum(1 << b for b in c)) for c in combinations(range(64), radius)]


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def with_neighbours(fingerprints: DataFrame, parts: int = 3) -> DataFrame:
    """The fingerprints (column `f`, distinct) that may have another within distance 3; an exact filter, no false misses.

    If two differ in 1 to 3 bits, leaving out a part of the bits that holds one of these leaves 2 at most; so their
    balls of radius 1 over the other bits meet.  Fingerprints alone in all their buckets have no neighbour.
    """
    fingerprints = fingerprints.repartition(shuffle_partitions(fingerprints.sparkSession), "f")
    rows = []
    for p in range(parts):
        own = [b for b in range(64) if b * parts // 64 != p]
        keep = sum(1 << b for b in own)
        rows += [F.struct(F.lit(p).cast("byte").alias("part"), F.lit(_signed(keep)).alias("keep"), F.lit(_signed(m)).alias("flip")) for m in [0, *(1 << b for b in own)]]
    variants = fingerprints.select("f", F.explode(F.array(*rows)).alias("v")).select(
        "f", F.col("v.part").alias("part"), F.col("f").bitwiseAND(F.col("v.keep")).bitwiseXOR(F.col("v.flip")).alias("key"))
    bucket = Window.partitionBy("key", "part")
    return variants.select("f", F.min("f").over(bucket).alias("low"), F.max("f").over(bucket).alias("high")).filter("low <> high").select("f").distinct()


def links(fingerprints: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints (column `f`, distinct) that connect just those within distance 3 of each other.

    Every fingerprint emits the variants at distance 0 and 1, those of even parity also the ones at distance 2.  If two
    are within 3 bits, one variant has the one in its small and the other in either ball.  Each variant links its
    members to the smallest in its small ball; these pairs are verified, and no two others need be looked at.
    """
    near = F.array(*[F.lit(m) for m in [0, *_ball(1)]])
    far = F.array(*[F.lit(m) for m in _ball(2)])
    even = F.bit_count("f") % 2 == 0
    small = fingerprints.select("f", F.lit(True).alias("small"), F.explode(near).alias("m"))
    large = fingerprints.filter(even).select("f", F.lit(False).alias("small"), F.explode(far).alias("m"))
    variants = small.unionByName(large).select("f", "small", F.col("f").bitwiseXOR(F.col("m")).alias("v"))
    centre = F.min(F.when(F.col("small"), F.col("f"))).over(Window.partitionBy("v"))
    met = variants.select("f", centre.alias("c")).filter("c is not null and c <> f").distinct()
    return met.filter(_distance(F.col("f"), F.col("c")) <= RADIUS).select(F.col("f").alias("a"), F.col("c").alias("b"))


def near_links(fingerprints: DataFrame) -> DataFrame:
    """`links` among those fingerprints (column `f`, distinct) that the exact filter leaves."""
    return links(materialise(with_neighbours(fingerprints)))


def near_duplicates(df: DataFrame, id_col: str, text: str, words: int = 3) -> DataFrame:
    """(id, fingerprint hex, component_id) of every row: classes of texts linked at 3 or fewer differing bits.

    component_id is the smallest non-null id reachable, the row's own included.  Null and wordless texts have
    fingerprint zero, linked like any other; repeated ids give repeated rows; a null id can only get a component
    through others.  The column named `id_col` keeps its name.
    """
    marked = materialise(simhash(df.select(F.col(id_col).alias("id"), F.col(text).alias("t")), "t", words).select("id", F.col("fingerprint").alias("f")))
    lowest = materialise(marked.groupBy("f").agg(F.min("id").alias("low")))
    tree = connected_components(near_links(lowest.select("f")))
    joined = lowest.join(tree.select(F.col("node").alias("f"), "component"), "f", "left")
    classes = joined.select("f", "low", F.coalesce("component", "f").alias("k"))
    # most classes have one fingerprint; only the others are gathered
    several = classes.join(tree.select(F.col("component").alias("k")).distinct(), "k", "left_semi").groupBy("k").agg(F.min("low").alias("m"))
    named = classes.join(several, "k", "left").select("f", F.coalesce("m", "low").alias("component_id"))
    return marked.join(named, "f").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


# ---- links by similarity ---------------------------------------------------------------------------------------

#: Rows whose shingles are counted to order shingles from rare to common: about so many, but one of EVERY at least, so that
#: what a few thousand rows share is seen in any corpus; and most common ones kept.  The order decides only how many rows
#: meet: the search is exact for any.
COUNTED, EVERY, COMMON = 10_000, 500, 500_000
#: Rows of a key from which on it may be told apart by a second shared shingle, and rows of a key that meet in one block.
HOT, BLOCK = 256, 512
#: Rows of each key that its other rows meet in the first round, and in each later one.
PIVOTS = 8, 32


def _shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    blocks = [np.unique(_hashes(set(block)).view(np.int64)) for block in shingle_blocks(text, words)]
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.int64)


def common_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of shingles that several of a fixed share of the rows (columns id, t) have."""
    every = max(1, min(rows.count() // COUNTED, EVERY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = [_shingle_hashes(t, words) for t in batch.column("t").slice(at, 500).to_pylist()]
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], names=["key", "n"])

    some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select(utf8("t").alias("t"))
    counted = some.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    table = counted.orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    key, n = (table.column(c).to_numpy() for c in ("key", "n"))
    order = np.argsort(key)
    return key[order], n[order]


def with_prefix(rows: DataFrame, words: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Add what the distinct shingles of `t` give: `size`, their number, `f`, their SimHash, and `prefix`, the hashes of
    the first of them, from rare to common.

    Sets of that similarity have at least `similarity` of either in common, so one of the first `size` less that, plus one,
    and two of the first one more (if that is two or more): the prefix has that one more.  A wordless text has the prefix 0.
    """
    shared = rows.sparkSession.sparkContext.broadcast(common)
    schema = T.StructType([*rows.schema.fields, T.StructField("size", T.IntegerType()), T.StructField("f", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for batch in batches:
            sizes, prints, prefixes = [], [], []
            for text in batch.column("__utf8").to_pylist():
                h = _shingle_hashes(text, words)
                count = np.zeros(len(h), np.int64)
                if len(known):
                    place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    count = np.where(known[place] == h, counts[place], 0)
                own = h[np.lexsort((h, count))]
                sizes.append(len(h))
                prints.append(_majority(_bit_counts(h), len(h)))
                prefixes.append(own[:len(h) - math.ceil(similarity * len(h) - 1e-9) + 2] if len(h) else np.zeros(1, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], names=schema.names)

    return rows.select("*", utf8("t").alias("__utf8")).mapInArrow(run, schema)


def _can_be_similar(similarity: float) -> Column:
    """Whether rows x and y that meet in a key can have the similarity, if it is the first that they share."""
    left = F.least(F.col("x.size") - F.col("x.pos"), F.col("y.size") - F.col("y.pos"))
    return left + 1e-9 >= (F.col("x.size") + F.col("y.size")) * (similarity / (1 + similarity))


def _plain(similarity: float) -> Column:
    """Whether an entry is of the prefix of which similar rows share one, not the one more of which they share two."""
    return F.col("pos") <= F.col("size") - F.ceil(similarity * F.col("size") - 1e-9)


def _perhaps(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose id is among `wanted` (id), and some others: ids set bits of a table of at most 65,536 words, which is
    broadcast.  It keeps most other rows, with their texts, out of a shuffle."""
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << 22))
    words = wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits"))
    found = rows.withColumn("slot", slot).withColumn("word", F.shiftright("slot", 6)).join(F.broadcast(words), "word")
    return found.filter("shiftrightunsigned(bits, CAST(slot & 63 AS INT)) & 1 = 1").select(*rows.columns)


def _pairs(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _with_component(live: DataFrame, edges: DataFrame) -> DataFrame:
    tree = connected_components(edges).withColumnRenamed("node", "id")
    return live.join(tree.hint("merge"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")


def met_keys(entries: DataFrame) -> DataFrame:
    """The entries (key, ...) whose key others have too."""
    return entries.withColumn("m", F.count("*").over(Window.partitionBy("key"))).filter("m > 1").drop("m")


def _told_apart(live: DataFrame, similarity: float) -> DataFrame:
    """`live` with the entries of hot keys, where that halves the pairs, replaced by ones for the key and a later one of the row.

    Rows that share two keys or more share the first two of them, in the order that all rows have: pairs that have a hot
    key as the first meet again in the key that stands for both.  Rows of one shingle, which alone share just one, have
    equal shingles if they are similar, and those have been compared.
    """
    def pairs(entries: DataFrame, *by: str) -> DataFrame:
        """How many pairs of different components the rows of each key make, if they all meet its largest one's and each other."""
        sizes = entries.groupBy(*by, "c").agg(F.count("*").alias("n")).groupBy(*by).agg(F.sum("n").alias("m"), F.max("n").alias("top"))
        return sizes.withColumn("pairs", F.col("m") * (F.col("m") - F.col("top")))

    plain = live.filter(_plain(similarity))
    many = pairs(plain, "key").filter(F.col("m") > HOT).select("key", F.col("pairs").alias("all_pairs"))
    hot = plain.join(many.hint("merge"), "key")
    later = live.select("id", F.col("key").alias("second"), F.col("pos").alias("at"))
    both = materialise(hot.join(later.hint("merge"), "id").filter("at > pos").select("key", "second", "id", "size", "pos", "c"))
    apart = pairs(both, "key", "second").groupBy("key").agg(F.sum("pairs").alias("pairs"))
    fewer = materialise(many.join(apart, "key", "left").filter(2 * F.coalesce("pairs", F.lit(0)) < F.col("all_pairs")).select("key"))
    apart = both.join(fewer.hint("merge"), "key", "left_semi").select(F.xxhash64("key", "second").alias("key"), "id", "size", "pos", "c")
    out = materialise(plain.join(fewer.hint("merge"), "key", "left_anti").select("key", "id", "size", "pos", "c").unionByName(apart))
    release(both, fewer)
    return out


def similar_links(entries: DataFrame, similarity: float, verify: Callable[[DataFrame], DataFrame], near: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) that connect just the rows which pairs of that similarity connect.

    `entries` (key, id, size, pos) are the rows' prefixes, best without the keys that one row has, a written table, which is deleted; `verify` returns those of the pairs
    (a, b), a < b, that have the similarity.  The pairs `near` are verified first: what they link is one component.  Then
    every row meets PIVOTS rows of each key, others in each round, while that still links a good part.  Then all pairs of
    different components that share a key are compared: within a key, the rows outside its largest component with all
    others, in blocks of rows that tasks share; a key with over HOT rows is told apart by a second one first, where that
    makes fewer pairs.  Pairs inside a component need no comparison, so the work grows with the pairs that share a rare
    shingle but no component.  Python never holds a key's rows.
    """
    live = materialise(entries.withColumn("c", F.col("id")))
    release(entries)
    tried = edges = None

    def compare(pairs: DataFrame) -> tuple[int, int]:
        nonlocal tried, edges
        pairs = materialise(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        good = materialise(verify(pairs))
        tried, edges = (pairs, good) if tried is None else (tried.unionByName(pairs), edges.unionByName(good))
        return pairs.count(), good.count()

    def settle(live: DataFrame, moved: bool) -> DataFrame:
        """Entries of keys that several components have, with the component that has most of them."""
        now = _with_component(live.drop("c"), edges) if moved else live
        sizes = now.groupBy("key", "c").count().groupBy("key").agg(F.count("*").alias("components"), F.max(F.struct("count", "c"))["c"].alias("most"))
        out = materialise(now.join(sizes.filter("components > 1").hint("merge"), "key").select("key", "id", "size", "pos", "c", "most"))
        release(live)
        return out

    live = settle(live, near is not None and compare(near)[1] > 0)
    for number in count(1):
        order, most = F.xxhash64("id", F.lit(number)), PIVOTS[number > 1]
        plain = live.filter(_plain(similarity))
        pivots = plain.groupBy("key", F.pmod(order, F.lit(most))).agg(F.min(F.struct(order.alias("o"), "id", "size", "pos", "c")).alias("p")).select("key", "p.*")
        rest = plain if number == 1 else plain.filter("c <> most")
        met = rest.alias("x").join(pivots.alias("y").hint("merge"), F.col("x.key") == F.col("y.key")).filter(F.col("x.c") != F.col("y.c"))
        compared, linked = compare(met.filter(_can_be_similar(similarity)).select(*_pairs("x.id", "y.id")).distinct())
        live = settle(live.drop("most"), linked > 0)
        if number > 1 and 10 * linked <= compared:
            break
    apart = _told_apart(live.drop("most"), similarity)
    release(live)
    live = settle(apart, False)
    numbers = live.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = live.join(numbers.hint("merge"), "key")
    few = dealt.filter("c <> most").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    all_ = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = few.alias("x").join(all_.alias("y").hint("merge"), (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")))
    met = met.filter((F.col("x.c") != F.col("y.c")) & ((F.col("y.c") == F.col("y.most")) | (F.col("x.id") < F.col("y.id"))) & _can_be_similar(similarity))
    compare(met.select(*_pairs("x.id", "y.id")).distinct())
    release(live)
    return edges


def _similarities(a: list[bytes], b: list[bytes], words: int) -> list[float]:
    out = []
    for x, y in zip(a, b):
        own, other = set(shingles_of(x, words)), set(shingles_of(y, words))
        out.append(len(own & other) / len(own | other) if own or other else 1.0)
    return out


def similar_classes(df: DataFrame, id_col: str, text: str, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id) of the rows that have a partner: classes of texts whose word shingles have that Jaccard similarity.

    Equal texts (of one length and two equal hashes) are one class to begin with.  Of the different ones, those with SimHash words (over distinct shingles)
    within 3 bits of each other meet by ball hashing and are verified on the shingles of the whole texts.  Similar texts
    can differ in more bits: the rest is found by the rarest shingles, one of which every similar pair shares, and is
    verified likewise, so no pair of the similarity is left unconnected.  Wordless texts are alike; rows with a null id
    have no class; repeated ids count as one row.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    marked = with_prefix(rows, words, similarity, common_shingles(rows, words))
    # equal texts have one length and two equal hashes
    data = F.coalesce("t", F.lit(""))
    marked = materialise(marked.select("id", "size", "f", "prefix", F.xxhash64(data).alias("h"), F.crc32(data.cast("binary")).alias("crc"), F.length(data).alias("n")).withColumn("row", F.monotonically_increasing_id()))
    alike = ["h", "crc", "n"]
    named = materialise(marked.select("id", *alike))
    # of rows with equal texts the one with the smallest id stands for all
    same = materialise(marked.filter("id is not null").groupBy(*alike).agg(F.min(F.struct("id", "row", "f")).alias("m"), F.count("*").alias("rows")).select(*alike, F.col("m.id").alias("first"), "m.row", "m.f", "rows"))
    own = marked.select("row", "id", "size", "prefix").join(same.select("row").hint("merge"), "row", "left_semi")
    entries = materialise(met_keys(own.select("id", "size", F.posexplode("prefix").alias("pos", "key"))))
    release(marked)

    prints = materialise(same.select("first", "f"))
    lowest = materialise(prints.groupBy("f").agg(F.min("first").alias("low")))
    ends = [lowest.select(F.col("f").alias(c), F.col("low").alias(f"low_{c}")) for c in "ab"]
    near = near_links(lowest.select("f")).join(ends[0].hint("merge"), "a").join(ends[1].hint("merge"), "b").select(*_pairs("low_a", "low_b"))
    equal = prints.join(lowest.hint("merge"), "f").filter("first <> low").select(*_pairs("first", "low"))
    near = near.unionByName(equal).filter("a <> b").distinct()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                got = _similarities(part.column("x").to_pylist(), part.column("y").to_pylist(), words)
                ok = pa.array([s >= similarity for s in got])
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(ok)

    spent: list[DataFrame] = []  # tables of the last call, whose result has been written

    def verify(pairs: DataFrame) -> DataFrame:
        release(*spent)
        spent.clear()
        wanted = materialise(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
        # joins with texts shuffle at every size: how many pairs there are is not known beforehand
        texts = materialise(_perhaps(rows, wanted).join(wanted.hint("merge"), "id", "left_semi").groupBy("id").agg(F.first(utf8("t")).alias("t")))
        spent.extend((wanted, texts))
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("x")).hint("merge"), "a").join(texts.select(F.col("id").alias("b"), F.col("t").alias("y")).hint("merge"), "b")
        return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")

    tree = connected_components(similar_links(entries, similarity, verify, near))
    copies = named.join(same.filter("rows > 1").select(*alike, "first"), alike).select("id", "first")
    linked = copies.select("id", "first").unionByName(tree.select(F.col("node").alias("id"), F.col("node").alias("first"))).distinct()
    return linked.join(tree.select(F.col("node").alias("first"), "component"), "first", "left").select(F.col("id"), F.coalesce("component", "first").alias("component_id")).distinct()


def keep_one_of_each(df: DataFrame, id_col: str, text: str, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `df` without those whose class has a smaller id; rows with a null id stay.

    Of several rows with one id, all stay or go together.
    """
    classes = similar_classes(df, id_col, text, words, similarity)
    gone = classes.filter("component_id < id").select(F.col("id").alias("__gone"))
    return df.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")

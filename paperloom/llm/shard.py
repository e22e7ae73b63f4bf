"""Balanced label propagation: linked documents move to their neighbours' shards under capacity quotas.

Links are given as memberships (row, link): rows that share a link are neighbours, so a link with a third of all rows
costs as many rows and no pairs.  Shards have exact quotas of rows.  Labels spread first: every row is a label of its own,
and in rounds labels go over to the neighbouring label that they share most links with for their sizes, none above a
shard's quota.  Labels are placed whole as far as they fit; small ones and rows without neighbours fill what is left.
Then rows move towards their neighbours' shards: every row names the shard where it gains most, and rows
go round rings of shards, as many into each as out of it, the greatest gains first, as long as a ring gains.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release, shuffle_partitions

#: Exchanges end when so many rounds in a row each added less than this share of all neighbours in the same shard.
LEAST_GAIN, IDLE = 0.001, 5
#: Rows go round rings of more than two shards if there are at most so many shards.
RINGS = 32
#: Labels spread until a round leaves more than this share of them.
LEFT = 0.98
#: A link with over one in so many memberships is joined by broadcast: there are fewer such links than this.
HOT = 256
#: Labels of over a quota's part of this are placed one by one: there are at most as many times the shards.
LARGE = 8
#: Gains are told apart by sign and power of two, up to this power.
POWERS = 40


def numbered(df: DataFrame, by: list[Column], order: list[Column], name: str, group: Column | None = None) -> DataFrame:
    """Add `name`: gapless numbers from 0 within each `group` (none: all rows), without a task that sees a whole group.

    Rows are dealt to cells by a hash of `by`; numbers are those in the cell plus the sizes of the cells before it.
    Rows that agree in `by` and `order` may be numbered either way.
    """
    n = 4 * shuffle_partitions(df.sparkSession)
    group = F.lit(0) if group is None else group
    celled = df.withColumns({"__g": group, "__c": F.pmod(F.xxhash64(*by), F.lit(n))})
    sizes = celled.groupBy("__g", "__c").count()
    before = F.sum("count").over(Window.partitionBy("__g").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__g", "__c", F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__g", "__c").orderBy(*order)) - 1
    return celled.withColumn("__r", inside).join(F.broadcast(starts), ["__g", "__c"]).withColumn(name, F.col("__start") + F.col("__r")).drop("__g", "__c", "__start", "__r")


def _with_link(member: DataFrame, around: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """`member` joined to `around`, one row of every link, by link; `around` has `n_link`, the link's memberships.

    Rows of the few links that have a great part of all are not gathered: such links, fewer than HOT, are broadcast.
    """
    hot = F.broadcast(around.filter(F.col("n_link") > total // HOT))
    rest = around.filter(F.col("n_link") <= total // HOT)
    cold = member.join(hot.select("link"), "link", "left_anti")
    return member.join(hot, "link", how).unionByName(cold.join(rest.hint("merge"), "link", how))


def _spread(member: DataFrame, cap: int, memberships: int, seed: int, ends: int | None) -> DataFrame | None:
    """(unit, to) for labels that go over to another one in this round, None if none does.

    `member` has (unit, link, m, n, d): a label's rows in the link and in all, and their neighbours, counted by row and link.  A link shows the labels with the least and the
    greatest number, and of those under half the cap also these and the one with most rows: all if it has two.  A label
    points to the one that it shares most pairs of linked rows with, for their sizes, of those it fits together with;
    labels that point to one another, and what points to these, become one label, as far as the cap allows.  If `ends`, the
    neighbours of all rows, is given, two labels go together only if they share more than neighbours dealt out at random.
    """
    label, small = F.struct("unit", "m", "n", "d"), F.col("n") * 2 <= cap
    shown = member.groupBy("link").agg(F.count("*").alias("n_link"), F.min(label).alias("a"), F.max(label).alias("b"), F.min(F.when(small, label)).alias("c"), F.max(F.when(small, label)).alias("d"),
                                       F.max_by(label, F.when(small, F.struct("m", F.xxhash64("unit", F.lit(seed))))).alias("e")).filter("n_link > 1")
    seen = F.array_distinct(F.transform(F.array_compact(F.array(*"abcde")), lambda x: F.struct(x["unit"].alias("to"), x["m"].alias("k"), x["n"].alias("n_to"), x["d"].alias("d_to"))))
    pairs = _with_link(member, shown.withColumn("seen", seen).drop(*"abcde"), memberships).select("unit", "m", "n", "d", F.explode("seen").alias("x"))
    fits = pairs.filter((F.col("x.to") != F.col("unit")) & (F.col("n") + F.col("x.n_to") <= cap))
    shared = fits.groupBy("unit", F.col("x.to").alias("to")).agg(F.sum(F.col("m") * F.col("x.k")).alias("w"), F.max("n").alias("n"), F.max("x.n_to").alias("n_to"), F.max("d").alias("d"), F.max("x.d_to").alias("d_to"))
    if ends is not None:
        shared = shared.filter(F.col("w") > F.col("d") / ends * F.col("d_to"))
    rating = F.round(F.col("w") / F.col("n") / F.col("n_to"), 9)
    points = materialise(shared.groupBy("unit").agg(F.max(F.struct(rating.alias("r"), F.xxhash64("to", F.lit(seed)).alias("h"), "to", "n_to")).alias("x"), F.max("n").alias("n")).select("unit", "x.to", "n", "x.n_to"))
    # of two that point to one another the smaller number stays
    back = points.select(F.col("unit").alias("to"), F.col("to").alias("again"), F.col("n").alias("n_mid"), F.col("n_to").alias("n_again"))
    both = points.join(back, "to")
    twins = both.filter(F.col("again") == F.col("unit")).select(F.col("unit").alias("one"), F.least("unit", "to").alias("root"), (F.col("n") + F.col("n_to")).alias("n_root"))
    joins = both.join(twins, F.col("to") == F.col("one")).filter(F.col("unit") != F.col("root")).select("unit", "root", "n", "n_root", (F.col("again") == F.col("unit")).alias("twin"))
    joins = materialise(joins)
    load = joins.filter("not twin").groupBy("root").agg(F.sum("n").alias("more"))
    share = (cap - F.col("n_root")) / F.col("more")
    lucky = F.pmod(F.xxhash64("unit", F.lit(seed + 1)), F.lit(1 << 20)) < share * (1 << 20)
    out = materialise(joins.join(load, "root", "left").filter(F.col("twin") | (F.coalesce(share, F.lit(1.0)) >= 1) | lucky).select("unit", F.col("root").alias("to")))
    release(points, joins)
    if out.isEmpty():
        release(out)
        return None
    return out


def _labels(member: DataFrame, cap: int, memberships: int) -> DataFrame:
    """(row, label, wide) of linked rows: labels of at most about `cap` rows that share more links than by chance, and wide
    ones, made of those that share any."""
    around = member.groupBy("link").agg((F.count("*") - 1).alias("d"), F.count("*").alias("n_link"))
    rows = materialise(_with_link(member, around, memberships).groupBy("row").agg(F.sum("d").alias("d")).withColumn("label", F.col("row")))
    now = materialise(member.join(rows, "row").select(F.col("row").alias("unit"), "link", F.lit(1).cast("long").alias("m"), F.lit(1).cast("long").alias("n"), "d"))
    ends = rows.agg(F.sum("d")).first()[0] or 0
    seed, narrow = 0, None
    for ends_now in (ends, None):
        left = None
        while True:
            seed += 2
            moves = _spread(now, cap, memberships, seed, ends_now)
            if moves is None:
                break
            new_rows = materialise(rows.join(moves, rows["label"] == moves["unit"], "left").select("row", F.coalesce("to", "label").alias("label"), "d"))
            sizes = new_rows.groupBy(F.col("label").alias("unit")).agg(F.count("*").alias("n"), F.sum("d").alias("d"))
            named = now.join(moves, "unit", "left").select(F.coalesce("to", "unit").alias("unit"), "link", "m")
            new_now = materialise(named.groupBy("unit", "link").agg(F.sum("m").alias("m")).join(sizes, "unit"))
            release(*[x for x in (rows, now, moves) if x is not narrow])
            rows, now = new_rows, new_now
            units = now.select("unit").distinct().count()
            if left is not None and units > LEFT * left:
                break
            left = units
        narrow = narrow or rows
    out = materialise(narrow.drop("d").join(rows.select("row", F.col("label").alias("wide")), "row"))
    release(now, *{id(x): x for x in (narrow, rows)}.values())
    return out


class Room:
    """What shards have left, and where parts of labels go: (label, first, end, shard) by the rows' places in the label."""

    def __init__(self, room: list[int]):
        self.room, self.parts = list(room), []

    def most(self) -> int:
        return max(range(len(self.room)), key=lambda s: (self.room[s], -s))

    def put(self, label: int, n: int, s: int, first: int = 0) -> None:
        if n:
            self.parts.append((label, first, first + n, s))
            self.room[s] -= n

    def place(self, groups: list[list[tuple[int, int]]]) -> None:
        """Groups of (label, size), the largest first: whole where one fits into the shard with most room, else label by
        label, and what fits nowhere in parts that fill shards."""
        for group in sorted(groups, key=lambda g: (-sum(n for _, n in g), g)):
            whole = self.most()
            together = sum(n for _, n in group) <= self.room[whole]
            for label, n in sorted(group, key=lambda x: (-x[1], x[0])):
                s = whole if together else self.most()
                first = 0
                while first < n and self.room[s]:
                    take = min(n - first, self.room[s])
                    self.put(label, take, s, first)
                    first += take
                    s = self.most()

    def rows(self, labels: DataFrame) -> DataFrame:
        """(row, shard) of the rows of the labels placed."""
        columns = dict(zip(("label", "first", "end", "shard"), zip(*self.parts) if self.parts else [()] * 4))
        table = labels.sparkSession.createDataFrame(pa.table({c: pa.array(v, pa.int64()) for c, v in columns.items()}), "label long, first long, end long, shard long")
        own = labels.join(F.broadcast(table.select("label").distinct()), "label")
        inside = numbered(own, [F.col("row")], [F.col("row")], "at", F.col("label"))
        return inside.join(F.broadcast(table), "label").filter((F.col("at") >= F.col("first")) & (F.col("at") < F.col("end"))).select("row", F.col("shard").cast("int").alias("shard"))


def _filled(rest: DataFrame, by: Column, room: list[int]) -> DataFrame:
    """`rest` with `shard`: rows fill what room shards have, those that agree in `by` side by side."""
    ends, at = [], 0
    for r in room:
        at += r
        ends.append(at)
    turned = numbered(rest, [by], [by, F.col("row")], "turn")
    return turned.withColumn("shard", F.coalesce(*[F.when(F.col("turn") < e, F.lit(s)) for s, e in enumerate(ends)], F.lit(len(room) - 1)).cast("int")).drop("turn")


def _start(rows: DataFrame, labels: DataFrame, shards: int, quota: list[int]) -> DataFrame:
    """(row, shard): labels are placed whole as far as that goes, then rows without one.

    Large labels go one by one, those of a wide one together if they fit; small ones in a line over what is left, of which the
    few that a border cuts are then placed as large ones are.  Sizes of at most LARGE labels a shard, and of those at
    borders, are on the driver.
    """
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"), F.first("wide").alias("wide"))
    large = sizes.filter(F.col("n") * LARGE > max(quota)).toArrow().to_pylist()
    groups: dict[int, list[tuple[int, int]]] = {}
    for x in large:
        groups.setdefault(x["wide"], []).append((x["label"], x["n"]))
    room = Room(quota)
    room.place(list(groups.values()))
    placed = materialise(room.rows(labels))
    small = materialise(labels.join(placed, "row", "left_anti"))
    # those of a wide label stand side by side
    line = materialise(_filled(small.withColumn("by", F.struct(F.xxhash64("wide"), "wide", "label")), F.col("by"), room.room).select("row", "label", "shard"))
    cut = line.groupBy("label").agg(F.count_distinct("shard").alias("k"), F.count("*").alias("n")).filter("k > 1").toArrow().to_pylist()
    kept = line.join(F.broadcast(_column(labels, "label", [x["label"] for x in cut])), "label", "left_anti").select("row", "shard")
    used = {r["shard"]: r["count"] for r in kept.groupBy("shard").count().collect()}
    border = Room([r - used.get(s, 0) for s, r in enumerate(room.room)])
    border.place([[(x["label"], x["n"])] for x in cut])
    start = materialise(placed.unionByName(kept).unionByName(border.rows(line.select("row", "label"))))
    single = rows.select("row").join(start, "row", "left_anti")
    out = materialise(start.unionByName(_filled(single, F.col("row"), border.room).select("row", "shard")))
    release(placed, small, line, start)
    return out


def _column(df: DataFrame, name: str, values: list[int]) -> DataFrame:
    return df.sparkSession.createDataFrame(pa.table({name: pa.array(values, pa.int64())}), f"{name} long")


def _matched(found: list, shards: int) -> list[int]:
    """How many rows go from shard a to shard b (at a * shards + b), so that no shard's size changes.

    `found` has (shard, to, power, n, gain): rows that name `to`, by the sign and power of two of their gain.  Rows go round
    rings of two to four shards (of two, if there are over RINGS shards), those with the greatest mean gain first, as long
    as a ring gains.
    """
    by: dict[tuple[int, int], list[list]] = {}
    for r in sorted(found, key=lambda r: r["power"]):
        by.setdefault((r["shard"], r["to"]), []).append([r["n"], r["gain"] / r["n"]])
    flow = [0] * (shards * shards)
    w = np.full((shards, shards), -np.inf)
    for (a, b), left in by.items():
        w[a, b] = left[-1][1]
    while True:
        rings = [(w + w.T) / 2]
        if shards <= RINGS:
            steps = w[:, :, None] + w[None, :, :]
            through, two = steps.argmax(1), steps.max(1)
            four = (two + two.T) / 4
            four[through == through.T] = -np.inf  # two rings of two
            rings += [(two + w.T) / 3, four]
        size, (a, b) = max(((n, np.unravel_index(x.argmax(), x.shape)) for n, x in enumerate(rings)), key=lambda x: rings[x[0]][x[1]])
        if not rings[size][a, b] > 1e-9:
            return flow
        a, b = int(a), int(b)
        ring = [a, b] if size == 0 else [a, int(through[a, b]), b] if size == 1 else [a, int(through[a, b]), b, int(through[b, a])]
        edges = list(zip(ring, [*ring[1:], a]))
        n = min(by[e][-1][0] for e in edges)
        for e in edges:
            flow[e[0] * shards + e[1]] += n
            by[e][-1][0] -= n
            if not by[e][-1][0]:
                by[e].pop()
                w[e] = by[e][-1][1] if by[e] else -np.inf


def _exchanged(now: DataFrame, member: DataFrame, memberships: int, shards: int) -> DataFrame:
    """(row, shard) after rounds of exchanges between shards; the best round is kept.  Sizes of shards stay."""
    best, last, idle = None, None, 0
    for number in count():
        counts = [F.count_if(F.col("shard") == s).alias(f"n{s}") for s in range(shards)]
        placed = member.join(now, "row")
        around = placed.groupBy("link").agg(F.count("*").alias("n_link"), *counts)
        votes = _with_link(placed, around, memberships).groupBy("row").agg(F.array(*[F.sum(f"n{s}") for s in range(shards)]).alias("votes"), F.count("*").alias("own"))
        told = now.join(votes, "row", "left")
        # a row counts itself in each of its links
        seen = lambda s: F.coalesce(F.get("votes", s), F.lit(0))
        here = seen(F.col("shard")) - F.coalesce("own", F.lit(0))
        # in every other round a row leaves half of the shards out, as those that gain most may take nobody
        open_ = lambda s: (F.pmod(F.xxhash64("row", s, F.lit(-number)), F.lit(2)) == 0) if number % 2 else F.lit(True)
        named = F.array_max(F.transform(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: (s != F.col("shard")) & open_(s)), lambda s: F.struct(seen(s).alias("v"), F.xxhash64("row", s, F.lit(number)).alias("h"), s.alias("to"))))
        # half of the rows may go, so that neighbours don't just change places
        gain = F.col("x.v") - F.col("here")
        power = F.when(gain.isNull() | (gain == 0), 0).otherwise(F.signum(gain) * (1 + F.least(F.lit(POWERS), F.floor(F.log2(F.abs(gain)))))).cast("int")
        wishes = materialise(told.select("row", "shard", here.alias("here"), named.alias("x")).select("row", "shard", F.col("x.to").cast("int").alias("to"), "here", gain.alias("gain"), power.alias("power"), (F.pmod(F.xxhash64("row", F.lit(-number - 1)), F.lit(2)) == 0).alias("may")))
        found = wishes.groupBy("shard", "to", "power", "may").agg(F.count("*").alias("n"), F.sum("gain").alias("gain"), F.sum("here").alias("here")).collect()
        agree = sum(r["here"] for r in found)
        if best is None or agree > best[0]:
            if best is not None:
                release(best[1])
            best = (agree, now)
        idle = idle + 1 if last is not None and agree < max(last * (1 + LEAST_GAIN), last + 1) else 0
        last = agree
        flow = _matched([r for r in found if r["may"] and r["to"] is not None], shards)
        if idle == IDLE or not (number % 2 or any(r["power"] > 0 for r in found)):  # or nobody gains anywhere
            release(wishes)
            break
        if not any(flow):
            release(wishes)
            continue
        may = wishes.filter("may")
        most = F.get(F.array(*map(F.lit, flow)), F.col("shard") * shards + F.col("to"))
        going = _first(may.filter(most > 0), most).select("row", F.col("to").alias("next"))
        new = materialise(wishes.select("row", "shard").join(going, "row", "left").select("row", F.coalesce("next", "shard").alias("shard")))
        if now is not best[1]:
            release(now)
        release(wishes)
        now = new
    return best[1]


def _first(rows: DataFrame, most: Column) -> DataFrame:
    """Of the rows that go from a shard to another the first `most` by power of gain, without a task that sees all of them."""
    n = 4 * shuffle_partitions(rows.sparkSession)
    celled = rows.withColumns({"__c": F.pmod(F.xxhash64("row"), F.lit(n)), "__most": most})
    sizes = celled.groupBy("shard", "to", "power", "__c").count()
    before = F.sum("count").over(Window.partitionBy("shard", "to").orderBy(F.desc("power"), "__c").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "to", "power", "__c", F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("shard", "to", "power", "__c").orderBy("row")) - 1
    return celled.withColumn("__r", inside).join(starts, ["shard", "to", "power", "__c"]).filter(F.col("__start") + F.col("__r") < F.col("__most"))


def propagate(rows: DataFrame, links: DataFrame, shards: int) -> DataFrame:
    """(row, shard) for `rows` (row: distinct whole numbers); `links` has (row, link).

    Shard sizes differ by one row at most.  Links with one row, null ends and repeated memberships count for nothing.
    Ties go by hashes of the rows' numbers, so reruns agree.  The sizes of large labels, and counts of wishes by pair of
    shards and power of two, are all that reaches the driver, and no Python worker runs.  Exchanges go on until they add less than
    a thousandth to the neighbours in the same shard for five rounds; the best round is kept.
    """
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    member = materialise(links.filter("row is not null and link is not null").distinct())
    memberships = member.count()
    counted = materialise(member.groupBy("link").agg(F.count("*").alias("n_link")).filter("n_link > 1"))
    linked = materialise(_with_link(member, counted, memberships, "left_semi"))
    release(member)
    labels = _labels(linked, max(quota), memberships)
    now = _start(rows, labels, shards, quota)
    release(labels)
    return _exchanged(now, linked, memberships, shards)


def balanced_shards(df: DataFrame, id_col: str, text: str, shards: int = 8) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row: equal texts (of one size and two hashes) are linked, shard sizes differ by one row at most.

    `size` is the text's UTF-8 bytes plus 1, null texts count as absent (size 1, crc of nothing) and are linked with
    each other and with empty ones.  Repeated ids are rows like others.  `slot` numbers a shard's rows from 0.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = df.select(F.col(id_col).alias("id"), (F.length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("crc"), F.xxhash64(data).alias("hash"))
    order = [F.col(c) for c in ("id", "crc", "hash", "size")]
    rows = materialise(numbered(slim, order, order, "row"))
    placed = materialise(propagate(rows.select("row"), rows.select("row", F.struct("hash", "crc", "size").alias("link")), shards))
    slots = numbered(placed, [F.col("row")], [F.col("row")], "slot", F.col("shard"))
    return rows.join(slots, "row").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")

"""Exact nearest neighbours of a stated query set, in blocks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import materialise, release, shared_dir

#: Queries that are broadcast at once, and rows that are multiplied with them at once, at most and at first.
QUERIES, ROWS, FIRST = 2048, 1024, 64
#: Tasks that scan the rows, or as many as run at once: each sends k rows for a query.
TASKS = 16


def unit(v: Column) -> Column:
    """The vector at length 1, as doubles; a zero vector stays zero."""
    wide = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(F.arrays_zip(wide.alias("v"), F.array_repeat(norm, F.size(wide)).alias("n")), lambda x: x["v"] / x["n"])).otherwise(wide)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


class _Best:
    """The k best of the rows seen, for each of n queries; of rows of one kin the best alone.

    `floor` is the similarity that a query's k-th row has, once it has k, and `least` what a product has to reach so that
    it can round to it: whatever is below is left out by one comparison, before it is rounded or sorted.
    """

    def __init__(self, n: int, k: int, digits: int):
        self.n, self.k, self.digits = n, k, digits
        self.floor, self.last, self.least = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max), np.full(n, -np.inf)
        self.held = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new, self.waiting = [], 0

    def add(self, sim: np.ndarray, key: np.ndarray, kin: np.ndarray, own: np.ndarray | None) -> None:
        """Rows with their products with all queries (queries x rows); `own` has keys of rows that their query leaves out."""
        number, at = np.nonzero(sim >= self.least[:, None])
        near, key, kin = np.round(sim[number, at], self.digits) + 0.0, key[at], kin[at]
        floor = self.floor[number]
        wanted = (near > floor) | ((near == floor) & (key < self.last[number]))
        wanted &= near > -np.inf
        if own is not None:
            wanted &= own[number] != key
        self.new.append((number[wanted], near[wanted], key[wanted], kin[wanted]))
        self.waiting += int(wanted.sum())
        if self.waiting > max(len(self.held[0]) // 2, 8 * self.n):
            self.settle()

    def settle(self) -> None:
        number, sim, key, kin = (np.concatenate(x) for x in zip(self.held, *self.new))
        order = np.lexsort((key, -sim, number))
        number, sim, key, kin = (x[order] for x in (number, sim, key, kin))
        same = np.lexsort((kin, number))  # stable, so the best of a kin stands first
        first = np.ones(len(same), bool)
        first[1:] = (number[same][1:] != number[same][:-1]) | (kin[same][1:] != kin[same][:-1])
        kept = np.zeros(len(same), bool)
        kept[same[first]] = True
        number, sim, key, kin = (x[kept] for x in (number, sim, key, kin))
        rank = np.arange(len(number)) - np.searchsorted(number, number)
        end = rank == self.k - 1
        self.floor[number[end]], self.last[number[end]] = sim[end], key[end]
        self.least = self.floor - 10.0 ** -self.digits
        inside = rank < self.k
        self.held, self.new, self.waiting = tuple(x[inside] for x in (number, sim, key, kin)), [], 0


def _block(rows: DataFrame, ask: dict, k: int, digits: int, others: bool) -> DataFrame:
    """(number, sim, key, kin): the k best rows of each task for each query, of rows of one kin the best alone."""
    sent = rows.sparkSession.sparkContext.broadcast(ask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = sent.value["vector"], sent.value["key"]
        best, step = _Best(len(q), k, digits), FIRST
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                b = whole.slice(at, step)
                key, kin = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
                best.add(q @ _matrix(b.column(1), q.shape[1]).T, key, kin, own if others else None)
                at, step = at + step, min(2 * step, ROWS)
        best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.held], ["number", "sim", "key", "kin"])

    return rows.mapInArrow(run, "number long, sim double, key long, kin long")


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, digits: int = 4, kin: str | None = None, others: bool = True) -> DataFrame:
    """(query, key, sim, rank): the k rows with the largest inner product for each query, itself left out if `others`.

    Vectors are doubles of one length (ValueError for other queries than rows), keys long; rows without either take no
    part.  Of equals by `digits` places the smaller key comes first.  Of rows that agree in the column `kin` the first one
    alone counts, by a 64-bit hash; a null is no kin.  The scan is exact: queries go out in blocks of QUERIES, each
    block's job multiplies them with the rows of every task and keeps k for each query there, so a task sends queries
    times k rows, whatever it read.  The rows are written once, whatever they are made from, and a number of tasks that
    doesn't grow with them scans them, so what is sent grows with the queries.  No pair of rows is made in Spark.  A block
    of queries is all that is on the driver.
    """
    spark = vectors.sparkSession
    kins = F.xxhash64(F.lit(0), F.col(key)) if kin is None else F.coalesce(F.when(F.col(kin).isNotNull(), F.xxhash64(F.lit(1), F.col(kin))), F.xxhash64(F.lit(0), F.col(key)))
    rows = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"), kins.alias("kin"))
    asked = queries.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    rows = materialise(rows)
    # blocks are ranges of the keys, cut where a count by range says so; equal keys are one query
    asked = materialise(asked.dropDuplicates(["key"]))
    widths = {w for df in (rows, asked) for w in df.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()} - {None}
    if len(widths) > 1:
        raise ValueError(f"vectors of {sorted(widths)} dimensions can't be compared")
    total = asked.count()
    blocks = -(-total // QUERIES)
    cuts = [float("-inf"), *(asked.approxQuantile("key", [i / blocks for i in range(1, blocks)], 0.0) if blocks > 1 else []), float("inf")]
    rows = rows.coalesce(max(TASKS, spark.sparkContext.defaultParallelism))
    path = f"{shared_dir(spark)}/paperloom/{uuid.uuid4().hex}"
    written = []
    for low, high in zip(cuts, cuts[1:]):
        some = asked.filter((F.col("key") > low) & (F.col("key") <= high)).toArrow().sort_by("key").combine_chunks()
        if not some.num_rows:
            continue
        found = some["vector"].combine_chunks()
        ask = {"key": some["key"].to_numpy(), "vector": _matrix(found, len(found[0]))}
        names = spark.createDataFrame(pa.table({"number": np.arange(some.num_rows), "query": ask["key"]}), "number long, query long")
        first = Window.partitionBy("number", "kin").orderBy(F.desc("sim"), "key")
        order = Window.partitionBy("number").orderBy(F.desc("sim"), "key")
        best = _block(rows, ask, k, digits, others).repartition("number")  # both orders hold what this deals out
        best = best.withColumn("rank", F.row_number().over(first)).filter("rank = 1")
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        best.join(F.broadcast(names), "number").select("query", "key", "sim", "rank").write.parquet(f"{path}/{len(written)}")
        written.append(f"{path}/{len(written)}")
    release(rows, asked)
    schema = "query long, key long, sim double, rank int"
    out = spark.read.schema(schema).parquet(*written) if written else spark.createDataFrame([], schema)
    return out.withColumnRenamed("key", key)


def coherence(near: DataFrame, labels: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """(coherence, n): the mean share of a query's k neighbours that have its label, over the queries with a label.

    An absent or empty label is none, and no neighbour counts for having none.
    """
    named = labels.filter(F.col(label).isNotNull() & (F.col(label).cast("string") != "")).select(F.col(key), F.col(label).alias("__l"))
    own = near.filter(F.col("rank") <= k).join(named.select(F.col(key).alias("query"), F.col("__l").alias("__q")), "query")
    each = own.join(named, key, "left").groupBy("query").agg((F.count_if(F.col("__l") == F.col("__q")) / k).alias("share"))
    return each.agg(F.round(F.avg("share"), 6).alias("coherence"), F.count("*").alias("n"))


def purity(near: DataFrame, members: DataFrame, key: str, group: str, k: int = 10, least: int = 4) -> DataFrame:
    """(group, purity, n): by group the mean share of its queries' k neighbours that are in the group too.

    `members` has a row for each group of a row, which may be in several; groups with fewer than `least` queries are left
    out.  Memberships are joined by group and key, so a group with many members meets no other group's rows.
    """
    own = members.filter(F.col(group).isNotNull()).select(F.col(group), F.col(key)).distinct()
    asked = near.filter(F.col("rank") <= k).join(own.withColumnRenamed(key, "query"), "query")
    inside = asked.join(own.withColumn("__in", F.lit(1)), [group, key], "left")
    each = inside.groupBy(group, "query").agg((F.count("__in") / k).alias("share"))
    return each.groupBy(group).agg(F.round(F.avg("share"), 6).alias("purity"), F.count("*").alias("n")).filter(F.col("n") >= least)


def gain(scores: dict[str, tuple[DataFrame, DataFrame]], least: float = 1.0) -> DataFrame:
    """(metric, a, b, points, worth): what vectors b gain over vectors a, in points of a hundred, from (coherence, purity)
    of either; `worth` if both gains together are over `least`."""
    parts = []
    for name, (share, groups) in scores.items():
        parts += [share.select(F.lit("coherence").alias("metric"), F.lit(name).alias("side"), F.col("coherence").alias("value")), groups.agg(F.avg("purity").alias("value")).select(F.lit("purity").alias("metric"), F.lit(name).alias("side"), "value")]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    first, second = scores
    side = rows.groupBy("metric").agg(F.max(F.when(F.col("side") == first, F.col("value"))).alias("a"), F.max(F.when(F.col("side") == second, F.col("value"))).alias("b"))
    points = side.withColumn("points", F.round(100 * (F.col("b") - F.col("a")), 4))
    both = points.agg(F.coalesce(F.sum("points") > least, F.lit(False)).alias("worth"))
    return points.crossJoin(F.broadcast(both)).select("metric", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), "points", "worth")  # one row

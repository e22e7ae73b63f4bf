"""Top-k, tiers, slots, slices and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import materialise


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n of each group with their rank.  Spark cuts groups before the shuffle (WindowGroupLimit)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= n)


def max_record(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The row of the greatest value of each key, the first by `order` on ties."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce(value, F.lit(0)), -F.col(order))).alias("r")).select(key, "r.*")


def frequency_map(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """(key, mix): the n commonest values of each key with their counts, as a map; ties by value."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(key, value).count()
    top = top_per_group(counted, [key], [F.desc("count"), F.col(value)], n)
    return top.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "count")))).alias("mix"))


def page(df: DataFrame, order: list[Column], number: int, size: int = 100) -> DataFrame:
    """Page `number` (from 0) of the ordered rows."""
    return df.orderBy(*order).offset(number * size).limit(size)


def rotating_slice(df: DataFrame, place: str, size: int, n: int, day_number: int, every: int = 3) -> DataFrame:
    """The slice whose turn it is: rows are numbered by `place` from 0, slices follow each other every few days."""
    slices = max(1, -(-n // size))
    return df.filter(F.floor(F.col(place) / size) == (day_number // every) % slices)


def reserved_slots(df: DataFrame, kind: str, reserved: str, score: str, tie: str, total: int, slots: int) -> DataFrame:
    """`total` best rows of which up to `slots` go to the reserved kind; what either side can't fill, the other gets.

    Only the best `total` of each side can matter, so both are cut first.
    """
    order = [F.desc(score), F.col(tie)]
    own = df.filter(F.col(kind) == reserved).orderBy(*order).limit(total).withColumn("side", F.lit(0))
    rest = df.filter(F.coalesce(F.col(kind) != reserved, F.lit(True))).orderBy(*order).limit(total).withColumn("side", F.lit(1))
    both = own.unionByName(rest)
    n = F.row_number().over(Window.partitionBy("side").orderBy(*order))
    room = F.when(F.col("side") == 0, slots).otherwise(total - slots)
    first = both.withColumn("n", n).withColumn("late", (F.col("n") > room).cast("int"))
    return first.orderBy("late", *order).limit(total).drop("n", "late", "side")


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each stratum in a fixed pseudo-random order."""
    return top_per_group(df, [stratum], [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)], n).drop("rank")


def digest_order(df: DataFrame, watched: str, tier: str, score: str, reputation: str, date: str, tie: str) -> DataFrame:
    """Block (watched, tier 1, tier 2, rest), then score times reputation, then date, as a rank inside the block."""
    block = F.when(F.col(watched), 0).when(F.col(tier) == 1, 1).when(F.col(tier) == 2, 2).otherwise(3)
    strength = F.coalesce(F.col(score), F.lit(-1)) * F.coalesce(F.col(reputation), F.lit(1.0))
    out = df.withColumns({"block": block, "strength": strength})
    return out.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("strength"), F.desc_nulls_last(date), tie)))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add `name`: row numbers from 0 in the given order, from counts of range partitions, not from one sorted task.

    The ranges are written once, so that counts and rows agree even if tasks are repeated.  Rows that the order doesn't
    tell apart are numbered either way.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).count()
    before = counts.withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    row = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("__part", part).join(F.broadcast(before.select("__part", "__before")), "__part").withColumn(name, row).drop("__part", "__before", "__at")  # a row for each partition

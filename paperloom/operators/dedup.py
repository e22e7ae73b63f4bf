"""Identity resolution: one row for each paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which must be total for reruns to agree."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def merge_batch(items: DataFrame, key: str, source: str, order: str) -> DataFrame:
    """One row for each key: the columns of the first by `order`, and `sources`, all of its sources sorted.

    Both come from one aggregation, so hot keys are combined before the shuffle.
    """
    rest = [c for c in items.columns if c != key]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("r")
    return items.groupBy(key).agg(first, F.array_sort(F.collect_set(source)).alias("sources")).select(key, "r.*", "sources")


def only_new(items: DataFrame, archive: DataFrame, key: str) -> DataFrame:
    """Items whose key the archive lacks."""
    return items.join(archive.select(key), key, "left_anti")


def filter_new(items: DataFrame, archive: DataFrame, key: str, source: str, order: str) -> DataFrame:
    """New items, one row each, with all their sources; those already archived go before anything is grouped."""
    return merge_batch(only_new(items, archive, key), key, source, order)


def collect(sources: list[DataFrame], order: str = "load_order") -> DataFrame:
    """All sources in order of priority; columns that one lacks are null, and `order` tells the source's place."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn(order, F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def fallback(primary: DataFrame, other: DataFrame) -> DataFrame:
    """The primary source, or the other one if it is empty."""
    some = primary.limit(1).select(F.lit(True).alias("__some"))
    return primary.unionByName(other.join(F.broadcast(some), F.lit(True), "left_anti"))

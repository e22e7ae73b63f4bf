"""State across runs: patches, upserts, cursors, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_empty(c: Column, kind: str) -> Column:
    """Null, an empty text or an empty array; false and 0 are values."""
    if kind == "string":
        return F.coalesce(c == "", F.lit(True))
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(c) == 0, F.lit(True))
    return c.isNull()


def insert_absent(archive: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """The archive with the items it lacks; what it has stays as it is."""
    return archive.unionByName(items.join(archive.select(key), key, "left_anti"), allowMissingColumns=True)


def patch(state: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Update the rows that exist with the non-empty fields of `changes` (one row for each key)."""
    kinds = dict(changes.dtypes)
    fields = [c for c in changes.columns if c != key]
    right = changes.select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    out = state.join(right, key, "left")
    return out.select(key, *[F.when(is_empty(F.col(f"__{c}"), kinds[c]), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) if c in fields else F.col(c) for c in state.columns if c != key])


def upsert(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The last value of each key."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def remote_wins(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Full outer merge by key in which the remote row wins."""
    fields = [c for c in local.columns if c != key]
    both = local.join(remote.select(key, F.lit(True).alias("__r"), *[F.col(c).alias(f"__{c}") for c in fields]), key, "full")
    return both.select(key, *[F.when(F.col("__r"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in fields])


def keep_recent(df: DataFrame, owner: list[str], touched: list[Column], n: int) -> DataFrame:
    """The n entries of each owner that were touched last."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*owner).orderBy(*touched))).filter(F.col("__n") <= n).drop("__n")


def uncached(items: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Items that have to be computed: those whose key (with model and width) the cache lacks."""
    return items.join(cache.select(*keys), keys, "left_anti")


def stale(items: DataFrame, cache: DataFrame, key: str, text: Column, digest: str) -> DataFrame:
    """Cached keys whose text has changed since."""
    now = items.select(key, F.sha1(text.cast("binary")).alias("__now"))
    return cache.join(now, key).filter(F.col("__now") != F.col(digest)).select(key)


def next_month(progress: DataFrame, month: str, done: str, current: str, floor: str) -> DataFrame:
    """The month a backfill works on: the newest not done one, else the one before the oldest, down to the floor."""
    open_ = progress.agg(F.max(F.when(~F.col(done), F.col(month))).alias("open"), F.min(month).alias("oldest"))
    before = F.date_format(F.add_months(F.to_date(F.concat(F.coalesce("oldest", F.lit(current)), F.lit("-01"))), -1), "yyyy-MM")
    return open_.select(F.coalesce("open", F.when(before >= floor, before)).alias(month))


def due(last_run: Column, as_of: Column, hours: int = 68) -> Column:
    """Whether a run is due: none so far, an unreadable time, or long enough ago."""
    then = F.try_to_timestamp(last_run)
    return then.isNull() | (F.timestamp_diff("HOUR", then, as_of) >= hours)

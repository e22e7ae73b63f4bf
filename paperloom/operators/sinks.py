"""Writers.  Paths are Spark paths; partitioned tables are overwritten by partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import numbered

SHARD_ROWS = 64


def export_recent_and_archive(items: DataFrame, date: str, seen: str, as_of: str, path: str, days: int = 60) -> None:
    """JSON lines of the recent window, by the content's date against `as_of`, and of everything, by year."""
    day = F.try_to_date(F.substring(F.coalesce(F.nullif(F.col(date), F.lit("")), F.col(seen)), 1, 10))
    dated = items.withColumn("year", F.coalesce(F.year(day), F.lit(0)))
    dated.filter(day >= F.date_sub(F.lit(as_of).cast("date"), days)).drop("year").write.mode("overwrite").json(f"{path}/recent")
    dated.write.mode("overwrite").partitionBy("year").json(f"{path}/archive")


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Overwrite only the partitions that `df` has: a month is recomputed without touching the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def delete_keys(path_df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return path_df.join(keys.select(key), key, "left_anti")


def vector_rows(items: DataFrame, vectors: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """(row, shard, key, vector): row numbers in archive order from 0, shards of 64 rows."""
    rows = numbered(items.join(vectors, key), [*order, F.col(key)], "row")
    return rows.withColumn("shard", F.floor(F.col("row") / SHARD_ROWS))


def digest(items: DataFrame, block: str, place: str, line: Column) -> DataFrame:
    """Lines of a digest by block and place; rendering stays outside."""
    return items.select(block, place, line.alias("line"))

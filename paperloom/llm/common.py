"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import materialise, release, shared_dir

__all__ = ["WORD", "apart", "crc_of_id", "materialise", "release", "shared_dir", "shuffle_partitions", "table", "utf8"]

#: A word: a run of anything but the ASCII white space 0x20 and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apart(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with its columns renamed by place, so that none is named like one that an operator makes, and their new names."""
    names = [f"__own{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


def utf8(column: str) -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))

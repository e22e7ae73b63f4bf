"""Corpus metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def share_of(df: DataFrame, key: list[str], condition, name: str) -> DataFrame:
    """Share of rows that meet the condition, by key."""
    return df.groupBy(*key).agg(F.round(F.avg(F.when(condition, 1.0).otherwise(0.0)), 6).alias(name))


def label_counts(df: DataFrame, tags: str) -> DataFrame:
    return df.select(F.explode(tags).alias("label")).groupBy("label").count()

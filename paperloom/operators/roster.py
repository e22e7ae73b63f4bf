"""The roster of watched authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import person_key

from .dedup import keep_first
from .gates import candidate_rank


def promoted_authors(items: DataFrame, authors: str, category: str, least: int = 3) -> DataFrame:
    """(name, n): first authors of at least so many core papers."""
    first = F.trim(F.get(F.split(authors, ","), F.lit(0)))
    return items.filter(F.col(category) == "core_fit").groupBy(first.alias("name")).agg(F.count("*").alias("n")).filter((F.col("n") >= least) & (F.col("name") != ""))


def resolve_authors(candidates: DataFrame, name: str, fields: str, allowed: list[str]) -> DataFrame:
    """The best candidate of each name: one of its first three fields must be allowed; the first of equals."""
    ok = candidates.filter(F.arrays_overlap(F.slice(fields, 1, 3), F.array(*map(F.lit, allowed))))
    scored = ok.withColumn("__rank", candidate_rank(F.col("h_index"), F.col("affiliation"), F.col("hint")))
    return keep_first(scored, [name], [F.desc("__rank"), F.col("pos")]).drop("__rank")


def build(pools: list[DataFrame], prior: DataFrame, quarter: Column) -> DataFrame:
    """Authors of all pools (author_id, name, source), the first pool winning; who was on the roster keeps source and quarter."""
    rows = None
    for i, p in enumerate(pools):
        p = p.select("author_id", "name", "source").withColumn("__pool", F.lit(i))
        rows = p if rows is None else rows.unionByName(p)
    once = keep_first(rows, ["author_id"], [F.col("__pool"), F.col("name")]).drop("__pool")
    old = prior.select("author_id", F.col("source").alias("__source"), F.col("added").alias("__added"))
    return once.join(old, "author_id", "left").select("author_id", "name", F.coalesce("__source", "source").alias("source"), F.coalesce(F.col("__added"), quarter).alias("added"))


def index(roster: DataFrame, name: str, order: str) -> DataFrame:
    """One entry for each person key, the last by `order`."""
    keyed = roster.withColumn("key", person_key(F.col(name))).filter("key is not null")
    return keep_first(keyed, ["key"], [F.desc(order)])


def venue_share(mix: Column, top: list[str]) -> Column:
    """100 times the share of works in top venues, from a map of venue to works."""
    entries = F.map_entries(mix)
    total = F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + e["value"])
    good = F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + F.when(F.lower(e["key"]).isin(*top), e["value"]).otherwise(0))
    return F.coalesce(100.0 * good / F.greatest(total, F.lit(1)), F.lit(0.0))


def rotation(roster: DataFrame, key: str) -> DataFrame:
    """Places 0, 1, ... in the order of the key, for rank.rotating_slice; a roster is a bounded, curated list."""
    return roster.withColumn("place", F.row_number().over(Window.orderBy(key)) - 1)

"""Merging the votes of several scorers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def lower_median(name: str) -> Column:
    """The middle value of a column, of two the lower; an aggregate."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {name})")


def ordered_mode(df: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """(key, value) the most frequent value, of equals the first in `order` (values outside it come last, by value)."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(value)), F.lit(0))
    counted = df.filter(F.col(value).isNotNull()).groupBy(*key, value).count()
    ranked = counted.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("count"), F.when(place == 0, len(order) + 1).otherwise(place), value)))
    return ranked.filter("__n = 1").select(*key, value)


def majority_flag(value: Column) -> Column:
    """True if most say true, false if some say false and none true, else null; an aggregate."""
    yes, all_ = F.count_if(value), F.count("*")
    return F.when(2 * yes > all_, True).when((yes == 0) & (F.count_if(~value) > 0), False)


def _mode(values: Column, order: list[str], tie: Column) -> Column:
    """The most frequent of an item's few values; of equals the first in `order`, else `tie`."""
    counted = F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), v.alias("v")))
    most = F.array_max(counted)["n"]
    winners = F.transform(F.filter(counted, lambda c: c["n"] == most), lambda c: c["v"])
    listed = F.filter(F.array(*map(F.lit, order)).cast("array<string>"), lambda v: F.array_contains(winners, v))
    return F.when(F.size(winners) == 1, F.get(winners, F.lit(0))).otherwise(F.coalesce(F.get(listed, F.lit(0)), tie))


def merge_votes(votes: DataFrame, key: str, levels: list[str], flags: list[str], tags: str, contribution: str, categories: dict[str, tuple[list[str], str | None]] | None = None, voter: str | None = None, vocabulary: list[str] | None = None) -> DataFrame:
    """One row for each item: lower medians of levels, majorities of flags, tags that half the voters gave, agreement.

    `categories` get their mode; of equals the first in the order given, else the neutral value given, else that of the
    first `voter`.  Tags keep the parser's rules: "other" only if none is left, three at most (the commonest first).
    Contributions of merged votes are provisional.
    """
    categories = categories or {}
    voters = F.count("*")
    spread = F.max(contribution) - F.min(contribution)
    base = votes.groupBy(key).agg(
        voters.alias("n_votes"), *[F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})").cast("int").alias(c) for c in levels],
        *[majority_flag(F.col(c)).alias(c) for c in flags], ((voters == 1) | (F.coalesce(spread, F.lit(0)) <= 1)).alias("agree"), F.lit(True).alias("provisional"),
        *[F.sort_array(F.collect_list(F.struct(F.lit(0) if voter is None else F.col(voter), F.col(c).alias("v")))).alias(f"__{c}") for c in categories])
    for c, (order, neutral) in categories.items():
        values = F.filter(F.transform(f"__{c}", lambda x: x["v"]), lambda v: v.isNotNull())
        base = base.withColumn(c, _mode(values, order, F.lit(neutral) if neutral is not None else F.get(values, F.lit(0)))).drop(f"__{c}")
    counted = votes.select(key, F.explode(F.array_distinct(tags)).alias("tag")).groupBy(key, "tag").count()
    kept = counted.join(base.select(key, "n_votes"), key).filter(2 * F.col("count") >= F.col("n_votes"))
    place = -F.col("count")
    if vocabulary is not None:
        at = F.array_position(F.array(*map(F.lit, vocabulary)).cast("array<string>"), F.col("tag"))
        kept, place = kept.filter(at > 0), at
    some = kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(place.alias("n"), "tag"))).alias("t"))
    names = F.transform("t", lambda x: x["tag"])
    real = F.array_remove(names, "other")
    return base.join(some.select(key, F.when(F.size(real) > 0, F.slice(real, 1, 3)).alias("tags")), key, "left").withColumn("tags", F.coalesce("tags", F.array(F.lit("other"))))


def failover(items: DataFrame, key: str, providers: list[DataFrame]) -> DataFrame:
    """Answers of the first provider that has one for each item; each is asked only for what is still missing."""
    out, missing = None, items.select(key).distinct()
    for i, p in enumerate(providers):
        got = p.join(missing, key, "left_semi").withColumn("provider", F.lit(i))
        out = got if out is None else out.unionByName(got)
        missing = missing.join(p.select(key), key, "left_anti")
    return out

"""Lists as the portal shows them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import filled, title_key

from .dedup import keep_first
from .rank import numbered


def searched(df: DataFrame, words: str, *columns: str) -> DataFrame:
    """Rows that hold the text somewhere in the columns, without case."""
    return df.filter(F.contains(F.lower(F.concat_ws(" ", *[filled(F.col(c)) for c in columns])), F.lit(words.lower())))


def ranked_after(df: DataFrame, month: str, score: str, tie: str, words: str, *columns: str) -> DataFrame:
    """Ranks of a month's list among those that the search leaves."""
    w = Window.partitionBy(month).orderBy(F.desc(score), tie)
    return searched(df, words, *columns).withColumn("rank", F.row_number().over(w))


def with_bars(df: DataFrame, group: str, value: str) -> DataFrame:
    """Add `bar`: the value over its group's maximum."""
    top = df.groupBy(group).agg(F.max(value).alias("__max"))
    return df.join(top, group).withColumn("bar", F.round(F.coalesce(F.try_divide(F.col(value), F.col("__max")), F.lit(0.0)), 4)).drop("__max")


def tag_view(df: DataFrame, tags: str, tag: str, fit: str) -> DataFrame:
    """Rows with a tag (or, for "desk", of fit 2 or more; for "all", every row)."""
    return df if tag == "all" else df.filter(F.col(fit) >= 2) if tag == "desk" else df.filter(F.array_contains(tags, tag))


def weighted_pick(df: DataFrame, terms: list[str], title: str, body: str, key: str, n: int) -> DataFrame:
    """The n best by 5 for each term in the title and 1 in the body; titles once; first those with a title hit."""
    hits = lambda c: sum((F.contains(F.lower(filled(F.col(c))), F.lit(t)).cast("int") for t in terms), F.lit(0))
    scored = df.withColumns({"__t": hits(title), "__b": hits(body), "__key": title_key(F.col(title))}).withColumn("score", 5 * F.col("__t") + F.col("__b")).filter("score > 0")
    once = keep_first(scored, ["__key"], [F.desc("score"), F.col(key)])
    return once.orderBy((F.col("__t") == 0).cast("int"), F.desc("score"), key).limit(n).drop("__t", "__b", "__key")


def toggled(saved: DataFrame, clicks: DataFrame, key: str) -> DataFrame:
    """Saved keys after clicks: every click adds a key or takes it away."""
    both = saved.select(key).distinct().unionByName(clicks.select(key))
    return both.groupBy(key).agg((F.count("*") % 2 == 1).alias("__on")).filter("__on").select(key)


def batches(df: DataFrame, order: list, size: int = 40, at_most: int | None = None) -> DataFrame:
    """Add `batch` and `item` (place in it) to what a model is asked, the first batches only if there is a budget.

    Numbers come from counts of ranges of the order, so no task sees all rows.
    """
    rows = df if at_most is None else df.orderBy(*order).limit(at_most * size)
    return numbered(rows, order, "__n").withColumns({"batch": F.floor(F.col("__n") / size), "item": F.col("__n") % size}).drop("__n")

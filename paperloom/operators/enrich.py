"""Enrichment joins.  Dimensions are joined without hints: Catalyst broadcasts what it knows to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import blank, person_key
from paperloom.session import materialise

from .rank import numbered


def fill_only(items: DataFrame, found: DataFrame, key: str, texts: list[str], numbers: list[str]) -> DataFrame:
    """Left join that fills blank texts and null numbers and never changes anything else (a stored 0 stays)."""
    right = found.select(key, *[F.col(c).alias(f"__{c}") for c in [*texts, *numbers]])
    out = items.join(right, key, "left")
    new = {c: F.when(blank(F.col(c)), F.coalesce(f"__{c}", c)).otherwise(F.col(c)) for c in texts} | {c: F.coalesce(c, f"__{c}") for c in numbers}
    return out.withColumns(new).drop(*[f"__{c}" for c in new])


def roster_match(items: DataFrame, item_id: str, authors: str, roster: DataFrame, name: str, rank: str) -> DataFrame:
    """(item, roster columns) of items with an author on the roster: the first author that matches, then the first entry."""
    people = items.select(item_id, F.posexplode(F.split(authors, "[;,]")).alias("__pos", "__person")).withColumn("__key", person_key(F.col("__person"))).filter("__key is not null")
    known = roster.withColumn("__key", person_key(F.col(name))).filter("__key is not null")
    met = people.join(known, "__key")
    rest = [c for c in roster.columns]
    return met.groupBy(item_id).agg(F.min_by(F.struct(*rest), F.struct("__pos", rank)).alias("r")).select(item_id, "r.*")


def best_of(exploded: DataFrame, key: str, value: str, order: str, columns: list[str]) -> DataFrame:
    """For each key the columns of the row with the greatest value, the first by `order` on ties."""
    return exploded.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(F.col(value), -F.col(order))).alias("r")).select(key, "r.*")


def percentile_of_max(items: DataFrame, key: str, dimension: DataFrame, value: str, name: str) -> DataFrame:
    """Add `name`: 100 times the dimension's value over its maximum; null for keys it lacks."""
    most = dimension.agg(F.max(value).alias("__max"))
    scaled = dimension.crossJoin(F.broadcast(most)).select(key, F.try_divide(100.0 * F.col(value), F.col("__max")).alias(name))  # one row is broadcast
    return items.join(scaled, key, "left")


def correct_top(rows: DataFrame, key: str, value: str, id_col: str, published: DataFrame, n: int) -> DataFrame:
    """The n rows of the highest value get the published value where that is higher; all others stay."""
    top = rows.orderBy(F.desc_nulls_last(value), id_col).limit(n).select(id_col, key)
    higher = top.join(published.groupBy(key).agg(F.max(value).alias("__new")), key).select(id_col, "__new")
    return rows.join(higher, id_col, "left").withColumn(value, F.greatest(value, "__new")).drop("__new")


#: Titles without an inner word that are broadcast at once, to be compared with every text.
SHORT_TITLES = 10_000


def contains_match(items: DataFrame, text: str, titles: DataFrame, title: str, title_id: str, item_id: str) -> DataFrame:
    """(item, title) pairs where the text contains the title, for a bounded list of titles (a curated set).

    Only the ends of a title can be parts of longer words in a text: its longest inner word is a whole word there, which
    makes it an equality join of ids; texts are fetched for the pairs and verified on the whole title.  Titles without an
    inner word are broadcast, SHORT_TITLES at a time.
    """
    split = r"[^\p{L}\p{N}]+"
    listed = titles.filter(~blank(F.col(title))).select(title_id, F.col(title).alias("__title"))
    inner = F.regexp_replace(F.regexp_replace("__title", r"^[\p{L}\p{N}]+", ""), r"[\p{L}\p{N}]+$", "")
    longest = F.array_max(F.transform(F.filter(F.split(inner, split), lambda w: w != ""), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = listed.withColumn("__w", longest)
    short = keyed.filter("__w is null").drop("__w")
    n_short = short.count()
    if n_short > SHORT_TITLES:
        short = materialise(numbered(short, [F.col("__title"), F.col(title_id)], "__n"))
        blocks = [short.filter((F.col("__n") >= at) & (F.col("__n") < at + SHORT_TITLES)).drop("__n") for at in range(0, n_short, SHORT_TITLES)]
    else:
        blocks = [short]
    own = items.select(item_id, F.col(text).alias("__text")).filter("__text is not null")
    words = own.select(item_id, F.explode(F.array_distinct(F.split("__text", split))).alias("__w"))
    pairs = words.join(keyed.filter("__w is not null"), "__w").select(item_id, title_id, "__title").distinct()
    found = pairs.join(own, item_id).filter(F.contains("__text", F.col("__title"))).select(item_id, title_id)
    for few in blocks:
        found = found.unionByName(own.join(F.broadcast(few), F.contains("__text", F.col("__title"))).select(item_id, title_id))
    return found.distinct()


def keep_last_lookup(items: DataFrame, lookup: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """Left join with the last row of each key of the lookup."""
    last = lookup.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*[c.desc() for c in order]))).filter("__n = 1")
    return items.join(last.select(key, *columns), key, "left")

"""Look-ups of citations, titles and authors in tables of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import blank, filled, title_key
from paperloom.operators.dedup import keep_first


def by_ids(records: DataFrame, wanted: DataFrame, doi: str) -> DataFrame:
    """(doi, abstract, cites, max_h, year) of the wanted ids, without case and once each.

    records: the id, abstract, cites, hs (array of the authors' h-indexes), year.
    """
    keys = wanted.filter(~blank(F.col(doi))).select(F.lower(doi).alias("doi")).distinct()
    found = records.select(F.lower(doi).alias("doi"), "abstract", "cites", F.array_max("hs").alias("max_h"), "year")
    return keep_first(found.join(keys, "doi", "left_semi"), ["doi"], [F.desc_nulls_last("cites"), F.col("year")])


def fill_citations(items: DataFrame, found: DataFrame, doi: str, cites: str, year: str, h: str) -> DataFrame:
    """Citations and year of items that lack citations or an h-index, from another table; nothing else changes."""
    right = keep_first(found.select(F.lower(doi).alias("__doi"), F.col(cites).alias("__cites"), F.col(year).alias("__year")), ["__doi"], [F.desc_nulls_last("__cites")])
    lacks = F.col(cites).isNull() | F.col(h).isNull()
    joined = items.join(right, (F.lower(doi) == F.col("__doi")) & lacks, "left")
    return joined.withColumns({cites: F.coalesce(cites, "__cites"), year: F.coalesce(year, "__year")}).drop("__doi", "__cites", "__year")


def update_citations(items: DataFrame, found: DataFrame, doi: Column, cites: str) -> DataFrame:
    """Citations by an id that is made of the item's own number; what is found replaces what is there."""
    right = found.groupBy(F.lower("doi").alias("__doi")).agg(F.max("cites").alias("__cites"))
    return items.withColumn("__key", F.lower(doi)).join(right, F.col("__key") == F.col("__doi"), "left").withColumn(cites, F.coalesce("__cites", cites)).drop("__key", "__doi", "__cites")


def by_title(wanted: DataFrame, hits: DataFrame, key: str, years: int = 3) -> DataFrame:
    """For each wanted title (key, title, year) its first hit (key, title, year, pos, id) that is the same or holds it (of
    more than 25 characters), or the other way round, in a year at most `years` off."""
    j = wanted.select(key, title_key(F.col("title")).alias("a"), F.col("year").alias("wanted_year")).join(hits.withColumn("b", title_key(F.col("title"))), key)
    alike = (F.col("a") != "") & ((F.col("a") == F.col("b")) | ((F.length("a") > 25) & F.contains("b", F.col("a"))) | ((F.length("b") > 25) & F.contains("a", F.col("b"))))
    near = F.coalesce(F.abs(F.col("year") - F.col("wanted_year")) <= years, F.lit(True))
    return keep_first(j.filter(alike & near), [key], [F.col("pos")]).select(key, "id", "title", "year")


def first_named(hits: DataFrame, query: str, name: str, order: str) -> DataFrame:
    """The first hit of each query whose name contains it, without case."""
    return keep_first(hits.filter(F.contains(F.lower(name), F.lower(query))), [query], [F.col(order)])


def title_to_id(hits: DataFrame, title: str, link: str, order: str, least: int = 15) -> DataFrame:
    """The top hit of each title of `least` characters or more, one with a PDF link before all others."""
    return keep_first(hits.filter(F.length(title) >= least), [title], [F.col(link).isNull(), F.col(order)])


def authors_of(wanted: DataFrame, works: DataFrame, surname: str) -> DataFrame:
    """(surname, author_id, name): for each surname the first authorship of its works (surname, pos, authors: array of
    author_id and name) whose name contains it."""
    people = works.join(wanted.select(surname).distinct(), surname).select(surname, "pos", F.posexplode("authors").alias("place", "a"))
    ok = people.filter(F.contains(F.lower("a.name"), F.lower(surname)))
    return keep_first(ok, [surname], [F.col("pos"), F.col("place")]).select(surname, "a.author_id", "a.name")


def long_abstracts(items: DataFrame, abstract: str, least: int = 60) -> DataFrame:
    """Items whose abstract has `least` words or more."""
    return items.filter(F.size(F.filter(F.split(filled(F.col(abstract)), r"\s+"), lambda w: w != "")) >= least)

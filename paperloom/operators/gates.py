"""Predicates that decide what is shown, scored, fetched or promoted.  All take `as_of` where today matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import blank, filled, person_key, surnames, title_key

LOOKBACK_DAYS, RECENT_DAYS, SHORTLIST = 30, 7, 250


def since(date: Column, as_of: Column, days: int = LOOKBACK_DAYS) -> Column:
    return F.try_to_date(F.substring(filled(date), 1, 10)) >= F.date_sub(as_of, days)


def same_paper(title_a: Column, title_b: Column, year_a: Column, year_b: Column, authors_a: Column, authors_b: Column) -> Column:
    """Titles equal or one long one contained in the other; then years at most six apart or a shared surname.

    Without a year on either side the title decides.
    """
    a, b = title_key(title_a), title_key(title_b)
    alike = (a != "") & ((a == b) | ((F.length(a) > 25) & F.contains(b, a)) | ((F.length(b) > 25) & F.contains(a, b)))
    shared = F.arrays_overlap(surnames(authors_a), surnames(authors_b))
    return alike & (year_a.isNull() | year_b.isNull() | (F.abs(year_a - year_b) <= 6) | F.coalesce(shared, F.lit(False)))


def author_fits(given: Column, family: Column, key: Column) -> Column:
    """Same surname, and the same first name or an initial on either side."""
    k = person_key(F.concat_ws(" ", given, family))
    first, wanted = k["first"], key["first"]
    initial = (F.length(first) == 1) | (F.length(wanted) == 1)
    return (k["last"] == key["last"]) & ((first == wanted) | (initial & (F.substring(first, 1, 1) == F.substring(wanted, 1, 1))))


def research(section: Column) -> Column:
    """Everything but the practitioners' section, whether stored as number or text."""
    return F.coalesce(section.cast("string"), F.lit("")) != "4"


def keep_for_digest(df: DataFrame, watched: str, category: str, score: str, least: int = 20) -> DataFrame:
    """If any row has a score: watched rows that aren't off topic and others from `least` on; else all rows."""
    graded = df.agg(F.coalesce(F.bool_or(F.col(score).isNotNull()), F.lit(False)).alias("__graded"))
    good = F.when(F.coalesce(F.col(watched), F.lit(False)), F.coalesce(F.col(category) != "off_topic", F.lit(True))).otherwise(F.coalesce(F.col(score) >= least, F.lit(False)))
    return df.crossJoin(F.broadcast(graded)).filter(~F.col("__graded") | good).drop("__graded")  # one row is broadcast


def shortlist(df: DataFrame, relevance: str, contribution: str, tie: str, n: int = SHORTLIST) -> DataFrame:
    """What all scorers vote on: graded 2 or more on both axes, the best first."""
    ok = df.filter((F.col(relevance) >= 2) & (F.col(contribution) >= 2))
    return ok.orderBy(F.desc(relevance), F.desc(contribution), tie).limit(n)


def seminal(df: DataFrame, listed: DataFrame, url: str, title: str) -> DataFrame:
    """New classics: contribution 3 that is not provisional, composite from 80, neither link nor title listed yet."""
    ok = df.filter((F.col("contribution") >= 3) & ~F.coalesce(F.col("provisional"), F.lit(True)) & (F.col("composite") >= 80))
    for c in (url, title):
        known = listed.filter(~blank(F.col(c))).select(F.lower(c).alias("__k")).distinct()
        ok = ok.join(known, F.lower(c) == F.col("__k"), "left_anti")
    return ok


def potential_classic(cites: Column, cites_per_year: Column) -> Column:
    return (F.coalesce(cites_per_year, F.lit(0)) >= 15) | (F.coalesce(cites, F.lit(0)) >= 400)


def recent_lanes(df: DataFrame, seen: str, url: str, score: str, contribution: str, provisional: str, watched: str, category: str, n: int = 20) -> DataFrame:
    """Two lanes over the last week before the newest `seen`: strict (best n), then watched authors' core papers; links once."""
    newest = df.agg(F.max(seen).alias("__max"))
    week = df.crossJoin(F.broadcast(newest)).filter(F.to_date(seen) >= F.date_sub(F.to_date("__max"), RECENT_DAYS - 1)).drop("__max")  # one row is broadcast
    strict = week.filter((F.col(score) >= 75) & (F.col(contribution) == 3) & ~F.coalesce(F.col(provisional), F.lit(True))).orderBy(F.desc(score), url).limit(n).withColumn("lane", F.lit(0))
    trusted = week.filter(F.coalesce(F.col(watched), F.lit(False)) & (F.col(category) == "core_fit")).withColumn("lane", F.lit(1))
    w = Window.partitionBy(url).orderBy("lane", F.desc_nulls_last(score))
    return strict.unionByName(trusted).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def backlog(df: DataFrame, title_is_junk: Column, relevance: str, tags: str, tie: str) -> DataFrame:
    """What still has to be scored: no grade or no tags, ungraded first."""
    return df.filter(~title_is_junk & (F.col(relevance).isNull() | F.coalesce(F.size(tags) == 0, F.lit(True)))).orderBy(F.col(relevance).isNotNull(), tie)


def known_id(c: Column) -> Column:
    """Identifiers that may be fetched on demand."""
    return filled(c).rlike(r"^(doi:10\.\d{4,9}/\S+|arxiv:\d{4}\.\d{4,5}(v\d+)?)$")


def priority(rank_score: Column, novelty: Column, reputation: Column, watched: Column, curated: Column, availability: Column) -> Column:
    """Order of full-text fetching: quality, watched authors, curated lists, and how likely a free copy is."""
    z = lambda c, d=0.0: F.coalesce(c, F.lit(d))
    bonus = F.when(curated == "canon", 4.5).when(curated == "cited", 3.0).otherwise(0.0)
    likely = F.when(availability == "preprint", 1.0).when(availability == "working paper", 0.9).when(availability == "open", 0.35).otherwise(0.2)
    return (z(rank_score) / 100 + z(novelty)) * z(reputation, 1.0) + F.when(z(watched, False), 0.25).otherwise(0.0) + bonus + 1.5 * likely


def candidate_rank(h: Column, affiliation: Column, hint: Column) -> Column:
    """An author candidate's rank: h-index and two for each longer word of the hint in the affiliation."""
    words = F.filter(F.split(F.lower(filled(hint)), r"\s+"), lambda w: F.length(w) > 3)
    return F.coalesce(h, F.lit(0)) + 2 * F.size(F.filter(words, lambda w: F.contains(F.lower(filled(affiliation)), w)))

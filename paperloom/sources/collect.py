"""Collecting items from the readers: tiers, sweeps, slices of the roster, months, unions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.dates import month_bounds
from paperloom.functions.text import blank, contains_any, filled, person_key
from paperloom.operators.dedup import collect, keep_first
from paperloom.operators.gates import author_fits
from paperloom.operators.rank import top_per_group
from paperloom.session import materialise

from .lookup import first_named


def tiered(items: DataFrame, journals: DataFrame, source: str, label: str, tier: str, date: str, n: int = 100) -> DataFrame:
    """The newest n items of each journal of the dimension, with its tier."""
    order = [F.desc_nulls_last(date), F.col("title"), F.col("url")]
    first = top_per_group(items, [source], order, n).drop("rank")  # so that a journal's items don't all meet in the join
    named = first.join(journals.select(F.col(label).alias(source), F.col(tier).alias("tier")), source)
    return top_per_group(named, [source], order, n).drop("rank")


def needs_abstract(items: DataFrame, archive: DataFrame, key: str, abstract: str) -> DataFrame:
    """Items worth a costly look-up: not archived and without an abstract."""
    return items.join(archive.select(key), key, "left_anti").filter(blank(F.col(abstract)))


def practitioner(items: DataFrame, journals: DataFrame, archive: DataFrame, uid: str, pages: Callable[[DataFrame], DataFrame], n: int = 30) -> DataFrame:
    """The newest n items of each journal of the dimension (label), all of tier T2, with abstracts from their pages.

    `pages` maps the items whose DOI the archive's keys (`doi:` and the DOI) lack to (url, abstract), so that pages of
    archived items aren't fetched again; what it has nothing for gets an empty abstract, items that it isn't asked for
    stay as they are.  Items without a DOI are never looked up.  Of several abstracts of one page the longest counts.
    """
    listed = tiered(items, journals.select("label", F.lit("T2").alias("tier")), "source", "label", "tier", "date", n)
    keyed = listed.withColumn("__uid", F.when(~blank(F.col("doi")), F.concat(F.lit("doi:"), F.lower("doi"))))
    held = archive.select(F.col(uid).alias("__uid"), F.lit(True).alias("__held")).filter("__uid is not null").distinct()
    marked = materialise(keyed.join(held, "__uid", "left").withColumn("__new", F.col("__uid").isNotNull() & F.col("__held").isNull()).drop("__held"))
    found = pages(marked.filter("__new").select(*items.columns)).groupBy(F.col("url").alias("__url")).agg(F.max_by("abstract", F.struct(F.length("abstract"), F.col("abstract"))).alias("__abstract"))
    joined = marked.join(found, F.col("__new") & (F.col("url") == F.col("__url")), "left")
    return joined.withColumn("abstract", F.when(F.col("__new"), filled(F.col("__abstract"))).otherwise(F.col("abstract"))).drop("__uid", "__new", "__url", "__abstract")


def repositories(works: DataFrame, wanted: DataFrame, hits: DataFrame, n: int = 100) -> DataFrame:
    """The newest n works of each repository, whose source says where they come from.

    wanted: (label, id); those without an id get that of the first hit (label, place, name, id) whose name holds the
    label, without case, and are skipped if there is none.  works: repository, date, title, url and others.
    """
    found = first_named(hits.select(F.col("label").alias("__label"), "place", "name", F.element_at(F.split("id", "/"), -1).alias("__found")), "__label", "name", "place").select("__label", "__found")
    known = wanted.join(found, F.col("label") == F.col("__label"), "left").select("label", F.coalesce(F.nullif("id", F.lit("")), "__found").alias("repository")).filter("repository is not null").distinct()
    order = [F.desc_nulls_last("date"), F.col("title"), F.col("url")]
    # a label's newest are among its repositories' newest, so a repository's works don't all meet in the join
    first = top_per_group(works.drop("source"), ["repository"], order, n).drop("rank")
    own = first.join(known, "repository").withColumn("source", F.concat("label", F.lit(" (via OpenAlex)")))
    return top_per_group(own, ["source"], order, n).drop("rank", "label")


def resolve_topics(hits: DataFrame, term: str, score: str, field: str, wanted: str, least: int = 3000) -> tuple[DataFrame, DataFrame]:
    """(terms with a topic, terms to search as text): a term's best hit has to be of the field and score enough."""
    best = top_per_group(hits, [term], [F.desc_nulls_last(score), F.col("id")], 1).drop("rank")
    ok = F.coalesce((F.col(field) == wanted) & (F.col(score) >= least), F.lit(False))
    return best.filter(ok), best.filter(~ok).select(term)


def topic_sweep(works: DataFrame, topics: DataFrame, terms: list[str], text: Column, topic: str, date: str, n: int = 25) -> DataFrame:
    """Works of resolved topics, then for every other term the newest n that contain it."""
    by_topic = works.join(topics.select(topic).distinct(), topic, "left_semi").withColumn("term", F.lit(None).cast("string"))
    low = F.lower(filled(text))
    found = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t)) if terms else F.array().cast("array<string>")
    by_term = top_per_group(works.withColumn("term", F.explode(found)), ["term"], [F.desc_nulls_last(date), F.col("uid")], n).drop("rank")
    return by_topic.unionByName(by_term.select(*by_topic.columns))


def author_pull(works: DataFrame, roster_slice: DataFrame, author_id: str, name: str, date: str, n: int = 8) -> DataFrame:
    """The newest n works of every author in the slice, marked as watched."""
    own = works.join(roster_slice.select(author_id, F.col(name).alias("watchlist_author")), author_id)
    return top_per_group(own, [author_id], [F.desc_nulls_last(date), F.col("uid")], n).drop("rank").withColumn("watchlist", F.lit(True))


def author_search(works: DataFrame, wanted: str, text: Column, terms: list[str]) -> DataFrame:
    """Works (authors: array of given and family) of which some author fits the wanted name, on the field's terms."""
    key = person_key(F.lit(wanted))
    return works.filter(F.exists("authors", lambda a: author_fits(a["given"], a["family"], key)) & contains_any(text, terms))


def month_candidates(journals: DataFrame, preprints: DataFrame, month: str, date: str, n: int = 100) -> DataFrame:
    """A month's journal papers with title and DOI, the n most cited of each, and its preprints."""
    b = month_bounds(F.lit(month))
    inside = lambda df: df.filter(F.to_date(F.col(date)).between(b["first"], b["last"]))
    own = inside(journals).filter(~blank(F.col("title")) & ~blank(F.col("doi")))
    top = top_per_group(own, ["source"], [F.desc_nulls_last("cites"), F.col("doi")], n).drop("rank")
    return collect([top, inside(preprints)])


def outside(results: list[DataFrame], key: str, tie: str) -> DataFrame:
    """Results of several searches, each paper once without case, the first search winning."""
    both = collect(results).withColumn("__k", F.lower(key))
    return keep_first(both, ["__k"], [F.col("load_order"), F.col(tie)]).drop("__k")


def tei(spark: SparkSession, path: str, key: Column) -> DataFrame:
    """(key, section, place, text) paragraphs of TEI documents, ready for passages.fold."""
    schema = "head string, p array<string>"
    divs = spark.read.format("xml").option("rowTag", "div").schema(schema).load(path).select(key.alias("key"), F.coalesce("head", F.lit("")).alias("section"), F.posexplode("p").alias("place", "text"))
    return divs.filter(~blank(F.col("text")))

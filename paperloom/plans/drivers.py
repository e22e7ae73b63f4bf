"""Whole runs, composed of operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import dates, text
from paperloom.operators import dedup, enrich, gates, passages, rank, retrieval, scoring


def digest(items: DataFrame, archive: DataFrame, citations: DataFrame, roster: DataFrame, impact: DataFrame, verdicts: DataFrame, as_of: Column) -> DataFrame:
    """From collected items to ranked ones: new, enriched, graded, scored.

    items: uid, title, authors, abstract, date, source, load_order; citations: uid, abstract, cites, author_h; roster: name,
    pos, h_index, member; impact: label, value; verdicts: uid, topic, levels, flags and categories.
    """
    new = dedup.filter_new(items, archive, "uid", "source", "load_order")
    filled = enrich.fill_only(new.withColumns({"cites": F.lit(None).cast("int"), "author_h": F.lit(None).cast("int")}), citations, "uid", ["abstract"], ["cites", "author_h"])
    met = enrich.roster_match(filled, "uid", "authors", roster, "name", "pos").select("uid", F.col("h_index").alias("roster_h"), "member")
    scaled = enrich.percentile_of_max(filled.withColumn("label", text.venue_label(F.lit(None).cast("string"), F.col("source"))), "label", impact, "value", "impact_percentile")
    graded = scaled.join(met, "uid", "left").join(verdicts, "uid")
    none = F.lit(None)
    author = scoring.author_score(F.col("author_h"), F.col("roster_h"), F.col("member"), none.cast("int"), none.cast("double"))
    ready = scoring.with_posteriors(graded, "topic", "antecedent_match", "relevance_category").withColumns({"author_score": author, "age": dates.age_years(none.cast("int"), F.col("date"), as_of)})
    return scoring.composite(ready)


def ask(question: str, vectors: DataFrame, query: DataFrame, items: DataFrame, full_texts: DataFrame, recall: int = 200, examined: int = 48, deep: int = 8, kept: int = 10) -> DataFrame:
    """Context for a question: vector recall, blended re-ranking, BM25 over the passages of the best, in order.

    vectors: uid, v; query: q (one row); items: uid, title, summary, strength, reputation; full_texts: uid, passages.
    Passages lead, papers follow; `place` is the order in which sources are numbered.
    """
    terms = [t for t in dict.fromkeys(text_terms(question))]
    once = retrieval.recall(vectors.join(items, "uid"), query, "v", "uid", recall, title="title")
    wanted = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    score = retrieval.blend(F.col("sim"), text.keyword_hits(wanted, F.col("title")), text.keyword_hits(wanted, F.col("summary")), retrieval.quality_prior(F.col("strength"), F.col("reputation")))
    picks = once.withColumn("score", score).orderBy(F.desc("score"), "uid").limit(examined)
    chosen = picks.orderBy(F.desc("score"), "uid").limit(deep).select("uid")
    parts = passages.explode_passages(full_texts.join(chosen, "uid", "left_semi"), "uid", "passages").withColumn("pid", F.concat_ws("#", "uid", F.lpad("place", 6, "0")))
    best = retrieval.bm25(parts, "pid", "text", terms or [""]).orderBy(F.desc("score"), "pid").limit(kept).join(parts, "pid")
    lead = best.select(F.lit(0).alias("block"), "score", "pid", "uid", F.lit("full").alias("depth"), "text")
    rest = picks.join(best.select("uid").distinct(), "uid", "left_anti").select(F.lit(1).alias("block"), "score", F.col("uid").alias("pid"), "uid", F.when(text.blank(F.col("summary")), "title_only").otherwise("summary_only").alias("depth"), F.coalesce("summary", "title").alias("text"))
    return rank.top_per_group(lead.unionByName(rest).withColumn("all", F.lit(0)), ["all"], [F.col("block"), F.desc("score"), F.col("pid")], kept + examined, "place").drop("all")


def text_terms(question: str) -> list[str]:
    """The terms of a question as text.question_terms gives them; the question is the user's own short text."""
    import re

    words = re.sub("[^a-z0-9 ]", " ", question.lower()).split()
    return [w for w in words if len(w) > 2 and w not in text.STOPWORDS]


def classics(works: DataFrame, key: Column, canon: DataFrame, per_journal: int = 50, overall: int = 250) -> dict[str, DataFrame]:
    """Most cited works by journal and overall, and the canon by year."""
    keyed = works.withColumn("key", key)
    once = rank.max_record(keyed, "key", "cites", "load_order")
    return {"journals": rank.top_per_group(works, ["source"], [F.desc_nulls_last("cites"), F.col("load_order")], per_journal),
            "overall": once.orderBy(F.desc_nulls_last("cites"), "key").limit(overall), "canon": canon.orderBy("year", "title")}


def monthly(scored: DataFrame, month: str, n: int = 50) -> DataFrame:
    """The best n of every month by composite score."""
    return rank.top_per_group(scored, [month], [F.desc("composite"), F.col("uid")], n)


def promoted(scored: DataFrame, listed: DataFrame) -> DataFrame:
    return gates.seminal(scored, listed, "url", "title")

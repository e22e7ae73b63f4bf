"""Full texts as passages."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FULL, LEAST = 220, 25


def _words(c):
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def fold(paragraphs: DataFrame, key: str, section: str, order: str, text: str, full: int = FULL, least: int = LEAST) -> DataFrame:
    """(key, section, passage, text, words): paragraphs of a section joined until there are `full` words.

    A passage ends with the paragraph that reaches `full`; a section's rest is kept from `least` words on.  Null texts
    count as absent paragraphs, paragraphs at one place stand by their text.  A section's paragraphs come to one task in
    order, which goes through them once and holds one passage: cuts depend on what came before.
    """
    rows = paragraphs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(section).alias("section"), F.col(order).alias("o"), F.col(text).alias("t"), _words(F.col(text)).alias("n"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("key", "section")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, held, words, out, schema = None, 0, [], 0, [], None

        def end() -> None:
            nonlocal number, held, words
            if held and words >= least:
                out.append((*now, number, " ".join(held), words))
            number, held, words = number + 1, [], 0

        def made() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

        for b in batches:
            schema = schema or pa.schema([pa.field("key", b.schema.field(0).type), pa.field("section", b.schema.field(1).type), pa.field("passage", pa.int32()), pa.field("text", pa.string()), pa.field("words", pa.int64())])
            for k, s, t, n in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if (k, s) != now:
                    end()
                    now, number = (k, s), 0
                held.append(t)
                words += n
                if words >= full:
                    end()
            yield made()
        end()
        if schema:
            yield made()

    sorted_ = rows.repartition("key", "section").sortWithinPartitions("key", "section", "o", "t")
    return sorted_.mapInArrow(run, f"key {kinds[0]}, section {kinds[1]}, passage int, text string, words long").withColumnsRenamed({"key": key, "section": section})


def explode_passages(docs: DataFrame, key: str, passages: str, within: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """(within, key, place, section, text) of picked documents with an array of passages; of texts that begin alike the first
    is kept, in the given order of the documents and else by key.

    Texts are compared among the picks given, or those that agree in `within` (a question), never with other picks.
    """
    rows = docs.select(*within, key, *order, F.posexplode(passages).alias("place", "p")).select(*within, key, *order, "place", F.col("p.s").alias("section"), F.col("p.t").alias("text"))
    some = rows.filter(F.coalesce(F.col("text"), F.lit("")) != "")
    w = Window.partitionBy(*within, F.substring("text", 1, 160)).orderBy(*order, key, "place")
    return some.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks of two titles."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


# Kinds of records that are raised, and that are lowered.
ARTICLES = ("journal-article", "proceedings-article")
BOOKISH = ("reference-entry", "book", "book-chapter", "book-part", "book-section", "monograph", "dataset", "component")

#: Rows, titles wanted and candidates, that a task matches.
MATCHED = 100_000


def _plain(c):
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", ""))


def best_match(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """For each wanted title (key, title, author: a family name, year) the best of its candidates (key, title, authors: an
    array of family names, year, kind, pos).

    Score: similarity of the plain titles, and bonuses for the author and an article, and penalties for book-like kinds and
    for years far off; the first of equals.  It is accepted with the author from 0.6 on, or for a near-equal title of a
    near year.  A year of 0 or null is not known.  Candidates are those a search gave for the key, so no title meets
    titles of other keys.  Both are dealt by key to as many tasks as MATCHED rows each take, as the best are found by sorting.
    """
    n = max(wanted.sparkSession.sparkContext.defaultParallelism, 1 + (wanted.count() + found.count()) // MATCHED)
    joined = wanted.repartition(n, key).alias("w").join(found.repartition(n, key).alias("f"), key).filter(_plain(F.col("f.title")) != "")
    ratio = similarity(_plain(F.col("w.title")), _plain(F.col("f.title")))
    has_author = F.coalesce(F.exists("f.authors", lambda a: F.lower(a) == F.lower(F.col("w.author"))), F.lit(False))
    off = F.when((F.col("f.year") > 0) & (F.col("w.year") > 0), F.abs(F.col("f.year") - F.col("w.year")))
    far = lambda n: F.coalesce(off > n, F.lit(False))
    scored = joined.withColumns({"ratio": ratio, "has_author": has_author, "off7": far(7), "off5": far(5), "off3": far(3)})
    kind = F.when(F.col("f.kind").isin(*ARTICLES), 0.05).when(F.col("f.kind").isin(*BOOKISH), -0.5).otherwise(0.0)
    score = F.col("ratio") + F.when(F.col("has_author"), 0.15).otherwise(0.0) + kind - F.when(F.col("off3"), 0.10).otherwise(0.0)
    ok = scored.filter(F.col("has_author") | ~F.col("off7")).withColumn("score", F.round(score, 9)).filter("score > 0")
    best = ok.groupBy(key).agg(F.max_by(F.struct(F.col("f.title").alias("title"), F.col("f.authors").alias("authors"), F.col("f.year").alias("year"), "ratio", "has_author", "off5", "score"), F.struct("score", -F.col("f.pos"))).alias("b"))
    accepted = (F.col("b.has_author") & (F.col("b.score") >= 0.60)) | ((F.col("b.ratio") >= 0.82) & ~F.col("b.off5"))
    return best.filter(accepted).select(key, "b.title", "b.authors", "b.year", F.round("b.score", 6).alias("score"))


def with_model(items: DataFrame, scorer, schema: str) -> DataFrame:
    """Answers of an external model: `scorer` maps a pandas frame to one of `schema`; the plan needs no more of it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield scorer(batch)

    return items.mapInPandas(run, schema)

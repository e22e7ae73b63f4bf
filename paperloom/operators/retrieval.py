"""Hybrid retrieval: vector recall, blended re-ranking, BM25 over passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import materialise

from .dedup import keep_first

K1, B = 1.5, 0.75


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def quantise(v: Column) -> Column:
    """Unit length times 127, rounded half to even, as bytes; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    scale = F.when(norm == 0, 1.0).otherwise(norm)
    return F.transform(F.arrays_zip(v.alias("v"), F.array_repeat(scale, F.size(v)).alias("s")), lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x["v"].cast("double") / x["s"] * 127))).cast("tinyint"))


def recall(vectors: DataFrame, query: DataFrame, vector: str, key: str, k: int, digits: int = 4, title: str | None = None) -> DataFrame:
    """The k rows nearest to one query vector (column `q`, one row): an exact scan and a distributed top-k.

    With `title`, rows of one title count once, the nearest of them.
    """
    scored = vectors.crossJoin(F.broadcast(query.limit(1))).withColumn("sim", F.round(dot(F.col(vector), F.col("q")), digits))
    scored = scored.drop("q", *([vector] if title else []))
    if title:
        scored = keep_first(scored, [title], [F.desc("sim"), F.col(key)])
    return scored.orderBy(F.desc("sim"), key).limit(k)


def blend(similarity: Column, title_hits: Column, summary_hits: Column, quality: Column) -> Column:
    """Re-ranking score: similarity, keywords and quality."""
    return 0.55 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity)) + 0.30 * (0.6 * title_hits + 0.4 * summary_hits) + 0.15 * quality


def quality_prior(strength: Column, reputation: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.2), F.coalesce(strength / 100, F.lit(0.45)) * F.coalesce(reputation, F.lit(1.0))))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda t: t != "")


def bm25(passages: DataFrame, key: str, text: str, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of passages with one of the terms, scored against the whole candidate set.

    Every passage is tokenised once; counts of the few terms are array expressions, so no token is shuffled.
    """
    want = list(dict.fromkeys(terms))
    base = passages.select(key, tokens(F.col(text)).alias("__t"))
    counted = materialise(base.select(key, F.size("__t").alias("__n"), *[F.size(F.filter("__t", _same(t))).alias(f"__f{i}") for i, t in enumerate(want)]))
    totals = counted.agg(F.count("*").alias("__docs"), F.avg("__n").alias("__avg"), *[F.count_if(F.col(f"__f{i}") > 0).alias(f"__d{i}") for i in range(len(want))])
    joined = counted.crossJoin(F.broadcast(totals))  # one row
    score = F.lit(0.0)
    for i in range(len(want)):
        f, d = F.col(f"__f{i}"), F.col(f"__d{i}")
        idf = F.ln(1 + (F.col("__docs") - d + 0.5) / (d + 0.5))
        score = score + F.when(f > 0, idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("__n") / F.col("__avg")))).otherwise(0.0)
    return joined.select(key, score.alias("score")).filter("score > 0")


def _same(term: str):
    return lambda x: x == term


def known_minus(outside: DataFrame, known: DataFrame, key: str, n: int) -> DataFrame:
    """Outside results that aren't known yet, compared without case, n at most."""
    low = known.select(F.lower(key).alias("__k")).distinct()
    return outside.join(low, F.lower(key) == F.col("__k"), "left_anti").orderBy(key).limit(n)


def history(turns: DataFrame, conversation: str, turn: str, n: int = 6) -> DataFrame:
    """The last n turns of each conversation, numbered from the oldest of them."""
    last = Window.partitionBy(conversation).orderBy(F.desc(turn))
    kept = turns.withColumn("__n", F.row_number().over(last)).filter(F.col("__n") <= n).drop("__n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(conversation).orderBy(turn)))

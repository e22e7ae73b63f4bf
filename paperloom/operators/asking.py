"""Questions to the archive, many at once: recall by vector, re-ranking, screening, passages, and numbered sources.

Each step keeps a bounded number of rows for each question, so nothing but the scan of the vectors grows with the archive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import display, parse, text
from paperloom.session import materialise

from . import passages, retrieval
from .nearest import nearest

# Candidates, papers examined, read in full and opened, passages carried, papers read in full beside
# passages, papers of a screening request, and outside papers shown.
RECALL, EXAMINED, DEEP, OPENED, CARRIED, BESIDE, REQUEST, OUTSIDE = 200, 48, 12, 8, 10, 6, 16, 4


def _numbered(df: DataFrame, by: str, order: list, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def bm25(parts: DataFrame, terms: str, body: str, k1: float = retrieval.K1, b: float = retrieval.B) -> DataFrame:
    """`parts` (qid, an array `terms` of its question, a text) that have a term, with `score` against its question's parts."""
    words = retrieval.tokens(F.col(body))
    hits = F.transform(F.array_distinct(terms), lambda t: F.size(F.filter("__t", lambda w: w == t)))
    counted = materialise(parts.withColumn("__t", words).withColumns({"__n": F.size("__t"), "__f": hits}).drop("__t"))
    totals = counted.groupBy("qid").agg(F.count("*").alias("__docs"), F.avg("__n").alias("__avg"))
    some = counted.select("qid", F.posexplode("__f").alias("__i", "__x")).groupBy("qid", "__i").agg(F.count_if(F.col("__x") > 0).alias("__d"))
    by_term = some.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__d"))), lambda x: x["__d"]).alias("__d"))
    joined = counted.join(totals, "qid").join(by_term, "qid")

    def part(f: Column, i: Column) -> Column:
        d = F.get("__d", i)
        idf = F.ln(1 + (F.col("__docs") - d + 0.5) / (d + 0.5))
        return F.when(f > 0, idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("__n") / F.col("__avg")))).otherwise(F.lit(0.0))

    score = F.aggregate(F.transform("__f", part), F.lit(0.0), lambda s, x: s + x)
    return joined.withColumn("score", F.round(score, 9)).filter("score > 0").drop("__n", "__f", "__d", "__docs", "__avg")


def best_sentence(body: Column, terms: Column, least: int = 2) -> Column:
    """The sentence with the most different terms, of equals the first; null if none has `least` (or all, if there are fewer)."""
    told = F.transform(F.split(text.filled(body), r"\. "), lambda s, n: F.struct(F.size(F.filter(terms, lambda t: F.contains(F.lower(s), t))).alias("k"), (-n).alias("n"), s.alias("s")))
    best = F.array_max(told)
    return F.when((best["k"] >= F.least(F.lit(least), F.size(terms))) & (best["k"] > 0), F.trim(best["s"]))


def extracts(requests: DataFrame) -> DataFrame:
    """Replies (qid, request, reply) to screening requests without a model: each paper's best sentence, if it has one."""
    found = F.transform("papers", lambda p: F.struct(p["i"].alias("p"), best_sentence(p["text"], F.col("terms")).alias("f")))
    return requests.select("qid", "request", F.to_json(F.filter(found, lambda x: x["f"].isNotNull())).alias("reply"))


def screened(rest: DataFrame, screen: Callable[[DataFrame], DataFrame], size: int = REQUEST) -> DataFrame:
    """(qid, at, finding) of papers (qid, question, terms, at, title, abstract) in which a model finds something.

    Requests (qid, request, question, terms, papers: array of i, title, text) hold `size` papers of one question, in order;
    i is the paper's place.  A reply (qid, request, reply) is prose with an array of findings.  Findings for papers that
    the request doesn't hold are left out, of several for one the last counts, and a lost reply loses its papers alone.
    """
    placed = _numbered(rest.filter(~text.blank(F.col("abstract"))), "qid", [F.col("at")], "__n").withColumn("request", F.floor((F.col("__n") - 1) / size))
    paper = F.struct(F.col("at").alias("i"), "title", F.substring(text.squeeze(F.col("abstract")), 1, 1500).alias("text"))
    asked = materialise(placed.groupBy("qid", "request").agg(F.first("question").alias("question"), F.first("terms").alias("terms"), F.array_sort(F.collect_list(paper)).alias("papers")))
    replies = screen(asked).select("qid", "request", F.posexplode(parse.findings(F.col("reply"))).alias("place", "x"))
    inside = replies.join(asked.select("qid", "request", F.transform("papers", lambda p: p["i"]).alias("held")), ["qid", "request"]).filter(F.array_contains("held", F.col("x.p")))
    return inside.groupBy("qid", F.col("x.p").alias("at")).agg(F.max_by("x.f", "place").alias("finding"))


def sources(questions: DataFrame, vectors: DataFrame, items: DataFrame, full_texts: DataFrame, outside: DataFrame, screen: Callable[[DataFrame], DataFrame] = extracts) -> DataFrame:
    """(qid, place, block, uid, title, section, depth, body): the sources that an answer to each question may cite as [place].

    questions: qid (long), question, v; vectors: uid (long), v; items: uid, title, summary, abstract, strength, reputation; full_texts:
    uid, passages (array of s, t); outside: qid, pos, key, title, abstract, known by items' `key`.  Passages lead: the best
    by BM25 of the first OPENED examined papers with a full text; then the best papers (DEEP, or BESIDE next to passages),
    then what screening finds in the rest of those examined, then outside papers that the archive doesn't hold.  Papers of
    one title count once, questions without terms get no passages.
    """
    terms = questions.select("qid", "question", text.question_terms(F.col("question")).alias("terms"))
    # few rows for each question from here on
    near = nearest(vectors.join(items.select("uid", F.lower(F.trim("title")).alias("kin")), "uid"), questions.select(F.col("qid").alias("uid"), "v"), "uid", "v", RECALL, kin="kin", others=False).withColumnRenamed("query", "qid")
    joined = near.join(items.select("uid", "title", "summary", "strength", "reputation"), "uid").join(terms, "qid")
    score = retrieval.blend(F.col("sim"), text.keyword_hits(F.col("terms"), F.col("title")), text.keyword_hits(F.col("terms"), F.col("summary")), retrieval.quality_prior(F.col("strength"), F.col("reputation")))
    # numbers alone are ordered; texts come to the papers examined, and full texts to those opened
    seen = _numbered(joined.select("qid", "uid", F.round(score, 9).alias("score")), "qid", [F.desc("score"), F.col("uid")], "at").filter(F.col("at") <= EXAMINED)
    seen = materialise(seen.select("qid", "uid", "at").join(items.select("uid", "title", "summary", "abstract"), "uid").join(terms, "qid"))
    whole = seen.select("qid", "uid", "at").join(full_texts.select("uid"), "uid", "left_semi")
    opened = _numbered(whole, "qid", [F.col("at")], "__n").filter(F.col("__n") <= OPENED).join(full_texts, "uid")
    parts = passages.explode_passages(opened, "uid", "passages", ("qid",), ("at",)).join(terms, "qid")
    best = materialise(_numbered(bm25(parts, "terms", "text"), "qid", [F.desc("score"), F.col("at"), F.col("place")], "n").filter(F.col("n") <= CARRIED).select("qid", "n", "uid", "section", "text", "at"))
    lead = best.join(seen.select("qid", "at", "title"), ["qid", "at"]).select("qid", F.lit(0).alias("block"), "n", "uid", "title", "section", F.lit("full").alias("depth"), F.col("text").alias("body"))
    many = best.select("qid").distinct().withColumn("__passages", F.lit(True))
    abstract = F.nullif(F.trim(text.filled(F.col("abstract"))), F.lit(""))
    deep = seen.filter(F.col("at") <= DEEP).join(many, "qid", "left").filter(F.col("at") <= F.when(F.col("__passages"), BESIDE).otherwise(DEEP))
    none = F.lit(None).cast("string")
    read = deep.select("qid", F.lit(1).alias("block"), F.col("at").alias("n"), "uid", "title", none.alias("section"), F.when(abstract.isNotNull(), "abstract").otherwise("summary_only").alias("depth"), F.coalesce(abstract, text.filled(F.col("summary"))).alias("body"))
    rest = seen.filter(F.col("at") > DEEP)
    found = screened(rest, screen).join(rest, ["qid", "at"]).select("qid", F.lit(2).alias("block"), F.col("at").alias("n"), "uid", "title", none.alias("section"), F.lit("abstract").alias("depth"), F.col("finding").alias("body"))
    new = outside.join(items.select(F.lower("key").alias("__k")).distinct(), F.lower("key") == F.col("__k"), "left_anti")
    beyond = _numbered(new, "qid", [F.col("pos")], "n").filter(F.col("n") <= OUTSIDE).select("qid", F.lit(3).alias("block"), "n", F.lit(None).cast("long").alias("uid"), "title", none.alias("section"), F.lit("abstract").alias("depth"), text.filled(F.col("abstract")).alias("body"))
    every = lead.unionByName(read).unionByName(found).unionByName(beyond)
    return _numbered(every, "qid", [F.col("block"), F.col("n")], "place").drop("n")


def contexts(questions: DataFrame, cited: DataFrame) -> DataFrame:
    """(qid, question, n_sources, context) with the sources' numbered lines in order."""
    named = F.concat_ws(" — ", "title", F.nullif(text.filled(F.col("section")), F.lit("")))
    line = display.context_line(F.col("place"), named, F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("depth"), F.col("body"))
    joined = cited.groupBy("qid").agg(F.count("*").alias("n_sources"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("context"))
    return questions.select("qid", "question").join(joined, "qid", "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))


def quoting(cited: DataFrame, questions: DataFrame, most: int = 3) -> DataFrame:
    """(qid, answer) without a model: the best sentences of the first `most` sources that have one, each with its number."""
    terms = questions.select("qid", text.question_terms(F.col("question")).alias("terms"))
    told = cited.join(terms, "qid").withColumn("s", best_sentence(F.col("body"), F.col("terms"), 1)).filter("s is not null")
    first = _numbered(told, "qid", [F.col("place")], "__n").filter(F.col("__n") <= most)
    sentence = F.concat(F.rtrim(F.col("s"), F.lit(".")), F.lit(" ["), F.col("place").cast("string"), F.lit("]."))
    return first.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", sentence.alias("t")))), lambda x: x["t"]), " ").alias("answer"))


def checked(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """`answers` (qid, answer) with the numbers that they cite: `cited` those of a source, `loose` others."""
    held = cited.groupBy("qid").agg(F.max("place").alias("__most"))
    numbers = display.cited_numbers(F.col("answer"))
    known = lambda n: (n >= 1) & (n <= F.coalesce("__most", F.lit(0)))
    return answers.join(held, "qid", "left").withColumn("cited", F.filter(numbers, known)).withColumn("loose", F.filter(numbers, lambda n: ~known(n))).drop("__most")

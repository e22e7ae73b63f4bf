"""Queries that answer many questions at once: every fiftieth vector asks."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import asking

from .drivers import text_terms
from .items import read

#: Questions in turn; the last has no terms.
ASKED = ["Does thtion follow from the eren?", "Which ertion and keit is it?", "What of thnd, ontion and thed?", "How is that?"]


def _given(spark, sf_dir):
    """Documents that have a vector as papers: first line, second line, and all lines as passages of every third."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"), F.col("embedding").alias("v"))
    k, lines = F.col("uid"), F.split("text", "\n")
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "text", "source")
    held = lambda df: df.join(v.select("uid"), "uid", "left_semi")  # noqa: E731  after the columns are made, so that whole texts aren't shuffled
    items = held(d.select("uid", F.get(lines, F.lit(0)).alias("title"), F.col("source").alias("summary"), F.when(k % 4 != 3, F.get(lines, F.lit(1))).alias("abstract"), F.when(k % 6 != 0, k % 100).alias("strength"), F.when(k % 5 == 0, 1.1).alias("reputation"), F.concat(F.lit("doi:"), k.cast("string")).alias("key")))
    full = held(d.filter("uid % 3 = 0").select("uid", F.transform(lines, lambda t, n: F.struct(F.concat(F.lit("s"), (n % 3).cast("string")).alias("s"), t.alias("t"))).alias("passages")))
    turn = F.floor(F.col("uid") / 50) % len(ASKED)
    questions = v.filter("uid % 50 = 0").select(F.col("uid").alias("qid"), F.get(F.array(*map(F.lit, ASKED)), turn).alias("question"), "v")
    outside = questions.select("qid", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("pos")).select("qid", "pos", F.concat(F.lit("DOI:"), (F.col("qid") + F.col("pos") * 37).cast("string")).alias("key"), F.concat(F.lit("outside "), F.col("pos").cast("string")).alias("title"), F.when(F.col("pos") % 2 == 0, "seen elsewhere").alias("abstract"))
    return questions, v, items, full, outside


def two_stage(spark, sf_dir):
    return asking.sources(*_given(spark, sf_dir)).select("qid", F.col("place").cast("long").alias("place"), "block", "uid", "title", "section", "depth", "body")


_TERMS = "CASE vec_id // 50 % {} {} END".format(len(ASKED), " ".join(f"WHEN {i} THEN {text_terms(q)!r}::VARCHAR[]" for i, q in enumerate(ASKED)))
_HITS = "CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda t: contains(lower({}), t)))::DOUBLE / len(terms) ELSE 0 END"


def _sentence(body: str, least: int) -> str:
    """The best sentence as a struct of k, n and s."""
    return f"list_max(list_transform(string_split({body}, '. '), lambda s, n: {{'k': len(list_filter(terms, lambda t: contains(lower(s), t))), 'n': -n, 's': trim(s), 'least': least({least}, len(terms))}}))"


_WITH = f"""WITH d AS (SELECT doc_id AS uid, string_split(text, chr(10)) AS l, source FROM documents SEMI JOIN embeddings ON vec_id = doc_id),
    i AS (SELECT uid, l[1] AS title, source AS summary, CASE WHEN uid % 4 <> 3 THEN l[2] END AS abstract, CASE WHEN uid % 6 <> 0 THEN uid % 100 END AS strength, CASE WHEN uid % 5 = 0 THEN 1.1::DOUBLE END AS reputation FROM d),
    q AS (SELECT vec_id AS qid, embedding AS v, {_TERMS} AS terms FROM embeddings WHERE vec_id % 50 = 0),
    n AS (SELECT qid, i.*, terms, round(list_dot_product(q.v::DOUBLE[], e.embedding::DOUBLE[]), 4) AS sim FROM q CROSS JOIN embeddings e JOIN i ON e.vec_id = uid),
    k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY qid, lower(trim(title)) ORDER BY sim DESC, uid) = 1),
    r AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sim DESC, uid) <= 200),
    s AS (SELECT *, round(0.55::DOUBLE * greatest(0, least(1, sim)) + 0.3::DOUBLE * (0.6::DOUBLE * ({_HITS.format('title')}) + 0.4::DOUBLE * ({_HITS.format('summary')})) + 0.15::DOUBLE * greatest(0, least(1.2::DOUBLE, coalesce(strength / 100, 0.45::DOUBLE) * coalesce(reputation, 1))), 9) AS score FROM r),
    a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, uid) AS pl FROM s QUALIFY pl <= 48),
    o AS (SELECT qid, terms, pl, uid FROM a WHERE uid % 3 = 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pl) <= 8),
    p AS (SELECT qid, terms, pl, uid, g - 1 AS place, l[g] AS t FROM (SELECT o.*, l, unnest(range(1, len(l) + 1)) AS g FROM o JOIN d USING (uid)) WHERE l[g] <> '' QUALIFY row_number() OVER (PARTITION BY qid, substring(l[g], 1, 160) ORDER BY pl, uid, g) = 1),
    w AS MATERIALIZED (SELECT *, list_filter(string_split(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM p),
    st AS (SELECT qid, count(*) AS docs, avg(len(w)) AS mean FROM w GROUP BY qid),
    f AS (SELECT qid, pl, place, term, len(w) AS n, len(list_filter(w, lambda x: x = term)) AS f FROM (SELECT *, unnest(terms) AS term FROM w)),
    df AS (SELECT qid, term, count(*) FILTER (WHERE f > 0) AS df FROM f GROUP BY qid, term),
    b AS (SELECT qid, pl, place, round(sum(CASE WHEN f > 0 THEN ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) ELSE 0 END), 9) AS score FROM f JOIN st USING (qid) JOIN df USING (qid, term) GROUP BY qid, pl, place),
    best AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pl, place) AS m FROM b WHERE score > 0 QUALIFY m <= 10),
    x AS (SELECT a.*, {_sentence("substring(trim(regexp_replace(abstract, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 1, 1500)", 2)} AS y FROM a WHERE pl > 12 AND trim(coalesce(abstract, '')) <> ''),
    z AS (SELECT qid, 0 AS block, m, a.uid, title, 's' || (place % 3) AS section, 'full' AS depth, t AS body FROM best JOIN a USING (qid, pl) JOIN p USING (qid, pl, place)
          UNION ALL SELECT qid, 1, pl, uid, title, NULL, CASE WHEN trim(coalesce(abstract, '')) <> '' THEN 'abstract' ELSE 'summary_only' END, coalesce(nullif(trim(coalesce(abstract, '')), ''), summary) FROM a WHERE pl <= CASE WHEN qid IN (SELECT qid FROM best) THEN 6 ELSE 12 END
          UNION ALL SELECT qid, 2, pl, uid, title, NULL, 'abstract', y.s FROM x WHERE y.k >= y.least AND y.k > 0
          UNION ALL SELECT * FROM (SELECT qid, 3, g AS pl, NULL, 'outside ' || g, NULL, 'abstract', CASE WHEN g % 2 = 0 THEN 'seen elsewhere' ELSE '' END FROM q, range(1, 8) AS t(g) WHERE qid + g * 37 NOT IN (SELECT uid FROM i) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY g) <= 4)),
    cited AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY block, m) AS place, block, uid, title, section, depth, body FROM z)"""
TWO_STAGE = _WITH + " SELECT * FROM cited"


def answers(spark, sf_dir):
    """Answers that quote their sources, with the numbers they cite, and what a model would be sent."""
    questions, *given = _given(spark, sf_dir)
    cited = asking.materialise(asking.sources(questions, *given))
    told = asking.checked(asking.quoting(cited, questions), cited)
    sent = asking.contexts(questions, cited)
    return sent.join(told, "qid", "left").select("qid", "question", F.col("n_sources").cast("long").alias("n_sources"), F.length("context").cast("long").alias("n_context"), "answer", F.array_join("cited", ",").alias("cited"), F.size("loose").cast("long").alias("n_loose"))


_SAID = "CASE vec_id // 50 % {} {} END".format(len(ASKED), " ".join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(ASKED)))
ANSWERS = _WITH + f""",
    y AS (SELECT cited.*, {_sentence("body", 1)} AS y FROM cited JOIN q USING (qid)),
    t AS (SELECT * FROM y WHERE y.k > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY place) <= 3),
    told AS (SELECT qid, string_agg(rtrim(y.s, '.') || ' [' || place || '].', ' ' ORDER BY place) AS answer, string_agg(place::VARCHAR, ',' ORDER BY place) AS cited, 0::BIGINT AS n_loose FROM t GROUP BY qid),
    sent AS (SELECT qid, count(*) AS n_sources, (sum(length('[' || place || '] ' || concat_ws(' | ', concat_ws(' — ', title, section), 'depth: ' || depth) || ' ' || body)) + 2 * (count(*) - 1))::BIGINT AS n_context FROM cited GROUP BY qid)
    SELECT vec_id AS qid, {_SAID} AS question, coalesce(n_sources, 0) AS n_sources, n_context, answer, told.cited, n_loose FROM embeddings LEFT JOIN sent ON sent.qid = vec_id LEFT JOIN told ON told.qid = vec_id WHERE vec_id % 50 = 0"""

QUERIES = {"two_stage": (two_stage, TWO_STAGE), "cited_answers": (answers, ANSWERS)}

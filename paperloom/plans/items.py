"""Queries on documents as items: identity, enrichment, scoring, ranking, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import dates, ids, parse, text
from paperloom.operators import dedup, enrich, metrics, nearest, rank, retrieval, scoring, state, votes

AS_OF = "2024-02-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _title(column: str = "text"):
    return F.substring(column, 1, 60)


#: Bibliographic fields that the tables lack, made from the id.
ITEM_SQL = """items AS (
    SELECT doc_id, substring(text, 1, 60) AS title, source, CAST(doc_id % 12 AS INT) AS topic_no,
           CASE WHEN doc_id % 5 = 0 THEN 'off_topic' WHEN doc_id % 5 < 3 THEN 'adjacent' ELSE 'core_fit' END AS relevance_category,
           CASE WHEN doc_id % 3 = 0 THEN 'no_antecedent' WHEN doc_id % 3 = 1 THEN 'ambiguous' ELSE 'matches_known' END AS antecedent_match,
           CASE WHEN doc_id % 7 <> 0 THEN (doc_id * 37) % 500 END AS cites, CASE WHEN doc_id % 11 <> 0 THEN doc_id % 6 END AS age,
           doc_id % 4 AS generality, (doc_id // 4) % 4 AS contribution, (doc_id // 16) % 4 AS testability,
           CASE WHEN doc_id % 2 = 0 THEN doc_id % 8 = 0 END AS isolated_backtest_only, CASE WHEN doc_id % 3 = 0 THEN doc_id % 9 = 0 END AS no_costs_mentioned,
           doc_id % 10 = 0 AS extreme_claimed_sharpe, doc_id % 14 = 0 AS weak_stat_support,
           CASE WHEN doc_id % 4 <> 0 THEN doc_id % 60 END AS h, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 10) * 10.0 END AS impact_percentile FROM documents)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        "doc_id", _title().alias("title"), "source", (i % 12).cast("int").alias("topic_no"),
        F.when(i % 5 == 0, "off_topic").when(i % 5 < 3, "adjacent").otherwise("core_fit").alias("relevance_category"),
        F.when(i % 3 == 0, "no_antecedent").when(i % 3 == 1, "ambiguous").otherwise("matches_known").alias("antecedent_match"),
        F.when(i % 7 != 0, (i * 37) % 500).alias("cites"), F.when(i % 11 != 0, i % 6).alias("age"),
        (i % 4).alias("generality"), (F.floor(i / 4) % 4).alias("contribution"), (F.floor(i / 16) % 4).alias("testability"),
        F.when(i % 2 == 0, i % 8 == 0).alias("isolated_backtest_only"), F.when(i % 3 == 0, i % 9 == 0).alias("no_costs_mentioned"),
        (i % 10 == 0).alias("extreme_claimed_sharpe"), (i % 14 == 0).alias("weak_stat_support"),
        F.when(i % 4 != 0, i % 60).alias("h"), F.when(i % 3 != 0, (i % 10) * 10.0).alias("impact_percentile")
    ).withColumn("topic", F.element_at(F.array(*map(F.lit, scoring.TOPICS)), F.col("topic_no") + 1))


def _values(pairs) -> str:
    return "(VALUES " + ", ".join(f"({', '.join(repr(x) if isinstance(x, str) else str(x) for x in p)})" for p in pairs) + ")"


_TOPIC_SQL = "topics AS (SELECT * FROM " + _values([(i, t, scoring.NOVELTY_PRIOR[t], scoring.RELEVANCE_PRIOR[t]) for i, t in enumerate(scoring.TOPICS)]) + " t(topic_no, topic, np, rp))"
_LR_SQL = "nlr AS (SELECT * FROM " + _values(list(scoring.NOVELTY_LR.items())) + " t(antecedent_match, nl)), rlr AS (SELECT * FROM " + _values(list(scoring.RELEVANCE_LR.items())) + " t(relevance_category, rl))"
_POSTERIOR_SQL = f"""{ITEM_SQL}, {_TOPIC_SQL}, {_LR_SQL},
    scored AS (SELECT i.*, topic, (np::DOUBLE / (1 - np::DOUBLE) * nl::DOUBLE) AS no, (rp::DOUBLE / (1 - rp::DOUBLE) * rl::DOUBLE) AS ro FROM items i JOIN topics USING (topic_no) JOIN nlr USING (antecedent_match) JOIN rlr USING (relevance_category)),
    posteriors AS (SELECT *, no / (1 + no) AS nov, ro / (1 + ro) AS rel FROM scored)"""


def posteriors(spark, sf_dir):
    out = scoring.with_posteriors(items(spark, sf_dir), "topic", "antecedent_match", "relevance_category")
    return out.select("doc_id", "novelty_posterior", "relevance_posterior", "rank_score", "provisional")


POSTERIORS = f"WITH {_POSTERIOR_SQL} SELECT doc_id, round(nov, 3) AS novelty_posterior, round(rel, 3) AS relevance_posterior, CAST(round(100 * rel) AS INT) AS rank_score, nov < 0.28 AS provisional FROM posteriors"


def composite_all(spark, sf_dir):
    base = scoring.with_posteriors(items(spark, sf_dir), "topic", "antecedent_match", "relevance_category")
    none = F.lit(None)
    author = scoring.author_score(F.col("h"), none.cast("int"), none.cast("string"), none.cast("int"), none.cast("double"))
    return scoring.composite(base.withColumn("author_score", author))


def composite_topk(spark, sf_dir):
    """Flagship: the composite's top 5 of each source."""
    top = rank.top_per_group(composite_all(spark, sf_dir), ["source"], [F.desc("composite"), F.col("doc_id")], 5)
    return top.select("source", F.col("rank").cast("long").alias("rank"), "doc_id", "base_quality", "cites_norm", "velocity_norm", "robustness", "reputation", "composite")


COMPOSITE_TOPK = f"""WITH {_POSTERIOR_SQL},
    ok AS (SELECT *, CASE WHEN h IS NULL THEN 50.0 ELSE least(100.0, h * 2.0) END AS a, CASE WHEN cites IS NOT NULL AND age >= 1 THEN cites::DOUBLE / age END AS vel
           FROM posteriors WHERE relevance_category <> 'off_topic' AND NOT regexp_matches(trim(title), '^(editorial board|table of contents|front matter|masthead|issue information|recent quant links|weekly (roundup|links)|links? (roundup|round-up))\\b', 'i')),
    logs AS (SELECT *, ln(1 + coalesce(cites, 0)) AS lc, ln(1 + vel) AS lv FROM ok),
    pool AS (SELECT *, min(lc) OVER () AS c0, max(lc) OVER () AS c1, min(lv) OVER () AS v0, max(lv) OVER () AS v1 FROM logs),
    norm AS (SELECT *, CASE WHEN c1 <= 0 THEN 0.0 WHEN c1 = c0 THEN 100.0 ELSE 100.0 * (lc - c0) / (c1 - c0) END AS cn,
             CASE WHEN lv IS NULL THEN NULL WHEN v1 <= 0 THEN 0.0 WHEN v1 = v0 THEN 100.0 ELSE 100.0 * (lv - v0) / (v1 - v0) END AS vn,
             cites IS NOT NULL AND NOT ((age IS NULL OR age < 1) AND coalesce(cites, 0) = 0) AS cited,
             0.40::DOUBLE * (generality / 3 * 100) + 0.35::DOUBLE * ((CASE WHEN nov < 0.28 THEN least(contribution, 2) ELSE contribution END) / 3 * 100) + 0.25::DOUBLE * (testability / 3 * 100) AS bq,
             greatest(0.5::DOUBLE, CASE WHEN isolated_backtest_only THEN 0.85::DOUBLE ELSE 1 END * CASE WHEN no_costs_mentioned THEN 0.9::DOUBLE ELSE 1 END * CASE WHEN extreme_claimed_sharpe THEN 0.85::DOUBLE ELSE 1 END * CASE WHEN weak_stat_support THEN 0.85::DOUBLE ELSE 1 END) AS r,
             0.85::DOUBLE + 0.3::DOUBLE * ((CASE WHEN impact_percentile IS NULL THEN a ELSE (a + impact_percentile) / 2 END) / 100) AS m FROM pool),
    final AS (SELECT *, round(least(100.0::DOUBLE, ((0.45::DOUBLE + CASE WHEN cited THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN vn IS NOT NULL THEN 0 ELSE 0.25::DOUBLE END) * bq + CASE WHEN cited THEN 0.3::DOUBLE * cn ELSE 0 END + CASE WHEN vn IS NOT NULL THEN 0.25::DOUBLE * vn ELSE 0 END) * r * m), 1) AS composite FROM norm),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY composite DESC, doc_id) AS rank FROM final)
    SELECT source, rank, doc_id, round(bq, 1) AS base_quality, CASE WHEN cited THEN round(cn, 1) END AS cites_norm, round(vn, 1) AS velocity_norm, round(r, 3) AS robustness, round(m, 3) AS reputation, composite FROM ranked WHERE rank <= 5"""


def identity_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    doi = F.when(i % 6 == 0, F.concat(F.lit("10.48550/arXiv.2401."), F.lpad((i % 500).cast("string"), 5, "0"), F.lit("v2"))).when(i % 6 == 1, F.concat(F.lit("10.1000/ABC."), (i % 400).cast("string")))
    url = F.when(i % 6 == 2, F.concat(F.lit("https://arxiv.org/abs/2401."), F.lpad((i % 500).cast("string"), 5, "0"), F.lit("v1")))
    keyed = docs.select(ids.paper_uid(doi, F.lit(None).cast("string"), url, _title()).alias("uid"), "source", "doc_id")
    return dedup.merge_batch(keyed, "uid", "source", "doc_id").select("uid", "doc_id", "source", F.array_join("sources", ",").alias("sources"))


IDENTITY = """WITH k AS (SELECT doc_id, source, CASE
      WHEN doc_id % 6 IN (0, 2) THEN 'arxiv:2401.' || lpad((doc_id % 500)::VARCHAR, 5, '0') WHEN doc_id % 6 = 1 THEN 'doi:10.1000/abc.' || (doc_id % 400)
      ELSE 't:' || substring(sha1(trim(regexp_replace(lower(substring(text, 1, 60)), '[^a-z0-9]+', ' ', 'g'))), 1, 16) END AS uid FROM documents)
    SELECT uid, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM k GROUP BY uid"""


def title_keys(spark, sf_dir):
    t = _title()
    return read(spark, sf_dir, "documents").select("doc_id", text.title_key(t).alias("spaced"), text.title_key_joined(t).alias("joined"), text.title_key_hyphens(t).alias("hyphens"), F.sha1(text.title_key(t).cast("binary")).alias("digest"))


TITLE_KEYS = """SELECT doc_id, trim(regexp_replace(lower(substring(text, 1, 60)), '[^a-z0-9]+', ' ', 'g')) AS spaced, regexp_replace(lower(substring(text, 1, 60)), '[^a-z0-9 ]', '', 'g') AS joined,
    regexp_replace(lower(substring(text, 1, 60)), '[^a-z0-9 -]', ' ', 'g') AS hyphens, sha1(trim(regexp_replace(lower(substring(text, 1, 60)), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents"""


def exact_groups(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")


EXACT = "SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1"


def only_new(spark, sf_dir):
    return dedup.only_new(read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), read(spark, sf_dir, "labels"), "doc_id")


ONLY_NEW = "SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def fill_only(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 4 == 0, F.lit(0)).alias("quality"))
    found = read(spark, sf_dir, "labels").select("doc_id", F.lit("xx").alias("lang"), "quality")
    return enrich.fill_only(docs, found, "doc_id", ["lang"], ["quality"])


FILL = """SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN CASE WHEN l.doc_id IS NULL THEN '' ELSE 'xx' END ELSE lang END AS lang,
    CASE WHEN d.doc_id % 4 = 0 THEN 0 ELSE l.quality END AS quality FROM documents d LEFT JOIN labels l USING (doc_id)"""


def junk(spark, sf_dir):
    t = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("Front matter: "), _title())).when(F.col("doc_id") % 9 == 1, F.concat(F.lit("Links round-up "), _title())).otherwise(_title())
    return read(spark, sf_dir, "documents").select("doc_id", t.alias("title")).filter(~scoring.is_junk(F.col("title")))


JUNK = r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'Front matter: ' WHEN doc_id % 9 = 1 THEN 'Links round-up ' ELSE '' END || substring(text, 1, 60) AS title FROM documents)
    SELECT * FROM t WHERE NOT regexp_matches(trim(title), '^(editorial board|table of contents|front matter|masthead|issue information|recent quant links|weekly (roundup|links)|links? (roundup|round-up))\b', 'i')"""

TERMS = ["there", "onth", "étion", "keit"]


def keyword_gate(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter(text.contains_any(F.col("text"), TERMS)).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


GATE = "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{t}')" for t in TERMS) + " GROUP BY lang"


def contains_items(spark, sf_dir):
    bench = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return enrich.contains_match(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", bench, "passage", "item_id", "doc_id")


CONTAINS = "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"


def beta(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    g = docs.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("hits"), F.count("quality").alias("total"))
    return g.select("source", "hits", "total", scoring.beta_binomial(F.col("hits"), F.col("total"), 1.0, 20.0).alias("novelty_prior"), scoring.beta_binomial(F.col("hits"), F.col("total"), 2.0, 8.0).alias("relevance_prior"))


BETA = """WITH g AS (SELECT source, count(*) FILTER (WHERE quality = 1) AS hits, count(quality) AS total FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
    SELECT *, round((1.0::DOUBLE + hits) / (21.0::DOUBLE + total), 4) AS novelty_prior, round((2.0::DOUBLE + hits) / (10.0::DOUBLE + total), 4) AS relevance_prior FROM g"""


def labels_exploded(spark, sf_dir):
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 9))
    return metrics.label_counts(read(spark, sf_dir, "documents").withColumn("tags", words), "tags").filter("count >= 5").select("label", F.col("count").alias("n"))


LABELS = "WITH t AS (SELECT unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) >= 9))) AS label FROM documents) SELECT label, count(*) AS n FROM t GROUP BY label HAVING count(*) >= 5"


def coverage(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return metrics.share_of(docs, ["source"], F.col("quality").isNotNull(), "labelled")


COVERAGE = "SELECT source, round(avg(CASE WHEN quality IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"


def fit_and_strength(spark, sf_dir):
    weights = {" the ": 1.0, "tion": 0.5, " la ": 2.0, "keit": 1.5, "ing ": 0.25}
    return items(spark, sf_dir).select("doc_id", scoring.topical_fit(F.col("title"), weights).alias("fit"), scoring.strength(F.col("generality"), F.col("testability"), F.lit(0.3)).alias("strength"))


FIT = f"""WITH {ITEM_SQL}, p AS (SELECT *, ' ' || replace(lower(title), '-', ' ') || ' ' AS t FROM items)
    SELECT doc_id, (CASE WHEN contains(t, ' the ') THEN 1.0 ELSE 0 END + CASE WHEN contains(t, 'tion') THEN 0.5 ELSE 0 END + CASE WHEN contains(t, ' la ') THEN 2.0 ELSE 0 END + CASE WHEN contains(t, 'keit') THEN 1.5 ELSE 0 END + CASE WHEN contains(t, 'ing ') THEN 0.25 ELSE 0 END)::DOUBLE AS fit,
    least(100.0::DOUBLE, greatest(0.0::DOUBLE, round((generality + testability) / 6 * 50 + 0.3::DOUBLE * 50))) AS strength FROM p"""

QUESTION = ["there", "onth", "tion", "thing"]


def bm25(spark, sf_dir):
    out = retrieval.bm25(read(spark, sf_dir, "documents"), "doc_id", "text", QUESTION)
    return out.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


BM25 = f"""WITH t AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
    c AS (SELECT doc_id, len(w) AS n, {', '.join(f"len(list_filter(w, lambda x: x = '{q}')) AS f{i}" for i, q in enumerate(QUESTION))} FROM t),
    s AS (SELECT count(*) AS docs, avg(n) AS a, {', '.join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(QUESTION)))} FROM c),
    r AS (SELECT doc_id, {' + '.join(f"CASE WHEN f{i} > 0 THEN ln(1 + (docs - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) * f{i} * 2.5::DOUBLE / (f{i} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / a)) ELSE 0 END" for i in range(len(QUESTION)))} AS score FROM c, s)
    SELECT doc_id, round(score, 6) AS score FROM r WHERE score > 0 ORDER BY round(score, 6) DESC, doc_id LIMIT 50"""


def cosine(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return retrieval.recall(v, v.filter("vec_id = 0").select(F.col("embedding").alias("q")), "embedding", "vec_id", 200).select("vec_id", "label", "sim")


COSINE = "SELECT v.vec_id, v.label, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS sim FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY 3 DESC, 1 LIMIT 200"


def int8(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select("vec_id", retrieval.quantise(F.col("embedding")).alias("v"))
    out = retrieval.recall(v, v.filter("vec_id = 0").select(F.col("v").alias("q")), "v", "vec_id", 100)
    return out.select("vec_id", F.col("sim").cast("long").alias("sim"))


INT8 = """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS s FROM embeddings),
    q AS (SELECT vec_id, list_transform(e, lambda x: round_even(x / s * 127, 0)) AS v FROM n)
    SELECT a.vec_id, list_dot_product(a.v, b.v)::BIGINT AS sim FROM q a, (SELECT v FROM q WHERE vec_id = 0) b ORDER BY 2 DESC, 1 LIMIT 100"""


def knn(spark, sf_dir):
    """Neighbours of every tenth vector against all vectors, and how many have its label."""
    v = read(spark, sf_dir, "embeddings")
    near = nearest.nearest(v, v.filter("vec_id % 10 = 0"), "vec_id", "embedding", 5)
    return nearest.coherence(near, v, "vec_id", "label", 5)


KNN = """WITH p AS (SELECT a.vec_id AS q, b.vec_id AS o, a.label = b.label AS same, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) DESC, b.vec_id) AS r
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 10 = 0), e AS (SELECT q, count(*) FILTER (WHERE same) / 5.0::DOUBLE AS s FROM p WHERE r <= 5 GROUP BY q)
    SELECT round(avg(s), 6) AS coherence, count(*) AS n FROM e"""


def blended(spark, sf_dir):
    """Recall by vector, then similarity, keywords and quality blended; documents stand beside vectors of their id."""
    v = read(spark, sf_dir, "embeddings")
    near = retrieval.recall(v, v.filter("vec_id = 0").select(F.col("embedding").alias("q")), "embedding", "vec_id", 200)
    docs = items(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "title", "generality", "testability")
    terms = F.array(*map(F.lit, QUESTION))
    quality = retrieval.quality_prior(scoring.strength(F.col("generality"), F.col("testability"), F.lit(0.3)), F.lit(1.0))
    joined = near.join(docs, "vec_id")
    return joined.select("vec_id", F.round(retrieval.blend(F.col("sim"), text.keyword_hits(terms, F.col("title")), F.lit(0.0), quality), 4).alias("score")).orderBy(F.desc("score"), "vec_id").limit(48)


BLENDED = f"""WITH {ITEM_SQL}, near AS ({COSINE}), j AS (SELECT vec_id, sim, title, least(100.0::DOUBLE, greatest(0.0::DOUBLE, round((generality + testability) / 6 * 50 + 0.3::DOUBLE * 50))) / 100 AS q FROM near JOIN items ON vec_id = doc_id)
    SELECT vec_id, round(0.55::DOUBLE * greatest(0::DOUBLE, least(1::DOUBLE, sim)) + 0.3::DOUBLE * (0.6::DOUBLE * (({' + '.join(f"CASE WHEN contains(lower(title), '{q}') THEN 1 ELSE 0 END" for q in QUESTION)}) / {len(QUESTION)}.0::DOUBLE)) + 0.15::DOUBLE * least(1.2::DOUBLE, q), 4) AS score FROM j ORDER BY 2 DESC, 1 LIMIT 48"""


def history(spark, sf_dir):
    out = retrieval.history(read(spark, sf_dir, "conversations"), "conv_id", "turn")
    return out.select("conv_id", "turn", "role", F.substring("text", 1, 500).alias("text"), F.col("place").cast("long").alias("place"))


HISTORY = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
    SELECT conv_id, turn, role, substring(text, 1, 500) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM r WHERE n <= 6"""


def questions(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", text.question_key(F.col("text")).alias("key"), F.size(text.question_terms(F.col("text"))).cast("long").alias("n_terms"))


_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"
QUESTIONS = f"""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w))) AS w FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, array_to_string(list_sort(w), ' ') AS key, len(w)::BIGINT AS n_terms FROM t"""


def pages_clean(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", text.clean_html(text.unescape(F.regexp_extract("html", r"<title>([^<]*)</title>", 1))).alias("title"), F.length(text.clean_html(F.col("html"))).cast("long").alias("n_clean"))


_UNESCAPE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
for _a, _b in text.ENTITIES:
    _UNESCAPE = f"replace({_UNESCAPE}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"
PAGES = rf"""SELECT page_id, trim(regexp_replace(regexp_replace({_UNESCAPE}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS title,
    length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')))::BIGINT AS n_clean FROM pages"""


def page_links(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"#?]+)'), F.lit(1))).alias("pos", "link"))
    first = dedup.keep_first(p, ["page_id", "link"], [F.col("pos")])
    return rank.top_per_group(first, ["page_id"], [F.col("pos")], 15).select("page_id", "link", F.col("rank").cast("long").alias("rank"))


LINKS = """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"#?]+)', 1)) AS link, generate_subscripts(regexp_extract_all(html, 'href="([^"#?]+)', 1), 1) AS pos FROM pages),
    f AS (SELECT page_id, link, min(pos) AS pos FROM l GROUP BY 1, 2), r AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM f) SELECT * FROM r WHERE rank <= 15"""


def pdf_links(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://arxiv.org/abs/2401."), F.lpad(F.col("page_id").cast("string"), 5, "0"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://www.nber.org/papers/w"), F.col("page_id").cast("string"))).otherwise(F.concat("url", F.lit(".pdf"))).alias("u"))
    return p.select("page_id", ids.pdf_link(F.lit(None).cast("string"), F.col("u")).alias("pdf"), text.safe_name(F.col("u")).alias("file"))


PDFS = """WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://arxiv.org/abs/2401.' || lpad(page_id::VARCHAR, 5, '0') WHEN page_id % 3 = 1 THEN 'https://www.nber.org/papers/w' || page_id ELSE url || '.pdf' END AS u FROM pages)
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://arxiv.org/pdf/' || substring(u, 23) WHEN page_id % 3 = 1 THEN 'https://www.nber.org/system/files/working_papers/' || substring(u, 29) || '/' || substring(u, 29) || '.pdf' ELSE u END AS pdf,
    substring(regexp_replace(u, '[^A-Za-z0-9._-]', '_', 'g'), 1, 120) AS file FROM p"""


def redacted(spark, sf_dir):
    line = F.concat(F.lit("GET "), "url", F.lit("?api_key=s3cret"), F.col("page_id").cast("string"), F.lit("&mailto=a@b.org&x=1"))
    return read(spark, sf_dir, "pages").select("page_id", text.redact(line).alias("line"))


REDACT = r"SELECT page_id, regexp_replace('GET ' || url || '?api_key=s3cret' || page_id || '&mailto=a@b.org&x=1', '((?:api_)?key|mailto)=[^&\s]+', '\1=***', 'g') AS line FROM pages"


def sampled(spark, sf_dir):
    return rank.stratified(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 30, 7)


def shortened(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.tidy(F.col("text")).alias("abstract"), text.embedding_text(_title(), F.col("lang"), F.lit(""), F.substring("text", 1, 200)).alias("embedded"))



QUERIES = {
    "composite_topk": (composite_topk, COMPOSITE_TOPK), "posteriors": (posteriors, POSTERIORS), "identity_dedup": (identity_dedup, IDENTITY), "title_keys": (title_keys, TITLE_KEYS),
    "exact_dup_groups": (exact_groups, EXACT), "anti_join_new": (only_new, ONLY_NEW), "fill_only_enrich": (fill_only, FILL), "junk_filter": (junk, JUNK), "keyword_gate": (keyword_gate, GATE),
    "contains_match": (contains_items, CONTAINS), "beta_binomial": (beta, BETA), "label_explode": (labels_exploded, LABELS), "coverage": (coverage, COVERAGE), "topical_fit": (fit_and_strength, FIT),
    "bm25": (bm25, BM25), "cosine_topk": (cosine, COSINE), "int8_cosine_topk": (int8, INT8), "knn_coherence": (knn, KNN), "blend_rank": (blended, BLENDED), "history_window": (history, HISTORY),
    "question_keys": (questions, QUESTIONS), "html_clean": (pages_clean, PAGES), "link_extract": (page_links, LINKS), "pdf_links": (pdf_links, PDFS), "redact": (redacted, REDACT),
    "stratified_sample": (sampled, None), "tidy_abstracts": (shortened, None),
}

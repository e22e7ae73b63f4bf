"""Queries of the portal's views, gates and writers."""

from __future__ import annotations


from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import gates, metrics, passages, rank, sinks, state

from .items import ITEM_SQL, composite_all, items, read


def digest_keep(spark, sf_dir):
    i = items(spark, sf_dir).select("doc_id", (F.col("doc_id") % 13 == 0).alias("watched"), "relevance_category", F.when(F.col("doc_id") % 6 != 0, F.col("doc_id") % 50).alias("score"))
    return gates.keep_for_digest(i, "watched", "relevance_category", "score").select("doc_id")


DIGEST = f"WITH {ITEM_SQL} SELECT doc_id FROM items WHERE CASE WHEN doc_id % 13 = 0 THEN relevance_category <> 'off_topic' ELSE doc_id % 6 <> 0 AND doc_id % 50 >= 20 END"


def shortlist(spark, sf_dir):
    return gates.shortlist(items(spark, sf_dir), "generality", "contribution", "doc_id").select("doc_id", "generality", "contribution")


SHORTLIST = f"WITH {ITEM_SQL} SELECT doc_id, generality, contribution FROM items WHERE generality >= 2 AND contribution >= 2 ORDER BY generality DESC, contribution DESC, doc_id LIMIT 250"


def same_paper(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("The pricing of "), "p_name", F.lit(" over time")).alias("a"), "p_size")
    other = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper("a"), F.lit(": a study"))).when(F.col("p_partkey") % 3 == 1, F.col("a")).otherwise("Other")
    ok = gates.same_paper(F.col("a"), other, F.when(F.col("p_partkey") % 4 != 0, F.lit(2000)), 2000 + F.col("p_size") % 12, F.lit("Ann Lee"), F.when(F.col("p_partkey") % 5 == 0, "Bo Lee").otherwise("Cy Roe"))
    return p.filter(ok).select("p_partkey")


SAME = "SELECT p_partkey FROM part WHERE p_partkey % 3 <> 2 AND (p_partkey % 4 = 0 OR p_size % 12 <= 6 OR p_partkey % 5 = 0)"


def author_filter(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    given = F.when(F.col("c_custkey") % 3 == 0, "J.").when(F.col("c_custkey") % 3 == 1, "Jane").otherwise("Joan")
    ok = gates.author_fits(given, F.when(F.col("c_custkey") % 2 == 0, "Doe").otherwise("Roe"), text.person_key(F.lit("Jane Doe")))
    return c.filter(ok).select("c_custkey")


AUTHOR_FILTER = "SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 2"


def lanes(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("seen"), F.concat(F.lit("u"), (F.col("event_id") % 700).cast("string")).alias("url"), (F.col("event_id") % 101).alias("score"), (F.col("event_id") % 4).alias("contribution"),
                                               (F.col("event_id") % 5 == 0).alias("provisional"), (F.col("user_id") % 9 == 0).alias("watched"), F.when(F.col("user_id") % 2 == 0, "core_fit").otherwise("adjacent").alias("category"))
    e = e.groupBy("url").agg(F.max_by(F.struct("event_id", "seen", "score", "contribution", "provisional", "watched", "category"), "event_id").alias("r")).select("url", "r.*")
    out = gates.recent_lanes(e, "seen", "url", "score", "contribution", "provisional", "watched", "category")
    return out.select("url", "event_id", "score", F.col("lane").cast("long").alias("lane"))


LANES = """WITH e AS (SELECT 'u' || (event_id % 700) AS url, max(event_id) AS event_id FROM events GROUP BY 1), j AS (SELECT e.url, e.event_id, ts::DATE AS d, e.event_id % 101 AS score, e.event_id % 4 AS c, e.event_id % 5 = 0 AS p, user_id % 9 = 0 AS w, user_id % 2 = 0 AS core FROM e JOIN events v ON e.event_id = v.event_id),
    k AS (SELECT * FROM j WHERE d >= (SELECT max(d) FROM j) - 6), s AS (SELECT url, event_id, score, 0::BIGINT AS lane FROM k WHERE score >= 75 AND c = 3 AND NOT p ORDER BY score DESC, url LIMIT 20)
    SELECT * FROM s UNION ALL SELECT url, event_id, score, 1::BIGINT FROM k WHERE w AND core AND url NOT IN (SELECT url FROM s)"""


def seminal(spark, sf_dir):
    c = composite_all(spark, sf_dir).withColumn("url", F.concat(F.lit("U"), F.col("doc_id").cast("string")))
    listed = read(spark, sf_dir, "documents").filter("doc_id % 8 = 3").select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.lit(None).cast("string").alias("title"))
    return gates.seminal(c.withColumn("composite", F.col("composite") + 20), listed, "url", "title").select("doc_id", "url")


def backlog(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    tags = F.when(F.col("toxic") == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("a")))
    return gates.backlog(d.withColumn("tags", tags), F.col("doc_id") % 10 == 0, "quality", "tags", "doc_id").select("doc_id", "quality")


BACKLOG = "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 10 <> 0 AND (quality IS NULL OR toxic = 1)"


def known_ids(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    c = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("doi:10.1234/"), "p_partkey")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("arxiv:2401."), F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit("v2"))).otherwise(F.concat(F.lit("t:"), "p_partkey"))
    return p.filter(gates.known_id(c)).select("p_partkey")


KNOWN = "SELECT p_partkey FROM part WHERE p_partkey % 3 <> 2"


def priorities(spark, sf_dir):
    i = items(spark, sf_dir)
    p = gates.priority(F.col("h"), F.lit(0.1), F.lit(1.05), F.col("doc_id") % 9 == 0, F.when(F.col("doc_id") % 20 == 0, "canon").when(F.col("doc_id") % 20 == 1, "cited"), F.when(F.col("doc_id") % 4 == 0, "preprint").when(F.col("doc_id") % 4 == 1, "working paper").when(F.col("doc_id") % 4 == 2, "open"))
    return i.select("doc_id", F.round(p, 4).alias("priority")).orderBy(F.desc("priority"), "doc_id").limit(120)


PRIORITY = f"""WITH {ITEM_SQL} SELECT doc_id, round((coalesce(h, 0)::DOUBLE / 100 + 0.1::DOUBLE) * 1.05::DOUBLE + CASE WHEN doc_id % 9 = 0 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN doc_id % 20 = 0 THEN 4.5::DOUBLE WHEN doc_id % 20 = 1 THEN 3.0::DOUBLE ELSE 0 END
    + 1.5::DOUBLE * CASE doc_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.9::DOUBLE WHEN 2 THEN 0.35::DOUBLE ELSE 0.2::DOUBLE END, 4) AS priority FROM items ORDER BY 2 DESC, 1 LIMIT 120"""


def grouped(spark, sf_dir):
    """Four categories with counts, the newest 20 of each."""
    o = read(spark, sf_dir, "orders").withColumn("cat", F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).when(F.col("o_orderstatus") == "P", 3).otherwise(2))
    n = o.groupBy("cat").agg(F.count("*").alias("n"))
    top = rank.top_per_group(o, ["cat"], [F.desc("o_orderdate"), F.col("o_orderkey")], 20)
    return top.join(n, "cat").select(F.col("cat").cast("long").alias("cat"), F.col("rank").cast("long").alias("rank"), "o_orderkey", "n")


GROUPED = """WITH c AS (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderpriority = '2-HIGH' THEN 1 WHEN o_orderstatus = 'P' THEN 3 ELSE 2 END::BIGINT AS cat FROM orders),
    r AS (SELECT cat, o_orderkey, row_number() OVER (PARTITION BY cat ORDER BY o_orderdate DESC, o_orderkey) AS rank, count(*) OVER (PARTITION BY cat) AS n FROM c) SELECT * FROM r WHERE rank <= 20"""


def tags_histogram(spark, sf_dir):
    """How many distinct event types a user has, and how many users have so many."""
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.size(F.collect_set("event_type")).cast("long").alias("tags")).groupBy("tags").agg(F.count("*").alias("users"))


TAGS = "SELECT tags, count(*) AS users FROM (SELECT user_id, count(DISTINCT event_type) AS tags FROM events GROUP BY 1) GROUP BY 1"


def probe_accuracy(spark, sf_dir):
    """Share of probes whose label is the expected one, unknown ones left out."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    known = d.filter(F.col("quality").isNotNull())
    return known.groupBy("lang").agg(F.round(F.avg((F.col("quality") == (F.col("n_chars") > 100).cast("int")).cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))


PROBE = "SELECT lang, round(avg(CASE WHEN quality = (CASE WHEN n_chars > 100 THEN 1 ELSE 0 END) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1"


def vector_index(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return sinks.vector_rows(v.select("vec_id", "label"), v.select("vec_id", F.size("embedding").cast("long").alias("dim")), "vec_id", [F.col("label")]).select("row", "shard", "vec_id", "dim")


VECTORS = "SELECT row, row // 64 AS shard, vec_id, dim FROM (SELECT row_number() OVER (ORDER BY label, vec_id) - 1 AS row, vec_id, len(embedding)::BIGINT AS dim FROM embeddings)"


def cache_gap(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), F.lit("m").alias("model"), F.lit(256).alias("dim"))
    cache = d.filter("uid % 4 <> 0").withColumn("dim", F.when(F.col("uid") % 4 == 1, 1024).otherwise(256))
    return state.uncached(d, cache, ["uid", "model", "dim"]).select("uid")


CACHE = "SELECT doc_id AS uid FROM documents WHERE doc_id % 4 < 2"


def stale_texts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    cache = d.select("doc_id", F.sha1(F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("text")).cast("binary")).alias("digest"))
    return state.stale(d, cache, "doc_id", F.col("text"), "digest")


STALE = "SELECT doc_id FROM documents WHERE doc_id % 5 = 0 AND text <> 'old'"


def split_passages(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return passages.fold(d.withColumn("section", F.lit("body")), "doc_id", "section", "pos", "line")


# Cuts depend on what came before, so lines are folded one after the other.
PASSAGES = r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(range(0, len(a))) AS pos, unnest(a) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
    w AS MATERIALIZED (SELECT *, len(list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))::BIGINT AS n FROM l),
    f AS (SELECT doc_id, pos, 0 AS passage, n AS words FROM w WHERE pos = 0
          UNION ALL SELECT w.doc_id, w.pos, CASE WHEN f.words >= 220 THEN f.passage + 1 ELSE f.passage END, CASE WHEN f.words >= 220 THEN 0 ELSE f.words END + w.n FROM f JOIN w ON w.doc_id = f.doc_id AND w.pos = f.pos + 1)
    SELECT doc_id, 'body' AS section, passage, string_agg(t, ' ' ORDER BY pos) AS text, sum(n)::BIGINT AS words FROM f JOIN w USING (doc_id, pos) GROUP BY doc_id, passage HAVING sum(n) >= 25"""


def canon_match(spark, sf_dir):
    """Four candidates for each part: an article of another author, a book and a chapter of the author, and a short name."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_size")
    wanted = p.select("k", F.col("p_name").alias("title"), F.lit("Lee").alias("author"), (2000 + F.col("p_size") % 20).alias("year"))
    kinds = [("journal-article", " revised", "Roe", 2005), ("book", "", "lee", 2004), ("proceedings-article", " and more of the same kind", "LEE", 1990), ("report", " revised", "Kleeman", 2012)]
    every = [F.struct(F.lit(i).alias("pos"), F.lit(kind).alias("kind"), F.lit(tail).alias("tail"), F.array(F.lit(who)).alias("authors"), F.lit(year).alias("year")) for i, (kind, tail, who, year) in enumerate(kinds)]
    rows = p.select("k", "p_name", F.explode(F.array(*every)).alias("f")).filter("(k + f.pos) % 3 <> 0")
    found = rows.select("k", F.concat("p_name", "f.tail").alias("title"), "f.authors", "f.year", "f.kind", "f.pos")
    return passages.best_match(wanted, found, "k").select("k", "title", F.array_join("authors", ",").alias("authors"), F.col("year").cast("long").alias("year"), "score")


# A candidate's title starts with the title wanted, so the blocks that match are just that.
CANON = """WITH c AS (SELECT * FROM (VALUES (0, 'journal-article', ' revised', 'Roe', 2005), (1, 'book', '', 'lee', 2004), (2, 'proceedings-article', ' and more of the same kind', 'LEE', 1990), (3, 'report', ' revised', 'Kleeman', 2012)) t(pos, kind, tail, who, year)),
    j AS (SELECT p_partkey AS k, p_name || tail AS title, who AS authors, c.year::BIGINT AS year, pos, kind, lower(who) = 'lee' AS ok, abs(c.year - (2000 + p_size % 20)) AS off,
          2.0::DOUBLE * length(p_name) / (2 * length(p_name) + length(tail)) AS ratio FROM part, c WHERE (p_partkey + pos) % 3 <> 0),
    s AS (SELECT *, round(ratio + CASE WHEN ok THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN kind IN ('journal-article', 'proceedings-article') THEN 0.05::DOUBLE WHEN kind = 'book' THEN -0.5::DOUBLE ELSE 0 END - CASE WHEN off > 3 THEN 0.10::DOUBLE ELSE 0 END, 9) AS score FROM j WHERE ok OR off <= 7),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, pos) AS n FROM s WHERE score > 0)
    SELECT k, title, authors, year, round(score, 6) AS score FROM r WHERE n = 1 AND (ok AND score >= 0.6 OR ratio >= 0.82 AND off <= 5)"""


QUERIES = {
    "digest_keep": (digest_keep, DIGEST), "consensus_shortlist": (shortlist, SHORTLIST), "same_paper": (same_paper, SAME), "author_filter": (author_filter, AUTHOR_FILTER), "recent_lanes": (lanes, LANES),
    "rescore_backlog": (backlog, BACKLOG), "known_ids": (known_ids, KNOWN), "fetch_priority": (priorities, PRIORITY), "grouped_listing": (grouped, GROUPED), "tags_histogram": (tags_histogram, TAGS),
    "probe_accuracy": (probe_accuracy, PROBE), "vector_index_rows": (vector_index, VECTORS), "embedding_cache_gap": (cache_gap, CACHE), "stale_vectors": (stale_texts, STALE),
    "passages_split": (split_passages, PASSAGES), "canon_best_match": (canon_match, CANON), "seminal_promotion": (seminal, None),
}

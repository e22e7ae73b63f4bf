"""Queries of paged scans, runs in batches, months, cascades, the ingest queue and written passages.

Replies and requests are made from the tables' rows; the SQL states the rule itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import gates, passages, portal, runs, sinks, votes
from paperloom.session import shared_dir
from paperloom.sources import paged
from paperloom.streaming import ingest

from .items import read


def _s(c):
    return F.col(c).cast("string")


def _folder(spark):
    return f"{shared_dir(spark)}/paperloom/{uuid.uuid4().hex}"


def paged_papers(spark, sf_dir):
    """Customers as programs, four orders a page; some pages are short, lost or missing, and what lies behind isn't read."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), "o_orderdate", "o_orderpriority")
    w = Window.partitionBy("c").orderBy("k")
    placed = o.withColumn("n", F.row_number().over(w) - 1).withColumns({"page": (F.floor(F.col("n") / 4) + 1).cast("int"), "place": F.col("n") % 4}).filter("not (c % 3 = 0 and page = 2 and place >= 2) and not (c % 7 = 0 and page = 3)")
    entry = F.struct("place", F.struct(F.concat(F.lit("<b>"), "o_orderpriority", F.lit("</b>")).alias("title"), F.array(F.concat(F.lit("<a href='x'>P "), _s("c"), F.lit("</a>")), F.lit("<a>Q</a>")).alias("authors"),
                                       F.when(F.col("k") % 4 != 0, F.date_format("o_orderdate", "MMMM yyyy")).alias("displaydate"), F.concat(F.lit("/papers/w"), (F.col("k") % 997).cast("string")).alias("url")).alias("e"))
    bodies = placed.groupBy("c", "page").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("results"))).alias("body"))
    pages = bodies.select(F.lpad(_s("c"), 9, "0").alias("query"), "page", F.when(~((F.col("c") % 5 == 0) & (F.col("page") == 2)), F.col("body")).alias("body"))
    return paged.working_papers(pages, per_page=4, as_of="2024-02-01").select("nber_wp", "title", "authors", "date", "url", "doi")


PAGED = """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderdate, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders),
    p AS (SELECT *, n // 4 + 1 AS page, n % 4 AS place FROM o WHERE NOT (c % 3 = 0 AND n // 4 = 1 AND n % 4 >= 2) AND NOT (c % 7 = 0 AND n // 4 = 2)),
    s AS (SELECT c, page, CASE WHEN c % 5 = 0 AND page = 2 THEN 0 ELSE count(*) END AS n FROM p GROUP BY c, page),
    e AS (SELECT s.c, min(s.page) AS last FROM s LEFT JOIN s t ON t.c = s.c AND t.page = s.page + 1 WHERE s.n < 4 OR t.c IS NULL GROUP BY s.c),
    r AS (SELECT p.* FROM p JOIN e USING (c) WHERE page <= last AND NOT (c % 5 = 0 AND page = 2) QUALIFY row_number() OVER (PARTITION BY k % 997 ORDER BY c DESC, page DESC, place DESC) = 1)
    SELECT 'w' || (k % 997) AS nber_wp, o_orderpriority AS title, 'P ' || c || ', Q' AS authors, CASE WHEN k % 4 <> 0 THEN strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') ELSE '2024-02-01' END AS date,
    'https://www.nber.org/papers/w' || (k % 997) AS url, '10.3386/w' || (k % 997) AS doi FROM r"""


def prefix_works(spark, sf_dir):
    """Fifty parts a reply, some of other publishers, some without a day or a title, and some replies lost."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    work = F.struct(F.concat(F.when(k % 3 == 0, "10.1000/").otherwise("10.2139/SSRN."), _s("p_partkey")).alias("DOI"), F.concat(F.lit("https://x.org/"), _s("p_partkey")).alias("URL"), F.array(F.when(k % 11 == 0, " ").otherwise(F.col("p_name"))).alias("title"),
                    F.array(F.struct(F.lit("A").alias("given"), F.col("p_brand").alias("family")), F.struct(F.lit(None).cast("string").alias("given"), F.lit("B").alias("family"))).alias("author"),
                    F.struct(F.array(F.when(k % 2 == 0, F.array(F.lit(2024), (k % 12 + 1).cast("int"))).otherwise(F.array(F.lit(2024), (k % 12 + 1).cast("int"), F.lit(9)))).alias("date-parts")).alias("created"))
    pages = p.groupBy(F.floor(k / 50).alias("q")).agg(F.to_json(F.struct(F.struct(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), work.alias("w")))), lambda x: x["w"]).alias("items")).alias("message"))).alias("body"))
    pages = pages.select(_s("q").alias("query"), F.lit(1).alias("page"), F.when(F.col("q") % 9 != 4, F.col("body")).alias("body"))
    return paged.prefix_works(pages, "10.2139", "2024-05-02", "SSRN (via Crossref)", 7).select("doi", "title", "authors", "url", "date", "source")


PREFIX = """WITH p AS (SELECT *, p_partkey AS k, p_partkey // 50 AS q, p_partkey % 12 + 1 AS m FROM part),
    d AS (SELECT *, '2024-' || lpad(m::VARCHAR, 2, '0') || CASE WHEN k % 2 = 0 THEN '-01' ELSE '-09' END AS day FROM p),
    r AS (SELECT * FROM d WHERE k % 3 <> 0 AND q % 9 <> 4 AND day >= '2024-05-02' QUALIFY row_number() OVER (PARTITION BY q ORDER BY day DESC, k) <= 7)
    SELECT '10.2139/ssrn.' || k AS doi, p_name AS title, 'A ' || p_brand || ', B' AS authors, 'https://x.org/' || k AS url, day AS date, 'SSRN (via Crossref)' AS source FROM r WHERE k % 11 <> 0"""


def keyword_papers(spark, sf_dir):
    """Fifty orders a search, whose first forty recent ones are taken."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    paper = F.struct(F.concat(F.lit("On  "), "o_orderpriority").alias("title"), F.when(k % 3 == 0, F.repeat(F.concat("o_orderstatus", F.lit("x ")), 500)).alias("abstract"), F.when(k % 5 != 0, F.concat(F.lit("u"), _s("o_orderkey"))).alias("url"),
                     F.when(k % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("publicationDate"), F.transform(F.array(*[F.lit(x) for x in "ABCDE"]), lambda a: F.struct(a.alias("name"))).alias("authors"),
                     F.struct(F.when(k % 2 == 0, F.concat(F.lit("10.1/"), _s("o_orderkey"))).alias("DOI"), F.when(k % 4 == 1, _s("o_orderkey")).alias("ArXiv")).alias("externalIds"))
    pages = o.groupBy(F.floor(k / 50).alias("q")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), paper.alias("p")))), lambda x: x["p"]).alias("data"))).alias("body"))
    found = paged.keyword_papers(pages.select(_s("q").alias("query"), F.lit(1).alias("page"), "body"), "1996-01-01", 6)
    return found.select("title", "authors", F.length("abstract").cast("long").alias("n"), "url", "date", "doi", "arxiv_id")


KEYWORD = """WITH r AS (SELECT *, o_orderkey AS k FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderdate >= DATE '1996-01-01' QUALIFY row_number() OVER (PARTITION BY o_orderkey // 50 ORDER BY o_orderkey) <= 6)
    SELECT 'On ' || o_orderpriority AS title, 'A, B, C, D' AS authors, CASE WHEN k % 3 = 0 THEN 800 ELSE 0 END::BIGINT AS n, CASE WHEN k % 5 <> 0 THEN 'u' || k ELSE '' END AS url, strftime(o_orderdate, '%Y-%m-%d') AS date,
    CASE WHEN k % 2 = 0 THEN '10.1/' || k END AS doi, CASE WHEN k % 4 = 1 THEN k::VARCHAR END AS arxiv_id FROM r"""


def rescore_run(spark, sf_dir):
    """What has no grade or tags is asked in batches; a run ends after a batch, the next goes on; new texts make vectors stale."""
    k = F.col("doc_id")
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(k % 3 == 0, k % 50).alias("rank_score"), F.col("source").alias("topic"), F.when(k % 4 == 0, "old").alias("summary"), F.when(k % 6 != 0, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    todo = gates.backlog(d, k % 10 == 9, "rank_score", "tags", "doc_id")
    answer = lambda rows, n: rows.select("doc_id", (k % 101 + n).alias("rank_score"), F.when(k % 4 == 1, "new").otherwise(F.col("topic")).alias("topic"), F.when(k % 8 < 6, F.concat(F.lit("s"), _s("doc_id"))).alias("summary"), F.array(F.lit("a")).alias("tags"))
    step = lambda rows: votes.failover(rows, "doc_id", [answer(rows.filter("doc_id % 5 <> 0"), 0), answer(rows.filter("doc_id % 2 = 0"), 200)])
    schema, path = "doc_id long, rank_score long, topic string, summary string, tags array<string>, provider int", _folder(spark)
    size = max(1, -(-todo.count() // 4))
    for budget in (1, None):
        runs.run_batches(todo, "doc_id", [F.col("rank_score").isNotNull()], step, schema, path, size, budget)
    answers = runs.results(spark, path, schema)
    new, stale = runs.applied(d, answers.drop("provider"), "doc_id", ["topic", "summary"])
    told = answers.select("doc_id", "provider").join(stale.withColumn("stale", F.lit(True)), "doc_id", "left")
    return new.join(told, "doc_id", "left").select("doc_id", "rank_score", "topic", "summary", F.array_join("tags", ",").alias("tags"), "provider", F.coalesce("stale", F.lit(False)).alias("stale"))


RESCORE = """WITH d AS (SELECT doc_id AS k, CASE WHEN doc_id % 3 = 0 THEN doc_id % 50 END AS score, source, CASE WHEN doc_id % 4 = 0 THEN 'old' END AS old, CASE WHEN doc_id % 6 <> 0 THEN 't' ELSE '' END AS tags,
          CASE WHEN doc_id % 10 <> 9 AND (doc_id % 3 <> 0 OR doc_id % 6 = 0) THEN CASE WHEN doc_id % 5 <> 0 THEN 0 WHEN doc_id % 2 = 0 THEN 1 END END AS p FROM documents)
    SELECT k AS doc_id, CASE WHEN p IS NULL THEN score ELSE k % 101 + 200 * p END AS rank_score, CASE WHEN p IS NOT NULL AND k % 4 = 1 THEN 'new' ELSE source END AS topic, CASE WHEN p IS NOT NULL AND k % 8 < 6 THEN 's' || k ELSE old END AS summary,
    CASE WHEN p IS NULL THEN tags ELSE 'a' END AS tags, p AS provider, p IS NOT NULL AND ((k % 4 = 1 AND source IS DISTINCT FROM 'new') OR k % 8 < 6) AS stale FROM d"""


def abstract_cascade(spark, sf_dir):
    """Missing abstracts by two services of 50 and 200 keys a request, aligned by position, and then by pages; filled rows'
    vectors go."""
    k = F.col("doc_id")
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(k % 3 == 0, F.lit(" ")).when(k % 3 == 1, F.lit("has one")).alias("abstract"))
    missing = d.filter(text.blank(F.col("abstract")))

    def service(size, value):
        def ask(rows):
            asked = runs.requests(rows, "doc_id", [F.col("doc_id")], size)
            replies = asked.select("request", F.transform("keys", value).alias("values"))
            return runs.by_position(asked, replies, "doc_id", "abstract")
        return ask

    named = lambda name, n: lambda x: F.when(x % n == 0, F.concat(F.lit(name), x.cast("string"))).when(x % n == 1, F.lit("short"))
    pages = lambda rows: rows.filter("doc_id % 7 < 3").select("doc_id", F.concat(F.lit("page abstract "), _s("doc_id")).alias("abstract"))
    found = runs.cascade(missing, "doc_id", "abstract", [service(50, named("first abstract ", 4)), service(200, named("second abstract ", 5)), pages], 10)
    new, stale = runs.applied(d, found.drop("provider"), "doc_id", ["abstract"])
    vectors = read(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id")
    left = sinks.delete_keys(vectors, stale, "doc_id").withColumn("vector", F.lit(True))
    return new.join(found.select("doc_id", "provider"), "doc_id", "left").join(left, "doc_id", "left").select("doc_id", F.trim("abstract").alias("abstract"), "provider", F.coalesce("vector", F.lit(False)).alias("vector"))


CASCADE = """WITH d AS (SELECT doc_id AS k, CASE WHEN doc_id % 3 = 1 THEN NULL WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 5 = 0 THEN 1 WHEN doc_id % 7 < 3 THEN 2 END AS p FROM documents)
    SELECT k AS doc_id, CASE p WHEN 0 THEN 'first abstract ' || k WHEN 1 THEN 'second abstract ' || k WHEN 2 THEN 'page abstract ' || k ELSE CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'has one' END END AS abstract, p AS provider, k % 2 = 0 AND p IS NULL AS vector FROM d"""


def month_redo(spark, sf_dir):
    """The months' ten largest orders; then some months are made anew by another rule, of which one fails and one is empty."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_totalprice")
    path = _folder(spark)
    w = Window.partitionBy("month").orderBy(F.desc("o_totalprice"), "o_orderkey")
    first = o.withColumn("rank", F.row_number().over(w)).filter("rank <= 10")
    sinks.replace_partitions(first, path, "month")

    def build(m):
        rows = o.filter(F.col("month") == m)
        if m == "1996-02":
            return rows.select("o_orderkey", "month", "no such column")
        again = Window.partitionBy("month").orderBy("o_totalprice", "o_orderkey")
        return rows.filter(F.col("month") != "1996-03").withColumn("rank", F.row_number().over(again)).filter("rank <= 5")

    failed = runs.make_months(["1996-01", "1996-02", "1996-03", "1996-04"], build, path)
    told = F.when(F.col("month").isin(*failed), True).otherwise(False)
    return spark.read.schema(first.schema).parquet(path).select("month", F.col("rank").cast("long").alias("rank"), "o_orderkey", told.alias("failed"))


REDO = """WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, o_totalprice FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY o_totalprice DESC, o_orderkey) AS down, row_number() OVER (PARTITION BY month ORDER BY o_totalprice, o_orderkey) AS up FROM o)
    SELECT month, CASE WHEN month IN ('1996-01', '1996-04') THEN up ELSE down END AS rank, o_orderkey, month = '1996-02' AS failed FROM r
    WHERE CASE WHEN month IN ('1996-01', '1996-04') THEN up <= 5 ELSE down <= 10 END"""


def ingest_queue(spark, sf_dir):
    """Events ask for parts by DOI, arXiv id or title; each is accepted once or rejected with a reason."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    records = p.filter("p_partkey % 5 <> 0").select(F.when(k % 2 == 0, F.concat(F.lit("doi:10.1/p"), _s("p_partkey"))).otherwise(F.concat(F.lit("arxiv:2401."), F.lpad(_s("p_partkey"), 5, "0"))).alias("uid"), F.when(k % 7 != 0, F.col("p_name")).alias("title"))
    archive = records.filter(F.substring("uid", -1, 1).isin("2", "3")).select("uid")
    e, i = read(spark, sf_dir, "events"), F.col("event_id") % 1500
    kind = F.when(F.col("event_id") % 13 == 0, "isbn").when(i % 2 == 0, " DOI").otherwise("arxiv")
    value = F.when(F.col("event_id") % 17 == 0, " ").when(i % 2 == 0, F.concat(F.lit("https://doi.org/10.1/P"), i.cast("string"))).otherwise(F.concat(F.lit("2401."), F.lpad(i.cast("string"), 5, "0"), F.lit("v3")))
    good, bad = ingest.ingest(e.select(F.col("event_id").alias("request"), kind.alias("kind"), value.alias("value")), records, archive)
    return good.select("request", "uid", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("request", F.lit(None).cast("string").alias("uid"), "reason"))


QUEUE = """WITH e AS (SELECT event_id AS request, event_id % 1500 AS i, p_partkey AS k FROM events LEFT JOIN part ON p_partkey = event_id % 1500 AND p_partkey % 5 <> 0),
    r AS (SELECT *, CASE WHEN i % 2 = 0 THEN 'doi:10.1/p' || i ELSE 'arxiv:2401.' || lpad(i::VARCHAR, 5, '0') END AS uid,
          CASE WHEN request % 13 = 0 THEN 'bad kind' WHEN request % 17 = 0 THEN 'empty' WHEN k IS NULL THEN 'not found' WHEN k % 7 = 0 THEN 'no title' WHEN i % 10 IN (2, 3) THEN 'already held' END AS reason FROM e),
    o AS (SELECT *, row_number() OVER (PARTITION BY uid, reason IS NULL ORDER BY request) AS n FROM r)
    SELECT request, CASE WHEN reason IS NULL AND n = 1 THEN uid END AS uid, coalesce(reason, CASE WHEN n > 1 THEN 'repeated' END) AS reason FROM o"""


def passage_manifest(spark, sf_dir):
    """Passages of documents written by bucket, and the manifest of what was committed."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    parts = passages.fold(d.withColumn("section", F.lit("body")), "doc_id", "section", "pos", "line")
    path = _folder(spark)
    portal.write_passages(parts, "doc_id", path, 16)
    return portal.manifest(spark, path, "doc_id long")


def _manifest_sql() -> str:
    from .views import PASSAGES

    return f"SELECT doc_id, count(*) AS n_passages, sum(words)::BIGINT AS n_words FROM ({PASSAGES}) GROUP BY doc_id"


QUERIES = {
    "paged_papers": (paged_papers, PAGED), "prefix_works": (prefix_works, PREFIX), "keyword_papers": (keyword_papers, KEYWORD), "rescore_run": (rescore_run, RESCORE), "abstract_cascade": (abstract_cascade, CASCADE),
    "month_redo": (month_redo, REDO), "ingest_queue": (ingest_queue, QUEUE), "passage_manifest": (passage_manifest, _manifest_sql()),
}

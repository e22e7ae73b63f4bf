"""Queries of the readers of feeds and records: Spark writes the tables' rows as files of each format, the readers read them.

The SQL states what the readers have to make of the rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.sources import collect, readers

from .items import read
from .running import _folder, _s


#: Rows that a task writes into files by folder.
WRITTEN = 50_000


def _dealt(rows, *keys):
    """Rows with their few columns dealt by range, folder first, before they are made wide: whoever writes files by folder
    sorts all that a task holds, and a task of a small, well compressed table holds any number of rows."""
    return rows.repartitionByRange(1 + rows.count() // WRITTEN, *keys)


def feed_items(spark, sf_dir):
    """Documents as feeds, one folder for each source: as a mailing list without a cutoff, and as a blog since a day."""
    k = F.col("doc_id")
    link = F.when(k % 3 == 0, F.concat(F.lit("https://x.org/?u=RePEc:arx:papers:2401."), F.lpad((k % 100000).cast("string"), 5, "0"))).otherwise(F.concat(F.lit("https://x.org/"), _s("doc_id")))
    told = F.concat(F.lit("<p>"), F.coalesce("lang", F.lit("?")), F.lit(" \n "), F.repeat(F.lit("word "), 200), _s("doc_id"), F.lit("</p>"))
    day = F.when(k % 4 != 0, F.concat(F.lit("Mon, "), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit(" Feb 2024 10:00:00 GMT")))
    rows = read(spark, sf_dir, "documents").select(F.concat(F.lit("<b>Report</b> &  "), _s("doc_id")).alias("title"), link.alias("link"), told.alias("description"), day.alias("pubDate"), F.coalesce("source", F.lit("no source+%")).alias("code"))
    path = _folder(spark)
    rows.write.partitionBy("code").format("xml").option("rowTag", "item").save(path)
    both = readers.rss(spark, path, readers.from_folder("code", "list-"), "1", most=None).unionByName(readers.rss(spark, path, "blog", "4", "2024-02-15"))
    return both.select("source", "section", "title", "url", "date", "arxiv_id", F.length("abstract").cast("long").alias("n"), F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"))


FEED = """WITH d AS (SELECT doc_id AS k, coalesce(lang, '?') || ' ' || repeat('word ', 200) || doc_id AS abstract, coalesce(source, 'no source+%') AS code, CASE WHEN doc_id % 4 <> 0 THEN '2024-02-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') ELSE '' END AS date FROM documents),
    b AS (SELECT 'list-' || code AS source, '1' AS section, abstract, k, date FROM d UNION ALL SELECT 'blog', '4', substring(abstract, 1, 600), k, date FROM d WHERE date = '' OR date >= '2024-02-15')
    SELECT source, section, 'Report & ' || k AS title, CASE WHEN k % 3 = 0 THEN 'https://x.org/?u=RePEc:arx:papers:2401.' || lpad((k % 100000)::VARCHAR, 5, '0') ELSE 'https://x.org/' || k END AS url, date,
    CASE WHEN k % 3 = 0 THEN '2401.' || lpad((k % 100000)::VARCHAR, 5, '0') END AS arxiv_id, length(abstract)::BIGINT AS n, md5(abstract) AS abstract_md5 FROM b"""


def atom_entries(spark, sf_dir):
    """Documents as entries of an Atom reply: the newest 200 since a day, four authors each."""
    k = F.col("doc_id") % 100000
    people = F.transform(F.array(*[F.lit(x) for x in "ABCDEF"]), lambda a: F.struct(a.alias("name")))
    rows = read(spark, sf_dir, "documents").select(F.concat(F.lit("http://arxiv.org/abs/2401."), F.lpad(k.cast("string"), 5, "0"), F.lit("v1")).alias("id"), F.concat(F.lit("On\n  "), k.cast("string")).alias("title"), F.lit(" <i>s</i> ").alias("summary"),
                                                   F.concat(F.lit("2024-02-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T01:00:00Z")).alias("published"), people.alias("author"))
    path = _folder(spark)
    rows.write.format("xml").option("rowTag", "entry").save(path)
    return readers.atom(spark, path, "arxiv", "2", "2024-02-10").select("title", "authors", "abstract", "url", "date", "arxiv_id", "source", "section")


ATOM = """WITH d AS (SELECT doc_id % 100000 AS k, lpad((doc_id % 100000)::VARCHAR, 5, '0') AS n FROM documents), e AS (SELECT *, '2024-02-' || lpad((k % 28 + 1)::VARCHAR, 2, '0') AS date, 'http://arxiv.org/abs/2401.' || n || 'v1' AS url FROM d)
    SELECT 'On ' || k AS title, 'A, B, C, D' AS authors, 's' AS abstract, url, date, '2401.' || n AS arxiv_id, 'arxiv' AS source, '2' AS section FROM e WHERE date >= '2024-02-10' ORDER BY date DESC, url LIMIT 200"""


def practitioner_journals(spark, sf_dir):
    """Orders as works of journals: the newest 30 of three of them; pages are fetched for what isn't archived."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.array(F.array(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")))
    person = lambda a: F.struct(F.when(a != "C", a).alias("given"), F.concat(F.lit("x"), a).alias("family"))
    works = _dealt(o.select("o_orderkey", "o_orderdate", "o_orderpriority"), "o_orderpriority", "o_orderkey").select(F.concat(F.lit("10.1/X"), _s("o_orderkey")).alias("DOI"), F.array(F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit("On "), _s("o_orderkey")))).alias("title"), F.transform(F.array(*[F.lit(x) for x in "ABCDE"]), person).alias("author"),
                     F.when(k % 3 == 0, F.concat(F.lit("<jats:p>Abs "), _s("o_orderkey"), F.lit("</jats:p>"))).alias("abstract"), (k % 40).cast("int").alias("is-referenced-by-count"), F.when(k % 4 != 0, F.struct(day.alias("date-parts"))).alias("published"),
                     F.struct(day.alias("date-parts")).alias("created"), F.col("o_orderpriority").alias("label"))
    path = _folder(spark)
    works.write.partitionBy("label").json(path)
    found = readers.crossref(spark, path, readers.from_folder("label", "journal:"))
    journals = o.select(F.concat(F.lit("journal:"), "o_orderpriority").alias("label")).distinct().filter("substring(label, 9, 1) in ('1', '3', '4')")
    archive = o.filter("o_orderkey % 2 = 0").select(F.concat(F.lit("doi:10.1/x"), _s("o_orderkey")).alias("uid"))
    pages = lambda asked: asked.filter("cites % 5 <> 0").select("url", F.concat(F.lit("page of "), "title").alias("abstract"))
    return collect.practitioner(found, journals, archive, "uid", pages).select("doi", "title", "authors", "abstract", "url", "date", "source", "tier", F.col("cites").cast("long").alias("cites"))


PRACTITIONER = """WITH o AS (SELECT *, o_orderkey AS k, 'On ' || o_orderkey AS title FROM orders WHERE o_orderkey % 11 <> 0 AND substring(o_orderpriority, 1, 1) IN ('1', '3', '4')),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, title) AS n FROM o)
    SELECT '10.1/x' || k AS doi, title, 'A xA, B xB, xC, D xD' AS authors, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 3 = 0 THEN 'Abs ' || k ELSE '' END WHEN k % 5 <> 0 THEN 'page of ' || title ELSE '' END AS abstract, 'https://doi.org/10.1/X' || k AS url,
    strftime(o_orderdate, '%Y-%m-%d') AS date, 'journal:' || o_orderpriority AS source, 'T2' AS tier, k % 40 AS cites FROM r WHERE n <= 30"""


def repositories(spark, sf_dir):
    """Parts as works of repositories: some are known by id, some are found by name, some aren't found."""
    p, k = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), F.col("p_partkey")
    person = F.struct(F.struct(F.concat(F.lit("https://openalex.org/A"), _s("p_partkey")).alias("id"), F.lit("N N").alias("display_name")).alias("author"))
    works = _dealt(p, "p_brand", "p_partkey").select(F.concat(F.lit("https://openalex.org/W"), _s("p_partkey")).alias("id"), F.concat(F.lit("https://doi.org/10.5/Q"), _s("p_partkey")).alias("doi"), F.col("p_name").alias("title"), F.lit(2023).alias("publication_year"),
                     F.when(k % 4 != 0, F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).alias("publication_date"), F.when(k % 3 == 0, (k % 9).cast("int")).alias("cited_by_count"), F.array(*[person] * 5).alias("authorships"),
                     F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2))).alias("abstract_inverted_index"), F.col("p_brand").alias("repository"))
    path = _folder(spark)
    works.write.partitionBy("repository").json(path)
    found = readers.openalex(spark, path, readers.from_folder("repository"), "3").withColumn("repository", F.col("source"))
    brands, last = p.select("p_brand").filter("p_brand is not null").distinct(), F.substring("p_brand", -1, 1)
    wanted = brands.select(F.concat(F.lit("Repo "), "p_brand").alias("label"), F.when(last.isin("2", "4"), F.col("p_brand")).alias("id"))
    hit = brands.select(F.concat(F.lit("Repo "), "p_brand").alias("label"), F.lit(1).alias("place"), F.concat(F.lit("The REPO "), "p_brand", F.lit(" of all")).alias("name"), F.concat(F.lit("https://openalex.org/"), "p_brand").alias("id"))
    hits = hit.filter(~last.isin("3")).unionByName(hit.withColumns({"place": F.lit(0), "name": F.lit("Another"), "id": F.lit("none")}))
    return collect.repositories(found, wanted, hits).select("title", "authors", "abstract", "url", "date", "source", "doi", F.col("cites").cast("long").alias("cites"), F.array_join("oa_author_ids", ",").alias("ids"))


REPOSITORIES = """WITH p AS (SELECT *, p_partkey AS k, CASE WHEN p_partkey % 4 <> 0 THEN '2024-01-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') ELSE '2023-01-01' END AS date, 'https://doi.org/10.5/Q' || p_partkey AS url FROM part WHERE right(p_brand, 1) <> '3'),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY date DESC, p_name, url) AS n FROM p)
    SELECT p_name AS title, 'N N, N N, N N, N N' AS authors, 'a b a' AS abstract, url, date, 'Repo ' || p_brand || ' (via OpenAlex)' AS source, '10.5/q' || k AS doi, CASE WHEN k % 3 = 0 THEN k % 9 ELSE 0 END::BIGINT AS cites,
    'A' || k || ',A' || k || ',A' || k || ',A' || k AS ids FROM r WHERE n <= 100"""


def archive_rows(spark, sf_dir):
    """Documents as archived rows, of which some have no record or one that can't be read."""
    k = F.col("doc_id")
    meta = F.when(k % 7 == 0, None).when(k % 5 == 0, F.concat(F.lit('{"n": '), _s("doc_id"))).otherwise(F.concat(F.lit('{"n": '), _s("doc_id"), F.lit(', "tags": ["a", null]}')))
    path = _folder(spark)
    read(spark, sf_dir, "documents").select("doc_id", meta.alias("meta")).write.parquet(path)
    return readers.archive(spark, path).select("doc_id", F.try_variant_get("meta", "$.n", "long").alias("n"), F.try_variant_get("meta", "$.tags[0]", "string").alias("tag"))


ARCHIVE = "SELECT doc_id, doc_id AS n, 'a' AS tag FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0"

QUERIES = {
    "feed_items": (feed_items, FEED), "atom_entries": (atom_entries, ATOM), "practitioner_journals": (practitioner_journals, PRACTITIONER), "repositories": (repositories, REPOSITORIES), "archive_rows": (archive_rows, ARCHIVE),
}

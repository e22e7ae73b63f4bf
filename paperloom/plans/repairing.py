"""Queries of repair by provenance: classics without a DOI, working papers of closed articles, links to full texts.

Documents stand for works; replies of services are made from their ids, abstracts from their texts.  The SQL states the
rule itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import repair

from .items import read

def _s(head="", tail=""):
    return F.concat(F.lit(head), F.col("doc_id").cast("string"), F.lit(tail))


def _works(spark, sf_dir):
    k = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        "doc_id", "text", _s("Collected letters, volume ").alias("title"), (1900 + k % 100).alias("year"), (k % 4 != 0).alias("classic"), F.when(k % 3 == 0, _s("10.9/")).alias("doi"),
        F.when(k % 5 != 0, _s("u")).alias("url"), F.when(k % 7 == 0, "old").alias("abstract"), F.lit("").alias("authors"), F.lit("old").alias("journal"), F.lit(None).cast("long").alias("cites"))


def _repaired(spark, sf_dir):
    k = F.col("doc_id")
    works = _works(spark, sf_dir)
    right = works.filter("doc_id % 6 < 4").select(
        "doc_id", F.lit(1).alias("place"), F.upper("title").alias("title"), (F.col("year") + k % 9 - 4).alias("year"), _s("10.7/").alias("doi"), F.when(k % 10 < 5, _s("<p>ab  ", "</p>")).alias("abstract"),
        _s("A ").alias("authors"), F.when(k % 2 == 0, "new").alias("journal"), (k % 50).alias("cites"))
    wrong = right.filter("doc_id % 2 = 0").withColumns({"place": F.lit(0), "title": F.lit("Another work"), "doi": F.lit("10.7/wrong")})
    index = works.filter("doc_id % 13 < 9").select("doc_id", F.lit(0).alias("place"), F.concat("title", F.lit(": a reader")).alias("title"), F.when(k % 8 != 0, F.col("year")).alias("year"),
                                                   _s("https://doi.org/10.8/").alias("doi"), F.when(k % 11 < 8, F.col("text")).alias("abstract"))
    return repair.repair_classics(works.drop("text"), "doc_id", right.unionByName(wrong), index)


def classics_repair(spark, sf_dir):
    """Classics by two services, with the source of every field that was filled."""
    new, found = _repaired(spark, sf_dir)
    told = F.array_join(F.transform(F.array_sort(F.map_entries("filled_by")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return new.join(found.select("doc_id", told.alias("filled_by")), "doc_id", "left").select("doc_id", "doi", "url", F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"), "authors", "journal", "cites", "filled_by")


_REPAIR = """WITH d AS (SELECT doc_id AS k, text, doc_id % 4 <> 0 AND doc_id % 3 <> 0 AS broken FROM documents),
    a AS (SELECT *, broken AND k % 6 < 4 AND k % 9 NOT IN (0, 8) AS r FROM d), b AS (SELECT *, r AND k % 10 < 5 AS ra, broken AND NOT (r AND k % 10 < 5) AND k % 13 < 9 AS i FROM a),
    c AS (SELECT *, i AND NOT r AS idoi, coalesce(i AND k % 11 < 8 AND text <> '', false) AS ia, r AND k % 5 = 0 AS ru FROM b)"""
REPAIR = _REPAIR + """
    SELECT k AS doc_id, CASE WHEN r THEN '10.7/' || k WHEN idoi THEN '10.8/' || k WHEN k % 3 = 0 THEN '10.9/' || k END AS doi, CASE WHEN ru THEN 'https://doi.org/10.7/' || k WHEN k % 5 <> 0 THEN 'u' || k END AS url,
    md5(CASE WHEN ra THEN 'ab ' || k WHEN ia THEN substring(text, 1, 6000) WHEN k % 7 = 0 THEN 'old' END) AS abstract_md5, CASE WHEN r THEN 'A ' || k ELSE '' END AS authors, CASE WHEN r AND k % 2 = 0 THEN 'new' ELSE 'old' END AS journal,
    CASE WHEN r THEN k % 50 END AS cites, CASE WHEN broken THEN array_to_string(list_filter([CASE WHEN ra THEN 'abstract=registry' WHEN ia THEN 'abstract=index' END, CASE WHEN r THEN 'authors=registry' END, CASE WHEN r THEN 'cites=registry' END,
    CASE WHEN r THEN 'doi=registry' WHEN idoi THEN 'doi=index' END, CASE WHEN r AND k % 2 = 0 THEN 'journal=registry' END, CASE WHEN ru THEN 'url=registry' END], lambda x: x IS NOT NULL), ',') END AS filled_by FROM c"""


def repair_rates(spark, sf_dir):
    """How many of the classics without a DOI were repaired, and which fields they gained."""
    return repair.rates(_repaired(spark, sf_dir)[1], ["doi", "abstract", "url"])


RATES = _REPAIR + """
    SELECT count(*) AS wanted, count(*) FILTER (r OR idoi OR ia) AS fixed, count(*) FILTER (r OR idoi) AS gained_doi, count(*) FILTER (ra OR ia) AS gained_abstract, count(*) FILTER (ru) AS gained_url FROM c WHERE broken"""


def _probed(spark, sf_dir):
    k = F.col("doc_id")
    works = _works(spark, sf_dir)
    failed = works.filter("classic and doc_id % 3 = 1").select("doc_id", "title", F.when(k % 5 != 0, F.lit("Jane Roe, J. Doe and Ann Li")).alias("authors"), F.when(k % 6 != 4, F.col("year")).cast("string").alias("year"))
    own = works.filter("doc_id % 7 = 0").select(F.upper("title").alias("title"), _s("w").alias("wp"), F.lit(0).alias("place"))
    own = own.unionByName(own.filter("cast(substring(wp, 2) as long) % 2 = 0").withColumns({"wp": F.concat("wp", F.lit("9")), "place": F.lit(1)}))
    hit = works.select("doc_id", F.lit(0).alias("place"), F.concat("title", F.lit(" (working paper)")).alias("title"), (F.col("year") - k % 11).alias("year"), F.when(k % 2 == 0, F.array(F.lit("Doe"))).when(k % 8 == 1, F.array(F.lit("Poe"))).alias("names"), F.lit("").alias("pdf"))
    hits = hit.unionByName(hit.withColumns({"place": F.lit(2), "pdf": _s("p2/")})).unionByName(hit.withColumns({"place": F.lit(1), "pdf": _s("p1/"), "title": F.lit("Another work")}))
    heads = works.select(_s("p2/").alias("url"), F.when(k % 4 != 1, F.lit("%PDF-1.7")).otherwise("<html>").cast("binary").alias("head"))
    return repair.working_papers(failed, "doc_id", own, hits, heads)


def working_paper_probe(spark, sf_dir):
    """Working papers of articles without a reachable file, by title in the archive, then by every hit of a search."""
    return _probed(spark, sf_dir)


_PROBE = """WITH f AS (SELECT doc_id AS k, doc_id % 11 <= 6 AND doc_id % 6 <> 4 AS near, doc_id % 5 <> 0 AND (doc_id % 2 = 0 OR doc_id % 8 = 1) AS named, doc_id % 6 = 4 AS undated FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 3 = 1),
    p AS (SELECT k, CASE WHEN k % 7 = 0 THEN 'archive' WHEN near OR CASE WHEN named THEN k % 2 = 0 ELSE undated END THEN 'open copy' END AS route FROM f),
    r AS (SELECT k AS doc_id, CASE route WHEN 'archive' THEN 'https://www.nber.org/system/files/working_papers/w' || n || '/w' || n || '.pdf' WHEN 'open copy' THEN 'p2/' || k END AS url, route, coalesce(route = 'open copy' AND k % 4 <> 1, false) AS verified
          FROM (SELECT *, k || CASE WHEN k % 2 = 0 THEN '9' ELSE '' END AS n FROM p))"""
PROBE = _PROBE + " SELECT * FROM r"


def probe_rate(spark, sf_dir):
    return repair.hit_rate(_probed(spark, sf_dir))


PROBE_RATE = _PROBE + " SELECT count(*) AS probed, count(*) FILTER (verified) AS hits, 100.0::DOUBLE * count(*) FILTER (verified) / count(*) AS percent FROM r"


def free_copies(spark, sf_dir):
    """Links by key and page, by title, and by DOI through three routes, of which each sees what is still missing."""
    k = F.col("doc_id")
    works = _works(spark, sf_dir)
    uid = F.when(k % 10 == 0, _s("arxiv:24")).when(k % 10 < 5, _s("doi:10.1/A")).otherwise(_s("t:"))
    url = F.when(k % 20 == 1, _s("HTTPS://arXiv.org/abs/25", "?x=1")).when(k % 20 == 2, _s("RePEc:arx:papers:26.")).when(k % 20 == 3, _s("https://nber.org/papers/w")).when(k % 20 == 4, _s("f", ".PDF?x"))
    items = works.select("doc_id", uid.alias("uid"), url.alias("url"), F.when(k % 30 == 5, "short").otherwise(F.col("title")).alias("title"), F.when(k % 10 == 6, _s(" 10.1/B")).alias("doi"))
    named = items.filter("doc_id % 10 > 4").select("uid", F.when(k % 3 == 0, _s("t/")).otherwise("").alias("pdf"), _s("https://doi.org/10.1/c").alias("doi"))
    ids = works.select(k, F.explode(F.array(_s("10.1/a"), _s("10.1/b"), _s("10.1/C"))).alias("doi"))
    made = lambda name, n: (name, ids.filter(f"doc_id % {n} = 0").select("doi", F.lit(1).alias("place"), F.concat(F.lit(f"{name}/"), "doi").alias("pdf")).unionByName(ids.select("doi", F.lit(0).alias("place"), F.lit("").alias("pdf"))))
    found = repair.free_copies(items, "uid", named, [made("first", 2), made("second", 3), made("third", 7)])
    return items.join(found, "uid").select("doc_id", "link", "route")


FREE = """WITH d AS (SELECT doc_id AS k, CASE WHEN doc_id % 10 BETWEEN 1 AND 4 THEN '10.1/a' || doc_id WHEN doc_id % 10 = 6 THEN '10.1/b' || doc_id WHEN doc_id % 10 > 4 AND doc_id % 30 <> 5 AND doc_id % 3 <> 0 THEN '10.1/C' || doc_id END AS id,
              CASE WHEN doc_id % 10 = 0 THEN 'https://arxiv.org/pdf/24' || doc_id WHEN doc_id % 20 = 1 THEN 'https://arxiv.org/pdf/25' || doc_id WHEN doc_id % 20 = 2 THEN 'https://arxiv.org/pdf/26.' || doc_id
              WHEN doc_id % 20 = 3 THEN 'https://www.nber.org/system/files/working_papers/w' || doc_id || '/w' || doc_id || '.pdf' WHEN doc_id % 20 = 4 THEN 'f' || doc_id || '.PDF?x' END AS own FROM documents),
    r AS (SELECT *, CASE WHEN own IS NOT NULL THEN 'derived' WHEN k % 10 > 4 AND k % 10 <> 6 AND k % 30 <> 5 AND k % 3 = 0 THEN 'title' WHEN id IS NULL THEN NULL WHEN k % 2 = 0 THEN 'first' WHEN k % 3 = 0 THEN 'second' WHEN k % 7 = 0 THEN 'third' END AS route FROM d)
    SELECT k AS doc_id, CASE route WHEN 'derived' THEN own WHEN 'title' THEN 't/' || k ELSE route || '/' || id END AS link, route FROM r"""

QUERIES = {
    "classics_repair": (classics_repair, REPAIR), "repair_rates": (repair_rates, RATES), "working_paper_probe": (working_paper_probe, PROBE), "probe_rate": (probe_rate, PROBE_RATE), "free_copies": (free_copies, FREE),
}

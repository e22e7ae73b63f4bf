"""Queries of collectors, look-ups, dates, labels and the portal's records.

Fields that the tables lack are made from ids; the SQL states the rule itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import dates, display, parse, text
from paperloom.operators import gates, portal, retrieval, roster, state
from paperloom.sources import collect, lookup

from .items import read


def _s(c):
    return F.col(c).cast("string")


def tiered(spark, sf_dir):
    """Orders as items of their priorities' journals."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("date"), F.col("o_orderstatus").alias("title"), _s("o_orderkey").alias("url"))
    journals = o.select("source").distinct().filter("source <> '5-LOW'").select(F.col("source").alias("label"), F.when(F.col("source") < "3", "T1").otherwise("T2").alias("tier"))
    return collect.tiered(o, journals, "source", "label", "tier", "date", 25).select("source", "tier", "url")


TIERED = """SELECT o_orderpriority AS source, CASE WHEN o_orderpriority < '3' THEN 'T1' ELSE 'T2' END AS tier, o_orderkey::VARCHAR AS url FROM orders WHERE o_orderpriority <> '5-LOW'
    QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderstatus, o_orderkey::VARCHAR) <= 25"""


def topics(spark, sf_dir):
    """Brands as search terms, parts as hits."""
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("term"), F.col("p_retailprice").alias("score"), F.when(F.col("p_size") > 20, "econ").otherwise("law").alias("field"), F.col("p_partkey").alias("id"))
    found, rest = collect.resolve_topics(p, "term", "score", "field", "econ", 1000)
    return found.select("term", F.col("id").cast("long").alias("id")).unionByName(rest.withColumn("id", F.lit(None).cast("long")))


TOPICS = """WITH b AS (SELECT p_brand AS term, p_retailprice AS score, CASE WHEN p_size > 20 THEN 'econ' ELSE 'law' END AS field, p_partkey AS id FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1)
    SELECT term, CASE WHEN field = 'econ' AND score >= 1000 THEN id END::BIGINT AS id FROM b"""
TERMS = ["tion", "keit", "ment"]


def sweep(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "text", F.col("source").alias("topic"), (F.col("doc_id") % 100).alias("date"))
    wanted = spark.createDataFrame([("web",), ("code",)], "topic string")
    return collect.topic_sweep(d, wanted, TERMS, F.col("text"), "topic", "date", 10).select("uid", "term")


SWEEP = "SELECT doc_id AS uid, NULL AS term FROM documents WHERE source IN ('web', 'code') UNION ALL " + " UNION ALL ".join(
    f"SELECT * FROM (SELECT doc_id, '{t}' FROM documents WHERE contains(lower(text), '{t}') ORDER BY doc_id % 100 DESC, doc_id LIMIT 10)" for t in TERMS)


def author_pull(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("date"), F.col("o_orderkey").alias("uid"))
    own = read(spark, sf_dir, "customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("author"), F.col("c_name").alias("name"))
    return collect.author_pull(o, own, "author", "name", "date", 3).select("uid", "watchlist_author", "watchlist")


PULL = """SELECT o_orderkey AS uid, c_name AS watchlist_author, true AS watchlist FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 7 = 0
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3"""


def author_search(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    who = F.array(F.struct(F.when(F.col("doc_id") % 3 == 0, "J.").when(F.col("doc_id") % 3 == 1, "Jane").otherwise("Joan").alias("given"), F.when(F.col("doc_id") % 2 == 0, "Doe").otherwise("Roe").alias("family")))
    return collect.author_search(d.withColumn("authors", who), "Jane Doe", F.col("text"), TERMS).select("doc_id")


SEARCH = "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 2 AND (" + " OR ".join(f"contains(lower(text), '{t}')" for t in TERMS) + ")"


def month(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).otherwise(" ").alias("title"), _s("o_orderkey").alias("doi"), F.col("o_totalprice").alias("cites"), F.col("o_orderdate").cast("string").alias("date"))
    out = collect.month_candidates(o.filter("source < '4'"), o.filter("source >= '4'"), "1995-03", "date", 15)
    return out.select("source", "doi", "load_order")


MONTH = """WITH o AS (SELECT o_orderpriority AS source, o_orderkey::VARCHAR AS doi, o_totalprice AS cites, o_orderkey % 5 <> 0 AS titled FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-03-01' AND DATE '1995-03-31'),
    j AS (SELECT source, doi FROM o WHERE source < '4' AND titled QUALIFY row_number() OVER (PARTITION BY source ORDER BY cites DESC, doi) <= 15)
    SELECT source, doi, 0 AS load_order FROM j UNION ALL SELECT source, doi, 1 FROM o WHERE source >= '4'"""


def outside(spark, sf_dir):
    """Results of two searches, each once, without what is known."""
    p = read(spark, sf_dir, "part").select(F.upper("p_brand").alias("title"), F.col("p_partkey").alias("id"))
    other = read(spark, sf_dir, "part").filter("p_size > 25").select(F.lower(F.concat("p_brand", F.lit("x"))).alias("title"), F.col("p_partkey").alias("id"))
    both = collect.outside([p, other], "title", "id")
    known = p.filter("title like '%#1%'").select(F.lower("title").alias("title"))
    return retrieval.known_minus(both, known, "title", 40).select("title", "id", "load_order")


OUTSIDE = """WITH u AS (SELECT upper(p_brand) AS title, p_partkey AS id, 0 AS load_order FROM part UNION ALL SELECT lower(p_brand || 'x'), p_partkey, 1 FROM part WHERE p_size > 25),
    o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lower(title) ORDER BY load_order, id) = 1)
    SELECT * FROM o WHERE lower(title) NOT IN (SELECT lower(p_brand) FROM part WHERE p_brand LIKE '%#1%') ORDER BY title LIMIT 40"""


def date_functions(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    k = F.col("o_orderkey")
    parts = F.when(k % 3 == 0, F.array(F.year("d"), F.month("d"), F.day("d"))).when(k % 3 == 1, F.array(F.year("d"))).otherwise(F.array().cast("array<int>"))
    named = F.when(k % 2 == 0, F.date_format("d", "MMMM yyyy")).otherwise("soon")
    as_of = F.lit("2024-02-01").cast("date")
    return o.select("o_orderkey", dates.parts_to_iso(parts).alias("iso"), dates.parts_year(parts).cast("long").alias("year"), dates.month_name_date(named, as_of).cast("string").alias("named"),
                    dates.month_of(F.when(k % 2 == 0, _s("d")), F.lit("2024-02-01")).alias("month"), dates.age_years(F.when(k % 5 == 0, F.year("d")), _s("d"), as_of).cast("long").alias("age"),
                    gates.since(_s("d"), F.lit("1998-07-20").cast("date")).alias("recent"))


DATES = """WITH o AS (SELECT o_orderkey, o_orderkey AS k, o_orderdate::DATE AS d FROM orders)
    SELECT o_orderkey, CASE k % 3 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y') || '-01-01' ELSE '' END AS iso, CASE WHEN k % 3 < 2 THEN year(d) ELSE 0 END::BIGINT AS year,
    CASE WHEN k % 2 = 0 THEN strftime(date_trunc('month', d), '%Y-%m-%d') ELSE '2024-02-01' END AS named, CASE WHEN k % 2 = 0 THEN strftime(d, '%Y-%m') ELSE '2024-02' END AS month, (2024 - year(d))::BIGINT AS age, d >= DATE '1998-06-20' AS recent FROM o"""


def labels(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    source = F.when(k % 4 == 0, F.concat(F.lit("journal:"), "p_brand")).when(k % 4 == 1, F.lit("blog:")).otherwise(F.col("p_brand"))
    return p.select("p_partkey", text.venue_label(F.when(k % 3 == 0, F.col("p_type")), source).alias("venue"), text.source_name(source).alias("source"), text.score_band(k % 100).alias("band"),
                    text.link_title(F.concat("p_type", F.lit("  Save 5 min read May 2024"))).alias("link"), text.slug_title(F.concat(F.lit("https://x.org/a/12-big-"), _s("p_size"), F.lit("_idea.html?q=1"))).alias("slug"),
                    display.escape_html(F.concat(F.lit("<b>\"&"), "p_brand")).alias("escaped"), portal.source_label(F.array(source, F.lit("topic:T"))).alias("sources"), display.depth_label(k % 3 == 0, F.when(k % 2 == 0, F.col("p_brand"))).alias("depth"),
                    gates.research(F.when(k % 5 == 0, "4").when(k % 5 == 1, "2")).alias("research"), gates.potential_classic(F.when(k % 2 == 0, k), F.when(k % 7 == 0, F.lit(15.0))).alias("classic"),
                    gates.candidate_rank(F.when(k % 3 != 0, k % 50), F.concat(F.lit("Dept of "), "p_type"), F.lit("steel or brass dept")).cast("long").alias("rank"))


LABELS = """WITH p AS (SELECT *, p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'journal:' || p_brand WHEN 1 THEN 'blog:' ELSE p_brand END AS s FROM part), n AS (SELECT *, CASE k % 4 WHEN 1 THEN 'Other' ELSE p_brand END AS name FROM p)
    SELECT p_partkey, CASE WHEN k % 3 = 0 THEN p_type WHEN k % 4 = 0 THEN p_brand ELSE s END AS venue, name AS source, CASE WHEN k % 100 >= 70 THEN 'high' WHEN k % 100 >= 45 THEN 'middle' ELSE 'low' END AS band,
    p_type AS link, 'Big ' || p_size || ' Idea' AS slug, '&lt;b&gt;&quot;&amp;' || p_brand AS escaped, name || ', T' AS sources, CASE WHEN k % 3 = 0 THEN 'full' WHEN k % 2 = 0 THEN 'abstract' ELSE 'summary_only' END AS depth,
    k % 5 <> 0 AS research, k % 7 = 0 OR (k % 2 = 0 AND k >= 400) AS classic, (CASE WHEN k % 3 <> 0 THEN k % 50 ELSE 0 END + CASE WHEN contains(lower(p_type), 'steel') THEN 2 ELSE 0 END + CASE WHEN contains(lower(p_type), 'brass') THEN 2 ELSE 0 END + 2)::BIGINT AS rank FROM n"""


def inverted(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "event_type")
    index = F.create_map(F.col("event_type"), F.array(F.lit(0), F.lit(3)), F.lit("and"), F.array(F.lit(1)), F.concat(F.lit("n"), (F.col("event_id") % 5).cast("string")), F.array(F.lit(2)))
    return e.select("event_id", text.from_inverted_index(index).alias("text"))


INVERTED = "SELECT event_id, event_type || ' and n' || (event_id % 5) || ' ' || event_type AS text FROM events"


def resolved(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    rows = c.select(F.concat(F.lit("N"), (F.col("c_custkey") % 40).cast("string")).alias("name"), F.col("c_custkey").alias("pos"), (F.col("c_custkey") % 17).alias("h_index"), F.col("c_mktsegment").alias("affiliation"), F.lit("machinery building").alias("hint"),
                    F.array(F.lit("x"), F.when(F.col("c_custkey") % 3 == 0, "econ").otherwise("y"), F.lit("z"), F.lit("econ")).alias("fields"))
    return roster.resolve_authors(rows, "name", "fields", ["econ"]).select("name", "pos")


RESOLVED = """SELECT 'N' || (c_custkey % 40) AS name, c_custkey AS pos FROM customer WHERE c_custkey % 3 = 0
    QUALIFY row_number() OVER (PARTITION BY c_custkey % 40 ORDER BY c_custkey % 17 + CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 2 ELSE 0 END DESC, c_custkey) = 1"""


def indexed(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Ann N"), F.translate((F.col("c_custkey") % 60).cast("string"), "0123456789", "abcdefghij")).alias("name"))
    return roster.index(c, "name", "c_custkey").select("c_custkey", "name")


INDEXED = "SELECT max(c_custkey) AS c_custkey, 'Ann N' || translate((c_custkey % 60)::VARCHAR, '0123456789', 'abcdefghij') AS name FROM customer GROUP BY c_custkey % 60"


def run_state(spark, sf_dir):
    """Whether runs are due, and the month a backfill works on, for each user."""
    e = read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"))
    due = e.select("event_id", state.due(F.when(F.col("event_id") % 9 == 0, "never").when(F.col("event_id") % 9 != 1, F.col("t")), F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("due"))
    p = read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct().withColumn("done", F.col("month") != "1996-05")
    return due.crossJoin(F.broadcast(state.next_month(p, "month", "done", "1999-01", "1990-01")))  # one row


RUN_STATE = """SELECT event_id, CASE WHEN event_id % 9 < 2 THEN true ELSE date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-01-20') >= 68 * 3600 END AS due, '1996-05' AS month FROM events"""


def needs_abstract(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(" ").alias("abstract"))
    return collect.needs_abstract(d, d.filter("doc_id % 4 = 0"), "doc_id", "abstract").select("doc_id").unionByName(lookup.long_abstracts(d, "abstract", 60).select((-F.col("doc_id")).alias("doc_id")))


NEEDS = r"""SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 AND (doc_id % 3 <> 0 OR trim(text) = '') UNION ALL SELECT -doc_id FROM documents WHERE doc_id % 3 = 0 AND len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) >= 60"""


def citations(spark, sf_dir):
    """Records by id, and what they fill in items that lack citations or an h-index."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    records = p.select(F.concat(F.lit("10.1/A"), (k % 500).cast("string")).alias("doi"), F.lit("x").alias("abstract"), F.col("p_size").alias("cites"), F.array(k % 7, k % 11).alias("hs"), (2000 + k % 20).alias("year"))
    found = lookup.by_ids(records, p.filter("p_partkey % 2 = 0").select(F.concat(F.lit("10.1/a"), _s("p_partkey")).alias("doi")), "doi")
    items = p.select("p_partkey", F.concat(F.lit("10.1/a"), _s("p_partkey")).alias("doi"), F.when(k % 3 == 0, k).alias("cites"), F.lit(None).cast("long").alias("year"), F.when(k % 5 != 0, F.lit(1)).alias("h"))
    return lookup.fill_citations(items, found, "doi", "cites", "year", "h").select("p_partkey", F.col("cites").cast("long").alias("cites"), F.col("year").cast("long").alias("year"))


CITATIONS = """WITH r AS (SELECT p_partkey % 500 AS i, p_size AS cites, 2000 + p_partkey % 20 AS year FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey % 500 ORDER BY p_size DESC, 2000 + p_partkey % 20) = 1)
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE r.cites END::BIGINT AS cites, r.year::BIGINT AS year FROM part LEFT JOIN r ON p_partkey = r.i AND p_partkey % 2 = 0 AND (p_partkey % 3 <> 0 OR p_partkey % 5 = 0)"""


def updated(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("cites"))
    found = p.filter("p_partkey % 4 = 0").select(F.concat(F.lit("10.3386/W"), _s("p_partkey")).alias("doi"), (F.col("cites") * 10).alias("cites"))
    return lookup.update_citations(p, found, F.concat(F.lit("10.3386/w"), _s("p_partkey")), "cites")


UPDATED = "SELECT p_partkey, p_size * CASE WHEN p_partkey % 4 = 0 THEN 10 ELSE 1 END::BIGINT AS cites FROM part"


def titled(spark, sf_dir):
    """Hits of title searches: by title and year, by name, by the length of the title."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("The very long title of part "), _s("p_partkey")).alias("title"), F.lit(2000).alias("year"))
    hits = p.select("k", F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(x).alias("tail")) for i, x in enumerate([" x", ": a study", ""])])).alias("h"), "title")
    hits = hits.select("k", F.when(F.col("h.pos") == 0, "other").otherwise(F.concat("title", "h.tail")).alias("title"), (2000 + F.col("k") % 5 + F.col("h.pos")).alias("year"), "h.pos", F.concat(_s("k"), F.lit("-"), _s("h.pos")).alias("id"))
    return lookup.by_title(p, hits, "k").select("k", "id")


TITLED = "SELECT p_partkey AS k, p_partkey || '-1' AS id FROM part WHERE p_partkey % 5 <= 2"


def first_hits(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.upper("p_type").alias("query"), F.concat("p_brand", F.lit(" by "), F.lower("p_type")).alias("name"), "p_partkey")
    a = lookup.first_named(p, "query", "name", "p_partkey").select(F.col("query").alias("of"), F.col("p_partkey").alias("id"))
    t = read(spark, sf_dir, "part").select(F.col("p_brand").alias("title"), F.when(F.col("p_size") > 40, "pdf").alias("link"), "p_partkey")
    b = lookup.title_to_id(t, "title", "link", "p_partkey", 8)
    return a.unionByName(b.select(F.col("title").alias("of"), F.col("p_partkey").alias("id")))


FIRST_HITS = """SELECT upper(p_type) AS of, min(p_partkey) AS id FROM part GROUP BY 1 UNION ALL
    SELECT p_brand, p_partkey FROM part WHERE length(p_brand) >= 8 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size <= 40, p_partkey) = 1"""


def canon_authors(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    works = c.select(F.when(F.col("c_custkey") % 2 == 0, "Lee").otherwise("Roe").alias("surname"), F.col("c_custkey").alias("pos"), F.array(F.struct(F.lit(-1).cast("long").alias("author_id"), F.lit("Bo Zen").alias("name")), F.struct(F.col("c_custkey").alias("author_id"), F.when(F.col("c_custkey") > 20, "Ann LEE").otherwise("Al Roe").alias("name"))).alias("authors"))
    return lookup.authors_of(spark.createDataFrame([("Lee",), ("Roe",), ("Ode",)], "surname string"), works, "surname")


CANON_AUTHORS = "SELECT 'Lee' AS surname, min(c_custkey) AS author_id, 'Ann LEE' AS name FROM customer WHERE c_custkey % 2 = 0 AND c_custkey > 20 UNION ALL SELECT 'Roe', min(c_custkey), 'Al Roe' FROM customer WHERE c_custkey % 2 = 1 AND c_custkey <= 20"


def watched(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    rows = d.select(i.alias("uid"), (i % 3 == 0).alias("watched"), F.when(i % 5 != 0, F.when(i % 5 == 1, "off_topic").otherwise("core_fit")).alias("category"), F.when(i % 7 == 0, "4").otherwise("1").alias("section"), F.concat(F.lit("u"), (i % 40).cast("string")).alias("url"), (i % 90).alias("date"))
    return portal.watched_feed(rows, "watched", "category", "section", "url", "date").select("uid", "url")


WATCHED = """SELECT doc_id AS uid, 'u' || (doc_id % 40) AS url FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 > 1 AND doc_id % 7 <> 0
    QUALIFY row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id % 90 DESC, doc_id) = 1"""


def month_listing(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), "o_orderdate", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).alias("cites"))
    return portal.month_listing(o, F.date_format("o_orderdate", "yyyy-MM"), "1996-02", "cites", F.coalesce(F.col("cites") > 200000, F.lit(False))).select("uid", F.col("rank").cast("long").alias("rank"), "n_classics")


LISTING = """WITH o AS (SELECT o_orderkey AS uid, CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS cites FROM orders WHERE strftime(o_orderdate::DATE, '%Y-%m') = '1996-02')
    SELECT uid, row_number() OVER (ORDER BY cites DESC NULLS LAST, uid) AS rank, count(*) FILTER (WHERE cites > 200000) OVER () AS n_classics FROM o"""


def saved_items(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("uid"), "event_type", "props", F.col("ts").alias("savedAt"), "user_id")
    return portal.saved_view(e, ["event_type", "props"], 'SE {"K": 1', F.col("user_id") % 2 == 0).select("uid")


SAVED = """SELECT event_id AS uid FROM events WHERE user_id % 2 = 0 AND contains(lower(event_type || ' ' || props), 'se {"k": 1')"""


def chats(spark, sf_dir):
    t = read(spark, sf_dir, "conversations").withColumns({"owner": F.col("conv_id") % 4, "done": F.col("turn") % 5 != 3, "at": F.col("conv_id") * 7 % 101})
    return portal.kept_chats(t, "conv_id", "turn", "done", "at", 20, 3).select("conv_id", "turn")


CHATS = """WITH c AS (SELECT DISTINCT conv_id FROM conversations QUALIFY dense_rank() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id * 7 % 101 DESC, conv_id) <= 20)
    SELECT conv_id, turn FROM conversations JOIN c USING (conv_id) WHERE turn % 5 <> 3 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3"""


def shards(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select((F.col("doc_id") * 1).alias("row"), F.lower("source").alias("t"))
    table = d.groupBy(F.floor(F.col("row") / 64).alias("shard")).agg(F.array_sort(F.collect_list(F.struct((F.col("row") % 64).alias("at"), "t"))).alias("x"))
    table = table.select("shard", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get(F.filter("x", lambda s: s["at"] == i), F.lit(0))["t"]).alias("abstracts"))
    return portal.shard_lookup(d.select("row").filter("row % 3 = 0"), table, "row", d.select("row").filter("row % 2 = 0"))


SHARDS = "SELECT doc_id AS row, doc_id // 64 AS shard, lower(source) AS abstract FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 <> 0"


def topic_counts(spark, sf_dir):
    return portal.topic_counts(read(spark, sf_dir, "documents"), "lang", {"de": "german", "fr": "french"})


TOPIC_COUNTS = "SELECT CASE lang WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' ELSE lang END AS topic, count(*) AS n FROM documents GROUP BY 1"


def prior_art(spark, sf_dir):
    """The block of all antecedents; and the one of the canon, where nothing is known."""
    k = F.col("n_nationkey")
    n = read(spark, sf_dir, "nation").select(k.alias("pos"), F.col("n_name").alias("title"), F.when(k % 3 != 0, F.concat(F.lit("A"), _s("n_regionkey"))).alias("authors"), F.when(k % 4 != 0, 1900 + k).alias("year"),
                                             F.when(k % 5 == 0, "a note").when(k % 5 == 1, "").alias("note"), F.when(k % 2 == 0, k * 700).alias("cites"), F.when(k % 2 == 0, "Method").otherwise("Theory").alias("kind"), F.concat(F.lit("why "), _s("n_regionkey")).alias("why"))
    both = portal.prior_art(n, n), portal.prior_art(n.limit(0), n)
    return both[0].withColumn("known", F.lit(True)).unionByName(both[1].withColumn("known", F.lit(False)))


PRIOR = """WITH n AS (SELECT n_nationkey AS k, n_name, CASE WHEN n_nationkey % 3 <> 0 THEN 'A' || n_regionkey END AS a, CASE WHEN n_nationkey % 4 <> 0 THEN (1900 + n_nationkey)::VARCHAR END AS y, n_regionkey AS r FROM nation)
    SELECT true AS known, string_agg('- ' || n_name || CASE WHEN a IS NOT NULL OR y IS NOT NULL THEN ' (' || concat_ws(' ', a, y) || ')' ELSE '' END ||
        CASE WHEN k % 5 = 0 THEN ': a note' WHEN k % 2 = 0 THEN ': ' || format('{:,}', k * 700) || ' citations' ELSE '' END, chr(10) ORDER BY k) AS block FROM n
    UNION ALL SELECT false, string_agg('- ' || n_name || ': why ' || r, chr(10) ORDER BY k) FROM n WHERE k % 2 = 0"""


def classics_text(spark, sf_dir):
    """Parts as classics: those of brands #1... are the canon, by brand."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    w = p.select(k.alias("uid"), F.col("p_name").alias("title"), F.when(F.contains("p_brand", F.lit("#1")), F.col("p_brand")).alias("topic"), F.when(k % 6 != 0, 1950 + F.col("p_size")).alias("year"), F.when(k % 5 != 0, k * 30 % 4000).alias("cites"),
                 F.when(k % 3 == 0, F.concat(F.lit(" "), F.repeat(F.col("p_type"), 5))).alias("authors"), F.when(k % 4 == 0, F.col("p_brand")).alias("journal"), (k % 7 == 0).alias("full"), F.when(k % 2 == 0, "Method").alias("kind"), F.when(k % 9 == 0, F.concat(F.lit("u"), _s("p_partkey"))).alias("url"), F.when(k % 8 == 0, "good").alias("why"))
    return portal.classics_lines(w, portal.classic_line(*[F.col(c) for c in ("title", "authors", "year", "journal", "full", "cites", "kind", "url", "why")]), 50)


CLASSICS_TEXT = """WITH w AS (SELECT p_partkey AS k, p_name AS title, CASE WHEN contains(p_brand, '#1') THEN p_brand END AS topic, CASE WHEN p_partkey % 6 <> 0 THEN (1950 + p_size)::VARCHAR END AS y, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey * 30 % 4000 END AS c, * FROM part),
    l AS (SELECT *, concat_ws(' · ', CASE WHEN k % 3 = 0 THEN substring(repeat(p_type, 5), 1, 70) END, y, CASE WHEN k % 4 = 0 THEN p_brand END) AS m,
          concat_ws(' · ', CASE WHEN k % 7 = 0 THEN 'full text' END, CASE WHEN c <> 0 THEN format('{:,}', c) || ' cites' END, CASE WHEN k % 2 = 0 THEN 'method' END) AS t FROM w),
    f AS (SELECT *, '- **' || trim(title) || '**' || CASE WHEN m <> '' THEN '  ' || chr(10) || '  ' || m ELSE '' END || CASE WHEN t <> '' THEN '  ' || chr(10) || '  _' || t || '_' ELSE '' END ||
          CASE WHEN k % 9 = 0 THEN ' — [link](u' || k || ')' ELSE '' END || CASE WHEN k % 8 = 0 THEN '  ' || chr(10) || '  good' ELSE '' END AS line FROM l)
    SELECT 0 AS block, '' AS topic, 0 AS place, '**' || count(*) || ' papers** · **' || count(*) FILTER (WHERE k % 7 = 0) || '** with full text parsed' AS line FROM f
    UNION ALL SELECT 1, topic, 0, '### ' || topic || ' (' || count(*) || ')' FROM f WHERE topic IS NOT NULL GROUP BY topic
    UNION ALL SELECT 1, topic, row_number() OVER (PARTITION BY topic ORDER BY coalesce(y, ''), title, k), line FROM f WHERE topic IS NOT NULL
    UNION ALL SELECT 2, '', 0, '## Most-cited (' || count(*) || ')' FROM f WHERE topic IS NULL
    UNION ALL SELECT * FROM (SELECT 2, '', row_number() OVER (ORDER BY coalesce(c, 0) DESC, title, k) AS p, line FROM f WHERE topic IS NULL) WHERE p <= 50"""


#: Entries that replies hold, and what is read from them: rel, gen, con (level and provisional), why of rel, kind, tags, flag, topic, summary.
SHAPES = [
    ('{"i": 1, "rel": {"level": 2, "why": " w "}, "gen": 3, "con": {"level": "1", "provisional": false}, "fit": {"level": 80}, "kind": " Login ", "tags": ["B", "a", "a"], "f": true, "topic": "T1", "summary": " s "}', (2, 3, 1, False, 2, "w", "login", "b,a", True, "T1", "s")),
    ('{"i": "4", "rel": 80, "tags": "a", "f": "no", "topic": "T9", "why": "because"}', (2, 2, 2, True, 0, "", "none", "a", False, "Other", "because")),
    ('{"i": 7.0, "rel": "x", "gen": null, "con": {"provisional": true}, "fit": 9, "kind": "other", "tags": ["other", "zz"], "f": null, "summary": ""}', (0, 0, 0, True, 0, "", "none", "other", None, "Other", "")),
    ('{"i": 1, "rel": {"level": -4}, "gen": {"why": "only"}, "tags": ["other", "b"], "f": "unknown", "topic": " T2 "}', (0, 0, 0, True, 0, "", "none", "b", None, "T2", "")),
    ('{"i": 9, "rel": {"level": 1, "why": "' + "long " * 40 + '"}, "con": 250, "tags": [], "f": 1, "summary": "' + "text " * 80 + '"}', (1, 1, 3, True, 0, ("long " * 40)[:120], "none", "other", True, "Other", ("text " * 80)[:280])),
]
#: Entries of which nothing is read, and replies without an array that can be.
LOST, BROKEN = ["5", '"x"', "[1]", "null", '{"rel": 2}', '{"i": "four"}'], ["", "none", "[{]", '{"i": 1}']


def tolerant(spark, sf_dir):
    """Every event has a reply of two entries, some of which can't be read."""
    e, k = read(spark, sf_dir, "events").select("event_id"), F.col("event_id")
    entry = lambda n: F.get(F.array(*[F.lit(x) for x in [s for s, _ in SHAPES] + LOST]), n % (len(SHAPES) + len(LOST)))
    reply = F.when(k % 17 == 0, F.get(F.array(*map(F.lit, BROKEN)), k % len(BROKEN))).otherwise(F.concat(F.lit("Here: ["), entry(k), F.lit(", "), entry(F.floor(k / 11)), F.lit("] (end)")))
    g = parse.graded(reply, ["rel", "gen", "con", "fit"], {"kind": (["login", "click"], "none")}, ["a", "b", "other"], alone=("fit",), provisional=("con",), flags=("f",), topics=(["T1", "T2"], "Other"), summary=True)
    x = e.select("event_id", F.posexplode(g).alias("place", "x"))
    return x.select("event_id", "place", F.col("x.i").alias("i"), *[F.col(f"x.{c}.level").alias(c) for c in ("rel", "gen", "con", "fit")], F.col("x.con.provisional").alias("provisional"), F.col("x.rel.why").alias("why"), "x.kind", F.array_join("x.tags", ",").alias("tags"), "x.f", "x.topic", "x.summary")


def _tolerant_sql() -> str:
    quote = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v + "'"
    ids = [1, 4, 7, 1, 9]
    rows = ", ".join("(" + ", ".join(map(quote, (n, i, *want))) + ")" for n, (i, (_, want)) in enumerate(zip(ids, SHAPES)))
    m = len(SHAPES) + len(LOST)
    return f"""WITH s(n, i, rel, gen, con, provisional, fit, why, kind, tags, f, topic, summary) AS (VALUES {rows}),
    e AS (SELECT event_id, 0 AS place, event_id % {m} AS n FROM events WHERE event_id % 17 <> 0 UNION ALL SELECT event_id, 1, (event_id // 11) % {m} FROM events WHERE event_id % 17 <> 0),
    j AS (SELECT * FROM e JOIN s USING (n) QUALIFY row_number() OVER (PARTITION BY event_id, i ORDER BY place DESC) = 1)
    SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY place) - 1 AS place, i, rel, gen, con, fit, provisional, why, kind, tags, f, topic, summary FROM j"""


def canon_items(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("title"), F.lit("A B").alias("author"), F.lit(1990).alias("year"))
    found = p.filter("k % 2 = 0").select("k", F.upper("title").alias("title"), F.when(F.col("k") % 4 == 0, "C D").otherwise("").alias("authors"), F.lit("J").alias("journal"), F.when(F.col("k") % 6 == 0, 2001).alias("year"), F.col("k").alias("cites"), F.lit("u").alias("url"))
    return portal.classic_item(portal.canon_items(p, found, "k"), "year").select("k", "title", "authors", "journal", "date", "cites", "url", "classic")


CANON_ITEMS = """SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS title, CASE WHEN p_partkey % 4 = 0 THEN 'C D' ELSE 'A B' END AS authors, CASE WHEN p_partkey % 2 = 0 THEN 'J' ELSE '' END AS journal,
    CASE WHEN p_partkey % 6 = 0 THEN '2001-01-01' ELSE '1990-01-01' END AS date, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS cites, CASE WHEN p_partkey % 2 = 0 THEN 'u' ELSE 'https://scholar.google.com/scholar?q=' || replace(p_brand, '#', '%23') END AS url, true AS classic FROM part"""


def records(spark, sf_dir):
    """Values by key with defaults, stored lists, users' savings."""
    p = read(spark, sf_dir, "part").select(_s("p_partkey").alias("k"), "p_brand", "p_size", "p_partkey")
    got = portal.kv_get(p.filter("p_partkey % 3 = 0").select("k", F.col("p_brand").alias("v")), p, "k", "v", "none")
    done = portal.progress(p.select(F.col("k").alias("month"), (F.col("p_size") > 10).alias("done"), F.when(F.col("p_partkey") % 2 == 0, F.format_string('["%s"]', "p_brand")).when(F.col("p_partkey") % 5 == 0, "oops").alias("ids")), "month")
    mine = portal.saved_of(p.filter("p_partkey % 4 = 0").select("k", F.lit('{"a":1}').alias("j")), p.select("k"), "k", "j")
    return got.join(done.withColumnRenamed("month", "k"), "k").join(mine, "k").select("k", "v", "done", F.array_join("ids", ",").alias("ids"), "j")


RECORDS = """SELECT p_partkey::VARCHAR AS k, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'none' END AS v, p_size > 10 AS done, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS ids, CASE WHEN p_partkey % 4 = 0 THEN '{"a":1}' ELSE '{}' END AS j FROM part"""


def classics_index(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("title"), F.concat(F.lit("r"), _s("n_regionkey")).alias("topic"), (F.col("n_nationkey") % 7).alias("year"))
    c = read(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), _s("p_partkey")).alias("title"), F.col("p_size").alias("cites"))
    return portal.classics_index(n, c, "topic", 30).select("block", "topic", F.col("place").cast("long").alias("place"), "title")


INDEX = """SELECT 0 AS block, 'r' || n_regionkey AS topic, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 7, n_name) AS place, n_name AS title FROM nation
    UNION ALL SELECT * FROM (SELECT 1, '', row_number() OVER (ORDER BY p_size DESC, p_name || ' ' || p_partkey), p_name || ' ' || p_partkey FROM part ORDER BY 3 LIMIT 30)"""


def pdf_status(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    content = F.when(F.col("p_partkey") % 4 == 0, F.lit(None)).when(F.col("p_partkey") % 4 == 1, F.lit("<html>")).otherwise(F.lit("%PDF-1.7")).cast("binary")
    return p.withColumns({"c": content, "n": F.col("p_size") * 2_000_000}).select("p_partkey", portal.pdf_status(p, "n", "c").alias("status"))


PDF_STATUS = "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'missing' WHEN p_size > 30 THEN 'too_large' WHEN p_partkey % 4 = 1 THEN 'not_pdf' ELSE 'ok' END AS status FROM part"


def replies(spark, sf_dir):
    """Graded replies and findings with prose around them."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    reply = F.format_string('Sure: [{"i": %d, "rel": {"level": "%d", "why": "w"}, "gen": {}, "kind": "%s", "tags": ["A", "b", "zz", "a"]}, {"rel": {"level": "1"}}] done', F.col("event_id"), F.col("user_id") % 5, F.upper("event_type"))
    g = parse.graded(reply, ["rel", "gen"], {"kind": (["login", "purchase"], "none")}, ["a", "b", "other"])
    found = parse.findings(F.format_string('x [{"p": 1, "f": "%s"}, {"p": 2, "f": " "}, {"p": 3}] y', "event_type"))
    x = F.get("g", F.lit(0))
    return e.select("event_id", g.alias("g"), found.alias("found")).select("event_id", F.size("g").alias("n"), x["rel"]["level"].alias("rel"), x["gen"]["level"].alias("gen"), x["kind"].alias("kind"), F.array_join(x["tags"], ",").alias("tags"), F.array_join(F.transform("found", lambda f: f["f"]), ",").alias("found"))


REPLIES = """WITH e AS (SELECT *, CASE WHEN user_id % 5 > 3 THEN round(user_id % 5 / 100.0 * 3)::INT ELSE (user_id % 5)::INT END AS l FROM events)
    SELECT event_id, 1 AS n, l AS rel, l AS gen, CASE WHEN event_type IN ('login', 'purchase') THEN event_type ELSE 'none' END AS kind, 'a,b' AS tags, event_type AS found FROM e"""


def slim(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return portal.slim(d, ["doc_id", "source"], "text", 400)


SLIM = "SELECT doc_id, source, substring(text, 1, 400) AS text, NULL::BIGINT AS cites FROM documents"


QUERIES = {
    "tiered_journals": (tiered, TIERED), "topic_resolve": (topics, TOPICS), "topic_sweep": (sweep, SWEEP), "author_pull": (author_pull, PULL), "author_search": (author_search, SEARCH), "month_candidates": (month, MONTH),
    "outside_new": (outside, OUTSIDE), "date_functions": (date_functions, DATES), "label_functions": (labels, LABELS), "inverted_index": (inverted, INVERTED), "resolve_authors": (resolved, RESOLVED), "roster_index": (indexed, INDEXED),
    "run_state": (run_state, RUN_STATE), "abstract_gaps": (needs_abstract, NEEDS), "citation_fill": (citations, CITATIONS), "citation_update": (updated, UPDATED), "title_lookup": (titled, TITLED), "first_hits": (first_hits, FIRST_HITS),
    "canon_authors": (canon_authors, CANON_AUTHORS), "watched_feed": (watched, WATCHED), "month_listing": (month_listing, LISTING), "saved_view": (saved_items, SAVED), "kept_chats": (chats, CHATS), "abstract_shards": (shards, SHARDS),
    "canon_topic_counts": (topic_counts, TOPIC_COUNTS), "prior_art_block": (prior_art, PRIOR), "canon_items": (canon_items, CANON_ITEMS), "stored_records": (records, RECORDS), "classics_index": (classics_index, INDEX),
    "pdf_status": (pdf_status, PDF_STATUS), "graded_replies": (replies, REPLIES), "tolerant_replies": (tolerant, _tolerant_sql()), "classics_text": (classics_text, CLASSICS_TEXT), "slim_items": (slim, SLIM),
}

"""Queries of lists, rosters and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import display
from paperloom.operators import rank, roster, views

from .items import ITEM_SQL, items, read


def categories(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    cat = display.category(F.when(F.col("c_mktsegment") == "BUILDING", "T1").when(F.col("c_mktsegment") == "MACHINERY", "T2"), F.col("c_custkey") % 5)
    return c.groupBy(cat.cast("long").alias("category")).agg(F.count("*").alias("n"))


CATEGORIES = "SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 0 WHEN c_mktsegment = 'MACHINERY' THEN 1 WHEN c_custkey % 5 = 4 THEN 3 ELSE 2 END::BIGINT AS category, count(*) AS n FROM customer GROUP BY 1"


def per_year(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", display.citations_per_year(F.floor("o_totalprice"), F.year("o_orderdate"), F.lit("2002-01-01").cast("date")).alias("per_year"))


PER_YEAR = "SELECT o_orderkey, round(floor(o_totalprice) / greatest(1, 2002 - year(o_orderdate) + 1), 1) AS per_year FROM orders"


def promoted(spark, sf_dir):
    i = items(spark, sf_dir).withColumn("authors", F.concat("source", F.lit(" A, B C")))
    return roster.promoted_authors(i, "authors", "relevance_category")


PROMOTED = f"WITH {ITEM_SQL} SELECT source || ' A' AS name, count(*) AS n FROM items WHERE relevance_category = 'core_fit' GROUP BY 1 HAVING count(*) >= 3"


def build_roster(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    pool = lambda m, s: c.filter(f"c_custkey % {m} = 0").select(F.col("c_custkey").alias("author_id"), F.col("c_name").alias("name"), F.lit(s).alias("source"))
    prior = c.filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("author_id"), F.lit("old").alias("source"), F.lit("2023-Q1").alias("added"))
    return roster.build([pool(7, "seed"), pool(3, "canon"), pool(2, "auto")], prior, F.lit("2024-Q1"))


BUILD = """SELECT c_custkey AS author_id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'old' WHEN c_custkey % 7 = 0 THEN 'seed' WHEN c_custkey % 3 = 0 THEN 'canon' ELSE 'auto' END AS source, CASE WHEN c_custkey % 4 = 0 THEN '2023-Q1' ELSE '2024-Q1' END AS added
    FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 3 = 0 OR c_custkey % 2 = 0"""


def venue_map(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    mix = rank.frequency_map(li.select("l_partkey", F.concat(F.lit("V"), "s_nationkey").alias("venue")), "l_partkey", "venue", 6)
    return mix.select("l_partkey", F.round(roster.venue_share(F.col("mix"), ["v1", "v2", "v3"]), 6).alias("share"))


VENUE_MAP = """WITH c AS (SELECT l_partkey, 'V' || s_nationkey AS v, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, v) AS k FROM c)
    SELECT l_partkey, round(100.0::DOUBLE * coalesce(sum(n) FILTER (WHERE v IN ('V1', 'V2', 'V3')), 0) / sum(n), 6) AS share FROM r WHERE k <= 6 GROUP BY 1"""


def monthly_search(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_totalprice", "o_orderpriority")
    return views.ranked_after(o, "month", "o_totalprice", "o_orderkey", "URGENT", "o_orderpriority").select("month", "o_orderkey", F.col("rank").cast("long").alias("rank"))


MONTHLY = "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders WHERE contains(lower(o_orderpriority), 'urgent')"


def bars(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    return views.with_bars(p, "p_brand", "p_retailprice").select("p_partkey", "bar")


BARS = "SELECT p_partkey, round(p_retailprice / max(p_retailprice) OVER (PARTITION BY p_brand), 4) AS bar FROM part"


def toggles(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return views.toggled(e.filter("event_type = 'login'").select("user_id"), e.filter("event_type = 'purchase'").select("user_id"), "user_id")


TOGGLES = "SELECT user_id FROM events GROUP BY 1 HAVING (count(*) FILTER (WHERE event_type = 'purchase') + CASE WHEN count(*) FILTER (WHERE event_type = 'login') > 0 THEN 1 ELSE 0 END) % 2 = 1"


def asked(spark, sf_dir):
    """Batches of 40 for a budget of five, the most cited first."""
    i = items(spark, sf_dir)
    out = views.batches(i, [F.desc_nulls_last("cites"), F.col("doc_id")], 40, 5)
    return out.select("doc_id", F.col("batch").cast("long").alias("batch"), F.col("item").cast("long").alias("item"))


ASKED = f"WITH {ITEM_SQL}, n AS (SELECT doc_id, row_number() OVER (ORDER BY cites DESC NULLS LAST, doc_id) - 1 AS n FROM items) SELECT doc_id, n // 40 AS batch, n % 40 AS item FROM n WHERE n < 200"


def picks(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 60).alias("title"), "text")
    return views.weighted_pick(d, ["tion", "keit", "the "], "title", "text", "doc_id", 40).select("doc_id", F.col("score").cast("long").alias("score"))


def _hit(column: str) -> str:
    return " + ".join(f"CASE WHEN contains(lower({column}), '{t}') THEN 1 ELSE 0 END" for t in ("tion", "keit", "the "))


PICKS = f"""WITH d AS (SELECT doc_id, trim(regexp_replace(lower(substring(text, 1, 60)), '[^a-z0-9]+', ' ', 'g')) AS k, {_hit('substring(text, 1, 60)')} AS t, {_hit('text')} AS b FROM documents),
    s AS (SELECT *, 5 * t + b AS score, row_number() OVER (PARTITION BY k ORDER BY 5 * t + b DESC, doc_id) AS n FROM d WHERE 5 * t + b > 0)
    SELECT doc_id, score::BIGINT AS score FROM s WHERE n = 1 ORDER BY (t = 0)::INT, score DESC, doc_id LIMIT 40"""


def citations(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    answer = F.concat("text", F.lit(" ["), (F.col("turn") + 1).cast("string"), F.lit("][2] [x] ["), (F.col("conv_id") % 9).cast("string"), F.lit("]"))
    return c.select("conv_id", "turn", F.array_join(display.cited_numbers(answer), ",").alias("cited"), display.chat_title(F.col("text")).alias("title")).drop("title")


CITATIONS = "SELECT conv_id, turn, array_to_string(list_sort(list_distinct([turn + 1, 2, conv_id % 9])), ',') AS cited FROM conversations WHERE role = 'assistant'"

QUERIES = {
    "categories": (categories, CATEGORIES), "citations_per_year": (per_year, PER_YEAR), "promoted_authors": (promoted, PROMOTED), "build_roster": (build_roster, BUILD), "venue_map_share": (venue_map, VENUE_MAP),
    "monthly_search": (monthly_search, MONTHLY), "classics_bars": (bars, BARS), "save_toggles": (toggles, TOGGLES), "model_batches": (asked, ASKED), "weighted_pick": (picks, PICKS), "cited_numbers": (citations, CITATIONS),
}

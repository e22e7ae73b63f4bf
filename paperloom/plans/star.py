"""Queries on the star schema, events and logs: state, aggregation, ranking, votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import dates, parse, text
from paperloom.operators import dedup, enrich, rank, scoring, state, votes

from .items import read


def patch_merge(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    old = o.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    new = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(0.0)).alias("o_totalprice"))
    return state.patch(old, new, "o_orderkey")


PATCH = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority,
    CASE WHEN o_orderkey % 15 = 0 THEN 0.0::DOUBLE ELSE o_totalprice END AS o_totalprice FROM orders"""


def kv_upsert(spark, sf_dir):
    return state.upsert(read(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


KV = "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id"


def insert_absent(spark, sf_dir):
    n = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return state.insert_absent(n.filter("c_custkey % 3 = 0"), n.withColumn("c_name", F.upper("c_name")), "c_custkey")


INSERT = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE upper(c_name) END AS c_name FROM customer"


def _letters(key: str):
    return F.concat(F.lit("x"), F.translate(F.col(key).cast("string"), "0123456789", "abcdefghij"))


def roster(spark, sf_dir):
    """Order lines of authors: clerks' names made of nation names, matched with a roster of nations."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read(spark, sf_dir, "nation")
    named = c.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit("Dr. Nobody; Ann "), _letters("n_nationkey"), F.lit(", Joe Other")).alias("authors"))
    entries = nation.filter("n_nationkey % 2 = 0").select("n_nationkey", F.concat(F.lit("ann "), _letters("n_nationkey")).alias("entry"))
    return enrich.roster_match(named, "c_custkey", "authors", entries, "entry", "n_nationkey").select("c_custkey", "n_nationkey", "entry")


ROSTER = "SELECT c_custkey, n_nationkey, 'ann x' || translate(n_nationkey::VARCHAR, '0123456789', 'abcdefghij') AS entry FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 2 = 0"


def explode_best(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return enrich.best_of(li, "l_orderkey", "l_quantity", "l_linenumber", ["l_linenumber", "l_quantity"])


BEST = "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1"


def impact(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    dim = part.groupBy("p_brand").agg(F.max("p_retailprice").alias("impact")).filter("p_brand <> 'Brand#11'")
    return enrich.percentile_of_max(part.select("p_partkey", "p_brand"), "p_brand", dim, "impact", "percentile").select("p_partkey", "p_brand", F.round("percentile", 4).alias("percentile"))


IMPACT = """WITH d AS (SELECT p_brand, max(p_retailprice) AS impact FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1)
    SELECT p_partkey, part.p_brand, round(100.0::DOUBLE * impact / (SELECT max(impact) FROM d), 4) AS percentile FROM part LEFT JOIN d USING (p_brand)"""


def correction(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    published = o.filter("o_orderkey % 2 = 0").select("o_custkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return enrich.correct_top(o, "o_custkey", "o_totalprice", "o_orderkey", published, 300).select("o_orderkey", "o_totalprice")


CORRECTION = """WITH t AS (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 300), p AS (SELECT o_custkey, max(o_totalprice * 2) AS new FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
    SELECT o.o_orderkey, greatest(o.o_totalprice, p.new) AS o_totalprice FROM orders o LEFT JOIN t ON o.o_orderkey = t.o_orderkey LEFT JOIN p ON t.o_custkey = p.o_custkey"""


def keep_last(spark, sf_dir):
    u = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return enrich.keep_last_lookup(u, read(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")], ["event_type", "value"])


KEEP_LAST = """WITH l AS (SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1)
    SELECT c_custkey AS user_id, c_mktsegment, event_type, value FROM customer LEFT JOIN l ON c_custkey = user_id"""


def saved_merge(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return state.remote_wins(c.filter("c_custkey % 3 <> 0"), c.filter("c_custkey % 2 = 0").withColumn("c_name", F.lower("c_name")), "c_custkey")


SAVED = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) ELSE c_name END AS c_name FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0"


def max_record(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rank.max_record(o, "o_custkey", "o_totalprice", "o_orderkey").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(250)


MAX_RECORD = "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 250"


def frequencies(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", F.concat("l_returnflag", "l_linestatus").alias("venue"))
    mix = rank.frequency_map(li, "l_suppkey", "venue", 6)
    return mix.select("l_suppkey", F.array_join(F.transform(F.array_sort(F.map_entries("mix")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("mix"))


FREQ = """WITH c AS (SELECT l_suppkey, l_returnflag || l_linestatus AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, v) AS k FROM c)
    SELECT l_suppkey, string_agg(v || ':' || n, ',' ORDER BY v) AS mix FROM r WHERE k <= 6 GROUP BY 1"""


def recurrence(spark, sf_dir):
    return read(spark, sf_dir, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 3")


RECURRENCE = "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 3"


def minmax(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    out = scoring.pooled_global(o, {"linear": (F.col("o_totalprice"), False), "logged": (F.col("o_totalprice"), True)})
    return out.select("o_orderkey", F.round("linear", 6).alias("linear"), F.round("logged", 6).alias("logged"))


MINMAX = """WITH b AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS z FROM orders) SELECT o_orderkey, round(100 * (o_totalprice - a) / (z - a), 6) AS linear,
    round(100 * (ln(1 + o_totalprice) - ln(1 + a)) / (ln(1 + z) - ln(1 + a)), 6) AS logged FROM orders, b"""


def minmax_by_pool(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.select("o_orderkey", F.round(scoring.pooled(F.col("o_totalprice"), ["o_custkey"], False), 6).alias("scaled"))


POOLED = """WITH b AS (SELECT *, min(o_totalprice) OVER w AS a, max(o_totalprice) OVER w AS z FROM orders WINDOW w AS (PARTITION BY o_custkey))
    SELECT o_orderkey, CASE WHEN z <= 0 THEN 0.0 WHEN a = z THEN 100.0 ELSE round(100 * (o_totalprice - a) / (z - a), 6) END::DOUBLE AS scaled FROM b"""


def median(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(votes.lower_median("l_quantity").alias("level"), votes.lower_median("l_extendedprice").alias("price"))


MEDIAN = "SELECT l_suppkey, quantile_disc(l_quantity, 0.5) AS level, quantile_disc(l_extendedprice, 0.5) AS price FROM lineitem GROUP BY 1"
ORDER = ["error", "login", "purchase"]


def mode(spark, sf_dir):
    return votes.ordered_mode(read(spark, sf_dir, "events"), ["user_id"], "event_type", ORDER)


MODE = f"""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, coalesce(list_position({ORDER!r}, event_type), 99), event_type) AS k FROM c)
    SELECT user_id, event_type FROM r WHERE k = 1"""


def vote_merge(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    v = e.select("event_id", F.when(F.col("event_id") % 7 < 3, "adjacent").when(F.col("event_id") % 7 < 5, "core_fit").otherwise("off_topic").alias("category"), F.when(F.col("user_id") % 3 == 0, "theory").when(F.col("user_id") % 3 == 1, "method").alias("kind"),
                 F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("topic"), (F.col("event_id") / 3).cast("long").alias("item"), (F.col("event_id") % 4).cast("int").alias("relevance"), (F.col("user_id") % 4).cast("int").alias("contribution"),
                 F.when(F.col("event_id") % 5 != 0, F.col("user_id") % 2 == 0).alias("weak"), F.array("event_type", F.when(F.col("user_id") % 2 == 0, "other").otherwise("core")).alias("tags"))
    out = votes.merge_votes(v, "item", ["relevance", "contribution"], ["weak"], "tags", "contribution", {"category": (["off_topic", "adjacent", "core_fit"], "adjacent"), "kind": ([], "none"), "topic": ([], None)}, "event_id")
    return out.select("item", "n_votes", "relevance", "contribution", "weak", "agree", "provisional", "category", "kind", "topic", F.array_join("tags", ",").alias("tags"))


VOTES = """WITH v AS (SELECT event_id, CASE WHEN event_id % 7 < 3 THEN 'adjacent' WHEN event_id % 7 < 5 THEN 'core_fit' ELSE 'off_topic' END AS category, CASE user_id % 3 WHEN 0 THEN 'theory' WHEN 1 THEN 'method' END AS kind, 't' || (user_id % 5) AS topic, event_id // 3 AS item, (event_id % 4)::INT AS relevance, (user_id % 4)::INT AS contribution, CASE WHEN event_id % 5 <> 0 THEN user_id % 2 = 0 END AS weak, [event_type, CASE WHEN user_id % 2 = 0 THEN 'other' ELSE 'core' END] AS tags FROM events),
    b AS (SELECT item, count(*) AS n_votes, quantile_disc(relevance, 0.5) AS relevance, quantile_disc(contribution, 0.5) AS contribution,
          CASE WHEN 2 * count(*) FILTER (WHERE weak) > count(*) THEN true WHEN count(*) FILTER (WHERE weak) = 0 AND count(*) FILTER (WHERE NOT weak) > 0 THEN false END AS weak, max(contribution) - min(contribution) <= 1 OR count(*) = 1 AS agree FROM v GROUP BY 1),
    t AS (SELECT item, tag, count(*) AS c FROM (SELECT item, unnest(list_distinct(tags)) AS tag FROM v) GROUP BY 1, 2),
    k AS (SELECT t.*, count(*) FILTER (WHERE tag <> 'other') OVER (PARTITION BY t.item) AS real FROM t JOIN b ON t.item = b.item WHERE 2 * c >= n_votes),
    r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY c DESC, tag) AS n FROM k WHERE tag <> 'other'),
    l AS (SELECT item, event_id, 'category' AS axis, category AS v FROM v UNION ALL SELECT item, event_id, 'kind', kind FROM v WHERE kind IS NOT NULL UNION ALL SELECT item, event_id, 'topic', topic FROM v),
    n AS (SELECT item, axis, v, count(*) AS c FROM l GROUP BY ALL), w AS (SELECT *, count(*) OVER (PARTITION BY item, axis) AS winners FROM (SELECT *, max(c) OVER (PARTITION BY item, axis) AS m FROM n) WHERE c = m),
    p AS (SELECT item, axis, max(winners) AS winners, min(v) AS only_one, min(CASE v WHEN 'off_topic' THEN 1 WHEN 'adjacent' THEN 2 ELSE 3 END) AS place FROM w GROUP BY ALL), f AS (SELECT item, arg_min(topic, event_id) AS first_topic FROM v GROUP BY 1),
    g AS (SELECT f.item, max(CASE WHEN axis = 'category' THEN CASE WHEN winners = 1 THEN only_one ELSE ['off_topic', 'adjacent', 'core_fit'][place] END END) AS category,
          coalesce(max(CASE WHEN axis = 'kind' THEN CASE WHEN winners = 1 THEN only_one ELSE 'none' END END), 'none') AS kind, max(CASE WHEN axis = 'topic' THEN CASE WHEN winners = 1 THEN only_one ELSE first_topic END END) AS topic FROM f JOIN p ON f.item = p.item GROUP BY 1)
    SELECT b.*, true AS provisional, g.category, g.kind, g.topic, coalesce(s.tags, 'other') AS tags FROM b JOIN g ON b.item = g.item LEFT JOIN (SELECT item, string_agg(tag, ',' ORDER BY n) AS tags FROM r WHERE n <= 3 GROUP BY 1) s ON b.item = s.item"""


def failover(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    some = [e.filter(f"event_id % {m} = 0").select("event_id", F.concat("event_type", F.lit(f"-{m}")).alias("answer")) for m in (2, 3, 5)]
    return votes.failover(e, "event_id", some)


FAILOVER = """SELECT event_id, event_type || CASE WHEN event_id % 2 = 0 THEN '-2' WHEN event_id % 3 = 0 THEN '-3' ELSE '-5' END AS answer, CASE WHEN event_id % 2 = 0 THEN 0 WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS provider
    FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0 OR event_id % 5 = 0"""


def tally(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).cast("long").alias("urgent"))


TALLY = "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 100000) AS large, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1"


def venue_share(spark, sf_dir):
    j = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(100.0 * F.count_if(F.col("l_returnflag") == "R") / F.greatest(F.count("*"), F.lit(1)), 6).alias("share"))


VENUE = "SELECT n_name, round(100.0::DOUBLE * count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 6) AS share FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"


def topk(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return rank.top_per_group(o, ["month"], [F.desc("o_totalprice"), F.col("o_orderkey")], 50).select("month", F.col("rank").cast("long").alias("rank"), "o_orderkey", "o_totalprice")


TOPK = "SELECT month, rank, o_orderkey, o_totalprice FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 50"


def tiers(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    t = scoring.tier(F.when(F.col("c_mktsegment") == "BUILDING", "T1").when(F.col("c_mktsegment") == "MACHINERY", "T2"), F.col("c_custkey") % 60, F.lit(None).cast("int"), F.col("c_acctbal") / 100)
    base = c.select("c_custkey", t.alias("tier"), (F.col("c_custkey") % 17 == 0).alias("watched"), (F.col("c_custkey") % 101).alias("score"), F.lit(1.0).alias("reputation"), F.col("c_nationkey").alias("date"))
    out = rank.digest_order(base, "watched", "tier", "score", "reputation", "date", "c_custkey")
    return out.select("c_custkey", F.col("tier").cast("long").alias("tier"), F.col("block").cast("long").alias("block"), F.col("place").cast("long").alias("place"))


TIERS = """WITH t AS (SELECT c_custkey, c_custkey % 101 AS score, c_custkey % 17 = 0 AS watched, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' OR c_custkey % 60 >= 40 OR c_acctbal / 100 >= 80 THEN 1 WHEN c_mktsegment = 'MACHINERY' OR c_custkey % 60 >= 20 OR c_acctbal / 100 >= 65 THEN 2 ELSE 0 END::BIGINT AS tier FROM customer),
    b AS (SELECT *, CASE WHEN watched THEN 0 WHEN tier = 1 THEN 1 WHEN tier = 2 THEN 2 ELSE 3 END::BIGINT AS block FROM t)
    SELECT c_custkey, tier, block, row_number() OVER (PARTITION BY block ORDER BY score DESC, c_nationkey DESC, c_custkey) AS place FROM b"""


def slots(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return rank.reserved_slots(c, "c_mktsegment", "BUILDING", "c_acctbal", "c_custkey", 10, 3)


SLOTS = """WITH a AS (SELECT c_custkey, c_mktsegment, c_acctbal, c_mktsegment = 'BUILDING' AS own, row_number() OVER (PARTITION BY c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer)
    SELECT c_custkey, c_mktsegment, c_acctbal FROM a ORDER BY CASE WHEN own THEN n > 3 ELSE n > 7 END, c_acctbal DESC, c_custkey LIMIT 10"""


def page(spark, sf_dir):
    return rank.page(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")], 2)


PAGE = "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 200"


def rotating(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("place"))
    return rank.rotating_slice(c, "place", 40, c.count(), 738_000)


ROTATING = "SELECT c_custkey, c_custkey AS place FROM customer WHERE c_custkey // 40 = (738000 // 3) % ceil((SELECT count(*) FROM customer) / 40.0)"


def author_scores(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    h = F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 70)
    member = F.when(F.col("c_custkey") % 10 == 0, "canon").when(F.col("c_custkey") % 10 == 1, "seed").when(F.col("c_custkey") % 10 == 2, "auto")
    a = scoring.author_score(h, F.lit(None).cast("long"), member, F.col("c_custkey") * 10, F.lit(25.0))
    return c.select("c_custkey", F.round(a, 1).alias("author_score"), F.round(scoring.reputation(a, F.when(F.col("c_custkey") % 2 == 0, 80.0)), 3).alias("reputation"))


AUTHOR = """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN least(100.0::DOUBLE, (c_custkey % 70) * 2.0::DOUBLE) ELSE 50.0::DOUBLE END AS base, CASE c_custkey % 10 WHEN 0 THEN 30 WHEN 1 THEN 20 WHEN 2 THEN 15 END AS bonus FROM customer),
    a AS (SELECT c_custkey, least(100.0::DOUBLE, CASE WHEN bonus IS NULL THEN base ELSE greatest(base, 55.0::DOUBLE) + (bonus + least(15.0::DOUBLE, log10(c_custkey * 10 + 1) / 4 * 15) + 0.08::DOUBLE * 25.0::DOUBLE) END) AS a FROM t)
    SELECT c_custkey, round(a, 1) AS author_score, round(0.85::DOUBLE + 0.3::DOUBLE * (CASE WHEN c_custkey % 2 = 0 THEN (a + 80.0::DOUBLE) / 2 ELSE a END / 100), 3) AS reputation FROM a"""


def month_series(spark, sf_dir):
    """Every month between the first and last order, with its bounds, predecessor, quarter and orders."""
    o = read(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    span = o.agg(F.min("month").alias("a"), F.max("month").alias("z"))
    months = span.select(F.explode(dates.months_between(F.col("a"), F.col("z"))).alias("month"))
    b = dates.month_bounds(F.col("month"))
    counted = months.join(o.groupBy("month").agg(F.count("*").alias("n")), "month", "left")
    return counted.select("month", b["last"].cast("string").alias("last"), dates.previous_month(F.col("month")).alias("before"), dates.quarter_label(b["first"]).alias("quarter"), F.coalesce("n", F.lit(0)).alias("n"))


MONTHS = """WITH m AS (SELECT unnest(generate_series(date_trunc('month', (SELECT min(o_orderdate) FROM orders)), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 MONTH)) AS d), c AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1)
    SELECT strftime(d, '%Y-%m') AS month, last_day(d)::VARCHAR AS last, strftime(d - INTERVAL 1 MONTH, '%Y-%m') AS before, year(d) || '-Q' || quarter(d) AS quarter, coalesce(n, 0) AS n FROM m LEFT JOIN c ON strftime(d, '%Y-%m') = month"""


def recent(spark, sf_dir):
    """Events of the last seven days before the newest one."""
    e = read(spark, sf_dir, "events")
    newest = e.agg(F.max(F.to_date("ts")).alias("m"))
    return e.crossJoin(F.broadcast(newest)).filter(F.to_date("ts") >= F.date_sub("m", 6)).groupBy("event_type").agg(F.count("*").alias("n"))  # one row is broadcast


RECENT = "SELECT event_type, count(*) AS n FROM events WHERE ts::DATE >= (SELECT max(ts::DATE) FROM events) - 6 GROUP BY 1"


def lru(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("t"))
    return state.keep_recent(e, ["user_id"], [F.desc("t")], 2).select("user_id", "event_type", F.col("t.event_id").alias("event_id"))


LRU = "WITH t AS (SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max((ts, event_id)) AS o FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o DESC) AS n FROM t) SELECT user_id, event_type, event_id FROM r WHERE n <= 2"


def json_parse(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", parse.level(k, 1).cast("long").alias("level"), parse.flag(F.when(F.col("event_id") % 4 == 0, "no").when(F.col("event_id") % 4 == 1, "N/A").otherwise(k)).alias("flag"), parse.one_of(F.col("event_type"), ["login", "purchase"], "none").alias("kind"))


JSON = """WITH t AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events), n AS (SELECT *, round(try_cast(k AS DOUBLE)) AS v FROM t)
    SELECT event_id, coalesce(least(3, greatest(0, CASE WHEN v > 3 THEN round(v / 100 * 3) ELSE v END::INT)), 1)::BIGINT AS level,
    CASE WHEN event_id % 4 = 0 THEN false WHEN event_id % 4 = 1 THEN NULL WHEN k IS NULL THEN NULL WHEN lower(trim(k)) IN ('', 'null', 'none', 'unknown', 'n/a') THEN NULL WHEN lower(trim(k)) IN ('false', '0', 'no') THEN false ELSE true END AS flag,
    CASE WHEN event_type IN ('login', 'purchase') THEN event_type ELSE 'none' END AS kind FROM n"""


def union_collect(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    return dedup.keep_first(dedup.collect([s, c, p]), ["key"], [F.col("load_order")])


UNION = """WITH u AS (SELECT s_suppkey AS key, s_nationkey AS nation, NULL AS name, 0 AS load_order FROM supplier UNION ALL SELECT c_custkey, NULL, c_name, 1 FROM customer UNION ALL SELECT p_partkey, NULL, p_name, 2 FROM part)
    SELECT key, nation, name, load_order FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY load_order) AS n FROM u) WHERE n = 1"""


def author_parse(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    name = F.concat(F.lit("J. R. "), F.initcap("c_mktsegment"), F.lit("-Smith "), F.when(F.col("c_custkey") % 2 == 0, "Lee").otherwise("de Vries"))
    k = text.person_key(name)
    return c.select("c_custkey", k["first"].alias("first"), k["last"].alias("last"), F.array_join(text.surnames(F.concat(name, F.lit(", Ann Bo; Joe Cameron and X. Yu"))), "|").alias("surnames"))


AUTHORS = "SELECT c_custkey, 'j' AS first, CASE WHEN c_custkey % 2 = 0 THEN 'lee' ELSE 'vries' END AS last, CASE WHEN c_custkey % 2 = 0 THEN 'lee' ELSE 'vries' END || '|ann|cameron' AS surnames FROM customer"


def quota(spark, sf_dir):
    """Reserved quotas: 35 of the curated kind first, and the 20 most cited of the rest."""
    p = read(spark, sf_dir, "part").withColumn("curated", F.col("p_brand") == "Brand#11")
    out = [rank.top_per_group(p.filter(c).withColumn("list", F.lit(n)), ["list"], [F.desc("p_retailprice"), F.col("p_partkey")], k) for n, c, k in (("curated", F.col("curated"), 35), ("cited", ~F.col("curated"), 20))]
    return out[0].unionByName(out[1]).select("list", F.col("rank").cast("long").alias("rank"), "p_partkey")


QUOTA = """WITH r AS (SELECT CASE WHEN p_brand = 'Brand#11' THEN 'curated' ELSE 'cited' END AS list, p_partkey, row_number() OVER (PARTITION BY p_brand = 'Brand#11' ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
    SELECT list, rank, p_partkey FROM r WHERE rank <= CASE WHEN list = 'curated' THEN 35 ELSE 20 END"""


def velocity(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    age = dates.age_years(F.lit(None).cast("int"), F.col("o_orderdate").cast("string"), F.lit("2000-06-01").cast("date"))
    v = o.select("o_orderkey", age.alias("age"), F.floor("o_totalprice").alias("cites"))
    scaled = scoring.pooled_global(v.withColumn("raw", F.when(F.col("age") >= 1, F.col("cites").cast("double") / F.col("age"))), {"velocity": (F.col("raw"), True)})
    return scaled.select("o_orderkey", F.col("age").cast("long").alias("age"), F.round("velocity", 6).alias("velocity"))


VELOCITY = """WITH t AS (SELECT o_orderkey, greatest(0, 2000 - year(o_orderdate)) AS age, floor(o_totalprice) AS c FROM orders), v AS (SELECT *, CASE WHEN age >= 1 THEN ln(1 + c / age) END AS l FROM t), b AS (SELECT min(l) AS a, max(l) AS z FROM v)
    SELECT o_orderkey, age, CASE WHEN l IS NOT NULL THEN round(100 * (l - a) / (z - a), 6) END AS velocity FROM v, b"""

QUERIES = {
    "patch_merge": (patch_merge, PATCH), "kv_upsert": (kv_upsert, KV), "insert_absent": (insert_absent, INSERT), "roster_match": (roster, ROSTER), "explode_best": (explode_best, BEST), "impact_percentile": (impact, IMPACT),
    "published_correction": (correction, CORRECTION), "keep_last_lookup": (keep_last, KEEP_LAST), "saved_merge": (saved_merge, SAVED), "max_record_topn": (max_record, MAX_RECORD), "freq_map_top6": (frequencies, FREQ),
    "recurrence": (recurrence, RECURRENCE), "minmax_global": (minmax, MINMAX), "minmax_pool": (minmax_by_pool, POOLED), "lower_median": (median, MEDIAN), "ordered_mode": (mode, MODE), "vote_merge": (vote_merge, VOTES),
    "failover_fill": (failover, FAILOVER), "status_tally": (tally, TALLY), "venue_share": (venue_share, VENUE), "topk_per_group": (topk, TOPK), "tier_assignment": (tiers, TIERS), "reserved_slots": (slots, SLOTS),
    "page_slice": (page, PAGE), "rotating_slice": (rotating, ROTATING), "author_score": (author_scores, AUTHOR), "month_series": (month_series, MONTHS), "recent_window": (recent, RECENT), "lru_keep": (lru, LRU),
    "json_parse": (json_parse, JSON), "union_collect": (union_collect, UNION), "author_parse": (author_parse, AUTHORS), "quota_antecedents": (quota, QUOTA), "velocity_blend": (velocity, VELOCITY),
}

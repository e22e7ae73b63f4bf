from pyspark.sql import functions as F

from paperloom.operators import gates, scoring, sinks
from paperloom.plans import drivers
from paperloom.sources import collect

FLAGS = ", ".join(f"{f} boolean" for f in scoring.DISCOUNTS)


def test_digest_run(spark):
    items = spark.createDataFrame([("u1", "A", "Ann Lee", "", "2024-01-05", "journal:J", 0), ("u1", "A", "Ann Lee", "x", "2024-01-05", "arxiv", 1), ("u2", "B", "Bo Roe", "b", "2020-01-01", "blog", 2), ("old", "C", "", "", "", "s", 3), ("u3", "Masthead", "", "", "", "s", 4)],
                                  "uid string, title string, authors string, abstract string, date string, source string, load_order int")
    archive = spark.createDataFrame([("old",)], "uid string")
    citations = spark.createDataFrame([("u1", "filled", None, 30), ("u2", "no", 40, None)], "uid string, abstract string, cites int, author_h int")
    roster = spark.createDataFrame([("A. Lee", 0, 10, "canon"), ("Ann Lee", 1, 45, "seed")], "name string, pos int, h_index int, member string")
    impact = spark.createDataFrame([("J", 5.0), ("K", 10.0)], "label string, value double")
    verdict = lambda u: (u, "Volatility Modeling", "no_antecedent", "core_fit", 3, 2, 1, None, None, None, None)
    verdicts = spark.createDataFrame([verdict(u) for u in ("u1", "u2", "u3", "old")], "uid string, topic string, antecedent_match string, relevance_category string, generality int, contribution int, testability int, " + FLAGS)
    got = {r["uid"]: r for r in drivers.digest(items, archive, citations, roster, impact, verdicts, F.lit("2024-02-01").cast("date")).collect()}
    assert set(got) == {"u1", "u2"}
    one, two = got["u1"], got["u2"]
    assert (one["sources"], one["abstract"], one["author_h"], one["impact_percentile"], one["member"]) == (["arxiv", "journal:J"], "filled", 30, 50.0, "seed")
    assert two["cites"] == 40 and two["age"] == 4 and two["velocity_norm"] == 100 and two["author_score"] == 50 and one["author_score"] == 100
    top = drivers.monthly(scoring_rows(got.values(), spark), "month", 1).collect()
    assert len(top) == 2


def scoring_rows(rows, spark):
    return spark.createDataFrame([(r["uid"], r["date"][:7], r["composite"]) for r in rows], "uid string, month string, composite double")


def test_ask(spark):
    vectors = spark.createDataFrame([(f"u{i}", [1.0 - i / 10, i / 10]) for i in range(6)], "uid string, v array<double>")
    query = spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    items = spark.createDataFrame([(f"u{i}", f"momentum {i // 2}" if i < 4 else f"other {i}", "momentum crash" if i == 5 else "", 80.0, 1.0) for i in range(6)], "uid string, title string, summary string, strength double, reputation double")
    texts = spark.createDataFrame([("u0", [("s", "momentum crashes are " + "long " * 50), ("s", "nothing here")]), ("u5", [("s", "crash")])], "uid string, passages array<struct<s: string, t: string>>")
    got = drivers.ask("What is a momentum crash?", vectors, query, items, texts).orderBy("place").collect()
    assert drivers.text_terms("What is a momentum crash?") == ["momentum", "crash"]
    assert [r["place"] for r in got] == list(range(1, len(got) + 1)) and got[0]["depth"] == "full" and {r["uid"] for r in got[:2]} == {"u0", "u5"}
    assert {r["uid"] for r in got} == {"u0", "u2", "u4", "u5"}  # one of each title


def test_collecting(spark):
    w = spark.createDataFrame([("a", "T1", "t", "2024-01-02", "J", 5, "10.1/a"), ("b", "T2", "x", "2024-01-03", "J", None, "10.1/b"), ("c", "", "t", "2024-02-03", "K", 9, "")], "uid string, title string, topic string, date string, source string, cites int, doi string").withColumn("url", F.col("uid"))
    swept = collect.topic_sweep(w, w.filter("topic = 't'").select("topic"), ["t2"], F.col("title"), "topic", "date")
    assert sorted((r["uid"], r["term"]) for r in swept.collect()) == [("a", None), ("b", "t2"), ("c", None)]
    assert [r["uid"] for r in collect.month_candidates(w, w.limit(0), "2024-01", "date", 1).collect()] == ["a"]
    assert {r["uid"] for r in collect.outside([w.filter("uid = 'a'"), w.withColumn("uid", F.upper("uid"))], "uid", "title").collect()} == {"a", "B", "C"}
    j = spark.createDataFrame([("J", "T1")], "label string, tier string")
    assert [(r["uid"], r["tier"]) for r in collect.tiered(w, j, "source", "label", "tier", "date", 1).collect()] == [("b", "T1")]
    hits = spark.createDataFrame([("t1", "x", 5000, "fin"), ("t1", "y", 10, "fin"), ("t2", "z", 9000, "bio")], "term string, id string, score int, field string")
    ok, rest = collect.resolve_topics(hits, "term", "score", "field", "fin")
    assert [r["id"] for r in ok.collect()] == ["x"] and [r["term"] for r in rest.collect()] == ["t2"]


def test_tei(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<TEI><text><body><div><head>Intro</head><p>one two</p><p>three</p></div><div><head>End</head><p>four</p></div></body></text></TEI>")
    got = collect.tei(spark, str(tmp_path / "a.xml"), F.lit("k")).collect()
    assert sorted((r["section"], r["place"], r["text"]) for r in got) == [("End", 0, "four"), ("Intro", 0, "one two"), ("Intro", 1, "three")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-20", "2024-01-21"), ("b", "", "2020-01-01"), ("c", "2030-01-01", "x")], "uid string, date string, seen string")
    sinks.export_recent_and_archive(df, "date", "seen", "2024-02-01", str(tmp_path / "out"))
    assert {r["uid"] for r in spark.read.json(str(tmp_path / "out/recent")).collect()} == {"a", "c"} and spark.read.json(str(tmp_path / "out/archive")).count() == 3
    months = spark.createDataFrame([(1, "2024-01"), (2, "2024-02")], "k int, month string")
    sinks.replace_partitions(months, str(tmp_path / "m"), "month")
    sinks.replace_partitions(spark.createDataFrame([(9, "2024-02")], months.schema), str(tmp_path / "m"), "month")
    assert {(r["k"], r["month"]) for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {(1, "2024-01"), (9, "2024-02")}


def test_gates(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    s = lambda x: F.lit(x).cast("string")
    n = lambda x: F.lit(x).cast("int")
    same = lambda a, b, y, z, p, q: one(gates.same_paper(s(a), s(b), n(y), n(z), s(p), s(q)))
    long = "a very long title about many things"
    assert same(long, long.upper() + "!", 2000, 2006, "", "") and not same(long, long, 2000, 2007, "A Roe", "B Lee") and same(long, long, 2000, 2010, "Ann Lee", "B. Lee, C Roe")
    assert same(long, long + " and more", None, 2010, None, None) and not same("short", "short one", None, None, "", "") and not same("", "", None, None, "", "")
    assert one(gates.potential_classic(n(None), F.lit(15.0))) and not one(gates.potential_classic(n(399), F.lit(None).cast("double")))
    assert [one(gates.known_id(s(x))) for x in ("doi:10.1000/x", "arxiv:2401.00001v2", "t:abc", None)] == [True, True, False, False]

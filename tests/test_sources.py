import json
import shutil

from paperloom.operators import passages
from paperloom.sources import collect, readers
from paperloom.streaming import events


def put(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_feeds(spark, tmp_path):
    rss = put(tmp_path / "a.xml", "<rss><channel><item><title>A &lt;b&gt;B&lt;/b&gt;</title><link>https://arxiv.org/abs/2401.00001v2</link><description>text</description><pubDate>Mon, 05 Feb 2024 10:00:00 GMT</pubDate></item>"
              "<item><title>Old</title><link>x</link><pubDate>Mon, 05 Feb 2020 10:00:00 GMT</pubDate></item><item><title>Undated</title><link>y</link></item></channel></rss>")
    got = {r["title"]: r for r in readers.rss(spark, rss, "blog", "4", "2024-01-01").collect()}
    assert set(got) == {"A B", "Undated"} and got["A B"]["arxiv_id"] == "2401.00001" and got["Undated"]["date"] == ""
    assert readers.rss(spark, rss, "nep-fmk", "1").count() == 3
    atom = put(tmp_path / "b.xml", "<feed>" + "".join(f"<entry><id>http://arxiv.org/abs/2401.0000{i}v1</id><title>T{i}</title><summary>S</summary><published>{d}T00:00:00Z</published><author><name>A A</name></author><author><name>B B</name></author></entry>" for i, d in ((1, "2024-02-03"), (2, "2023-01-01"))) + "</feed>")
    row, = readers.atom(spark, atom, "arxiv", "1", "2024-01-01").collect()
    assert (row["title"], row["authors"], row["arxiv_id"]) == ("T1", "A A, B B", "2401.00001")


def test_records(spark, tmp_path):
    c = put(tmp_path / "c.json", {"DOI": "10.1/X", "title": ["Tt"], "author": [{"given": "A", "family": "B"}], "published": {"date-parts": [[2024, 5]]}, "is-referenced-by-count": 3, "container-title": ["J"]}, {"DOI": "10.1/Y", "title": []})
    row, = readers.crossref(spark, c, "journal:J").collect()
    assert (row["date"], row["doi"], row["cites"], row["authors"], row["url"]) == ("2024-05-01", "10.1/x", 3, "A B", "https://doi.org/10.1/X")
    o = put(tmp_path / "o.json", {"id": "W1", "doi": "https://doi.org/10.1/Z", "title": "Q", "publication_year": 2020, "authorships": [{"author": {"id": "https://openalex.org/A1", "display_name": "N N"}}], "abstract_inverted_index": {"b": [1], "a": [0]}})
    row, = readers.openalex(spark, o, "p", "1").collect()
    assert (row["abstract"], row["date"], row["doi"], row["cites"], row["oa_author_ids"]) == ("a b", "2020-01-01", "10.1/z", 0, ["A1"])
    w = put(tmp_path / "w.json", {"title": "W", "authors": ["<a href='x'>A B</a>"], "abstract": "z", "displaydate": "July 2026", "url": "/papers/w123", "load_order": 1}, {"title": "W0", "authors": [], "displaydate": "x", "url": "/papers/w123", "load_order": 0})
    row, = readers.working_papers(spark, w).collect()
    assert (row["title"], row["authors"], row["date"], row["doi"]) == ("W", "A B", "2026-07-01", "10.3386/w123")


def test_passages(spark):
    rows = [(1, "s", i, " ".join([f"w{i}"] * n)) for i, n in enumerate([100, 130, 24])] + [(1, "t", 0, " ".join(["q"] * 25)), (2, "s", 0, "short")]
    got = passages.fold(spark.createDataFrame(rows, "k int, s string, o int, t string"), "k", "s", "o", "t").collect()
    assert sorted((r["k"], r["s"], r["passage"], r["words"]) for r in got) == [(1, "s", 0, 230), (1, "t", 0, 25)]
    wanted = spark.createDataFrame([(1, "The Cross-Section of Returns", "Fama", 1992), (2, "zzz", "Q", 2000), (3, "On lee", "Lee", 2020)], "k int, title string, author string, year int")
    found = spark.createDataFrame([(1, "The cross section of expected returns", ["French", "fama"], 1992, "journal-article", 0), (1, "Other", ["X"], 1950, "book", 1), (2, "abc", ["R"], 2000, "journal-article", 0), (3, "On lee", ["Kleeman"], 2000, "report", 0), (3, "On lee things", ["LEE"], 2009, "report", 1)], "k int, title string, authors array<string>, year int, kind string, pos int")
    assert [r["title"] for r in passages.best_match(wanted, found, "k").orderBy("k").collect()] == ["The cross section of expected returns", "On lee things"]


def test_streams(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in/e.parquet")
    batch = spark.read.parquet(f"{sf}/events.parquet")
    stream = events.read_events(spark, str(tmp_path / "in"), batch.schema)
    q = events.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("window_counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("window_counts").groupBy().sum("n").first()[0] == batch.count()
    for _ in range(2):  # the second run finds its checkpoint and adds nothing
        events.append_new(stream, str(tmp_path / "table"), "user_id", str(tmp_path / "at")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table/*")).count() == batch.select("user_id").distinct().count()


def test_practitioner_journals(spark):
    rows = [(f"t{i}", f"u{i}", f"2024-01-{i:02d}", "journal:a", "10.1/A%d" % i, "had") for i in range(1, 6)] + [("t6", "u6", None, "journal:a", None, "had"), ("t7", "u7", "2024-02-01", "journal:b", "10.1/q", None), ("t8", "u8", "2024-02-01", None, "10.1/r", None)]
    items = spark.createDataFrame(rows, "title string, url string, date string, source string, doi string, abstract string")
    journals, archive = spark.createDataFrame([("journal:a",)], "label string"), spark.createDataFrame([("doi:10.1/a5",), ("doi:10.1/a5",), (None,)], "uid string")
    asked = []

    def pages(new):
        asked.extend(sorted(r["url"] for r in new.collect()))
        return spark.createDataFrame([("u4", "new"), ("u4", "longer"), ("u5", "unasked"), (None, "x")], "url string, abstract string")

    got = {r["url"]: (r["abstract"], r["tier"]) for r in collect.practitioner(items, journals, archive, "uid", pages, 3).collect()}
    assert asked == ["u3", "u4"] and got == {"u5": ("had", "T2"), "u4": ("longer", "T2"), "u3": ("", "T2")}
    whole = {r["url"]: r["abstract"] for r in collect.practitioner(items, journals, archive, "uid", pages).collect()}
    assert len(whole) == 6 and whole["u6"] == "had" and collect.practitioner(items.limit(0), journals, archive, "uid", pages).count() == 0


def test_repositories(spark):
    works = spark.createDataFrame([(r, f"2024-01-0{d}", f"t{d}", f"{r}{d}", "s") for r in ("R1", "R2", "R3") for d in (1, 2, 3)], "repository string, date string, title string, url string, source string")
    wanted = spark.createDataFrame([("One", "R1"), ("Two", None), ("Three", ""), (None, None)], "label string, id string")
    hits = spark.createDataFrame([("Two", 1, "the TWO", "https://x/R2"), ("Two", 0, "none", "https://x/R3"), ("Two", 2, "two again", "https://x/R3"), ("Three", 0, None, "R3")], "label string, place int, name string, id string")
    got = sorted((r["source"], r["url"]) for r in collect.repositories(works, wanted, hits, 2).collect())
    assert got == [("One (via OpenAlex)", "R12"), ("One (via OpenAlex)", "R13"), ("Two (via OpenAlex)", "R22"), ("Two (via OpenAlex)", "R23")]
    assert collect.repositories(works.limit(0), wanted, hits).count() == 0 == collect.repositories(works, wanted.limit(0), hits).count()


def test_sources_from_folders(spark, tmp_path):
    names = ["plain", "a b", "Brand#1+2%", "é/x:y"]
    spark.createDataFrame([(x, x) for x in names], "code string, title string").write.partitionBy("code").format("xml").option("rowTag", "item").save(str(tmp_path / "f"))
    got = readers.rss(spark, str(tmp_path / "f"), readers.from_folder("code", "feed-"), "1").collect()
    assert sorted((r["title"], r["source"]) for r in got) == sorted((x, f"feed-{x}") for x in names)


def test_writers_and_joins_hold_few_rows(spark, monkeypatch):
    """What is written by folder is dealt to tasks of few rows; a repository's or journal's works are cut before they are joined."""
    from paperloom.operators import passages
    from paperloom.plans import feeding

    monkeypatch.setattr(feeding, "WRITTEN", 100)
    p = spark.range(2000).selectExpr("id", "if(id % 10 = 0, null, if(id < 1500, 'a', 'b')) AS folder")
    dealt = feeding._dealt(p, "folder", "id")
    sizes = [len(x) for x in dealt.rdd.glom().collect()]
    assert len(sizes) == 21 and sum(sizes) == 2000 and max(sizes) < 250

    def cut(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return "WindowGroupLimit" in plan.split("Join", 1)[1]

    works = spark.createDataFrame([("r", f"d{i}", f"t{i}", f"u{i}", "s") for i in range(9)], "repository string, date string, title string, url string, source string")
    wanted = spark.createDataFrame([("A", "r"), ("B", "r"), ("B", "q")], "label string, id string")
    found = collect.repositories(works, wanted, spark.createDataFrame([], "label string, place int, name string, id string"), 2)
    assert cut(found) and sorted((r["source"][0], r["title"]) for r in found.collect()) == [("A", "t7"), ("A", "t8"), ("B", "t7"), ("B", "t8")]
    own = collect.tiered(works, spark.createDataFrame([("s", "T1"), ("s", "T1")], "label string, tier string"), "source", "label", "tier", "date", 3)
    assert cut(own) and sorted(r["title"] for r in own.collect()) == ["t7", "t8", "t8"]

    monkeypatch.setattr(passages, "MATCHED", 10)
    titles = spark.range(50).selectExpr("id AS k", "concat('title number ', id) AS title", "'Lee' AS author", "2000L AS year")
    hits = spark.range(100).selectExpr("id % 50 AS k", "concat('title number ', id) AS title", "array('Lee') AS authors", "2000L AS year", "'journal-article' AS kind", "id AS pos")
    best = passages.best_match(titles, hits, "k")
    assert "[k#" in best._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression", 1)[1] and best._jdf.queryExecution().optimizedPlan().toString().count("], 16") == 2
    assert sorted((r["k"], r["title"]) for r in best.collect()) == [(i, f"title number {i}") for i in range(50)]

"""Runs that end halfway, paged scans, months made anew, cascades, the ingest queue and committed files."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from paperloom.operators import portal, runs, sinks
from paperloom.sources import paged
from paperloom.streaming import ingest

SCHEMA = "k long, v string"


def answered(rows):
    return rows.filter("k % 4 <> 3").select("k", F.concat(F.lit("v"), F.col("k").cast("string")).alias("v"))


def state(spark, path):
    return sorted((r["k"], r["v"]) for r in runs.results(spark, path, SCHEMA).collect())


def test_a_killed_run_goes_on(spark, tmp_path):
    todo = spark.createDataFrame([(i, -i) for i in range(40)] + [(None, 0), (5, -5)], "k long, o long")
    whole, path = str(tmp_path / "whole"), str(tmp_path / "parts")
    assert runs.run_batches(todo, "k", [F.col("o")], answered, SCHEMA, whole, 7) == 6
    asked = []

    def dies(rows):
        own = sorted(r["k"] for r in rows.collect())
        asked.append(own)
        if len(asked) == 3:  # in a task, while its batch is written
            return rows.select("k", F.when(F.col("k") >= 0, F.raise_error(F.lit("killed"))).cast("string").alias("v"))
        return answered(rows)

    with pytest.raises(Exception, match="killed"):
        runs.run_batches(todo, "k", [F.col("o")], dies, SCHEMA, path, 7)
    first = state(spark, path)
    assert asked[0] == list(range(33, 40)) and len(runs.committed(spark, path)) == 2 and len(first) == sum(k % 4 != 3 for k in range(26, 40))
    asked.clear()
    assert runs.run_batches(todo, "k", [F.col("o")], lambda rows: asked.append(sorted(r["k"] for r in rows.collect())) or answered(rows), SCHEMA, path, 7) > 0
    done = {k for k, _ in first}
    assert not done & {k for own in asked for k in own} and {27, 31, 35, 39} <= {k for own in asked for k in own}  # what got no answer is asked again
    assert state(spark, path) == state(spark, whole)


def test_budgets_end_runs_between_batches(spark, tmp_path):
    todo, path = spark.range(20).withColumnRenamed("id", "k"), str(tmp_path / "p")
    assert runs.run_batches(todo, "k", [F.col("k")], answered, SCHEMA, path, 5, budget=2) == 2
    ticks = iter([0, 1, 11, 12])
    assert runs.run_batches(todo, "k", [F.col("k")], answered, SCHEMA, path, 5, seconds=10, clock=lambda: next(ticks)) == 1
    assert runs.run_batches(todo.limit(0), "k", [F.col("k")], answered, SCHEMA, str(tmp_path / "none"), 5) == 0
    assert runs.results(spark, str(tmp_path / "none"), SCHEMA).collect() == []


def test_cascade_asks_for_what_is_missing(spark):
    seen = []

    def provider(wanted, value):
        def ask(rows):
            seen.append(sorted(r["k"] for r in rows.collect()))
            return rows.filter(F.col("k").isin(*wanted)).select("k", F.lit(value).alias("v")).unionByName(spark.createDataFrame([(99, "unasked"), (4, " "), (wanted[0], value + "!")], SCHEMA))
        return ask

    got = runs.cascade(spark.range(5).withColumnRenamed("id", "k"), "k", "v", [provider([1, 4], "abc"), provider([1, 2], "de"), provider([0], "x")], 3).collect()
    assert sorted((r["k"], r["v"], r["provider"]) for r in got) == [(1, "abc!", 0), (4, "abc", 0)]
    assert seen == [[0, 1, 2, 3, 4], [0, 2, 3], [0, 2, 3]]


def test_replies_are_aligned_by_position(spark):
    asked = runs.requests(spark.createDataFrame([(i,) for i in [5, 3, 1, 4, 2, None, 2]], "k long"), "k", [F.desc("k")], 2)
    assert {r["request"]: r["keys"] for r in asked.collect()} == {0: [5, 4], 1: [3, 2], 2: [1]}
    replies = spark.createDataFrame([(0, ["a"]), (1, [None, "b"]), (2, ["c", "d"])], "request long, values array<string>")
    assert sorted(tuple(r) for r in runs.by_position(asked, replies, "k", "v").collect()) == [(1, "c"), (2, "b"), (5, "a")]


def test_answers_make_vectors_stale(spark):
    items = spark.createDataFrame([(1, "t", None), (2, "t", "s"), (3, "t", "s"), (4, None, "s")], "k int, topic string, summary string")
    answers = spark.createDataFrame([(1, "t", "new"), (2, "u", ""), (3, "", "s"), (9, "x", "x")], "k int, topic string, summary string")
    new, stale = runs.applied(items, answers, "k", ["topic", "summary"])
    assert sorted(tuple(r) for r in new.collect()) == [(1, "t", "new"), (2, "u", "s"), (3, "t", "s"), (4, None, "s")]
    assert sorted(r["k"] for r in stale.collect()) == [1, 2]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_months_made_anew_leave_the_others(spark, tmp_path):
    path, old = str(tmp_path / "m"), spark.createDataFrame([(m, i) for m in ("2024-01", "2024-02", "2024-03", "2024-04") for i in range(3)], "month string, i int")
    sinks.replace_partitions(old, path, "month")
    before = files(path)

    def build(m):
        if m == "2024-02":
            raise OSError("no reply")
        new = spark.createDataFrame([(m, 100), ("2024-04", 7)], "month string, i int")
        return new.filter("i < 0") if m == "2024-03" else new

    assert runs.make_months(["2024-01", "2024-02", "2024-03", "2024-05"], build, path) == {"2024-02": "OSError"}
    rows = sorted((r["month"], r["i"]) for r in spark.read.schema("i int, month string").parquet(path).collect())
    assert rows == sorted([("2024-01", 100), ("2024-05", 100)] + [(m, i) for m in ("2024-02", "2024-03", "2024-04") for i in range(3)])
    after = files(path)
    assert {f for f in before if "2024-01" not in f} == {f for f in before if after.get(f) == before[f]}


PAGES = {("a", 1): 2, ("a", 2): 1, ("a", 3): 2, ("b", 1): 2, ("b", 2): 2, ("c/d", 1): 0, ("e", 1): 2, ("e", 3): 2, ("f", 2): 2}


def test_live_and_recorded_pages(spark, tmp_path):
    folder, sizes, limited = str(tmp_path), dict(PAGES), paged.RateLimited

    def body(query, page):
        n = sizes.get((query, page))
        return None if n is None else json.dumps({"m": {"x": [{"title": f"{query}{page}{i}"} for i in range(n)]}})

    def fetch(query, page):
        if query == "bad":
            raise ValueError("no")
        if query == "busy":
            raise limited
        if query == "late" and not os.path.exists(f"{folder}/tried"):
            open(f"{folder}/tried", "w").close()
            raise limited
        return body("a" if query == "late" else query, page)

    queries = spark.createDataFrame([(q,) for q in ["a", "b", "a", "c/d", "bad", "busy", "late", "", None]], "q string")
    got = paged.scan(queries, fetch, "m.x", 2, pause=0.0).cache()
    told = sorted((r["query"], r["page"], r["body"] is not None, r["error"]) for r in got.collect())
    assert told == [("a", 1, True, None), ("a", 2, True, None), ("b", 1, True, None), ("b", 2, True, None), ("b", 3, False, None), ("bad", 1, False, "ValueError"), ("busy", 1, False, "RateLimited"), ("c/d", 1, True, None), ("late", 1, True, None), ("late", 2, True, None)]
    live = sorted(r["e"]["title"] for r in paged.entries(got.filter("query in ('a', 'b', 'c/d')"), "m.x", "title string", 2).collect())
    for query, page in PAGES:
        place = tmp_path / "pages" / query.replace("/", "%2F")
        place.mkdir(parents=True, exist_ok=True)
        (place / f"{page}.json").write_text(body(query, page))
    (tmp_path / "pages" / "a" / "notes.json").write_text("{}")
    pages = paged.recorded(spark, str(tmp_path / "pages"))
    rows = paged.entries(pages, "m.x", "title string", 2).collect()
    # behind a short page (a), a missing page (e) and a missing first page (f) nothing is taken
    assert sorted((r["query"], r["page"], r["place"]) for r in rows) == [("a", 1, 0), ("a", 1, 1), ("a", 2, 0), ("b", 1, 0), ("b", 1, 1), ("b", 2, 0), ("b", 2, 1), ("e", 1, 0), ("e", 1, 1)]
    assert live == sorted(r["e"]["title"] for r in rows if r["query"] in ("a", "b", "c/d"))
    assert sorted({r["query"] for r in paged.entries(pages, "m.x", "title string").collect()}) == ["a", "b", "e"]
    assert paged.entries(pages.limit(0), "m.x", "title string", 2).collect() == []


def test_later_programs_overwrite(spark):
    page = lambda *titles: json.dumps({"results": [{"title": t, "url": f"/papers/{u}", "authors": None, "displaydate": None} for t, u in titles]})
    pages = spark.createDataFrame([("p", 1, page(("A", "w1"), ("B", "w2"))), ("q", 1, page(("C", "w1"))), ("r", 1, page(("D", "w2")))], "query string, page int, body string")
    title = lambda *programs: {r["nber_wp"]: r["title"] for r in paged.working_papers(pages, list(programs), 2).collect()}
    assert title("p", "q") == {"w1": "C", "w2": "B"} and title("q", "p") == {"w1": "A", "w2": "B"}
    assert [(r["url"], r["date"]) for r in paged.program_papers(pages, "r", 2, "2024-02-03").collect()] == [("https://www.nber.org/papers/w2", "2024-02-03")]


def test_one_state_however_often_a_batch_runs(spark, tmp_path):
    records = spark.createDataFrame([("doi:10.1/a", "A"), ("arxiv:2401.00001", "B"), ("doi:10.1/n", " ")], "uid string, title string")
    rows = [("1", "doi", "10.1/A"), ("2", "DOI ", "https://doi.org/10.1/a"), ("3", "arxiv", "2401.00001v2"), ("4", "x", "y"), ("5", "doi", None), ("6", "doi", "10.1/zz"), ("7", "doi", "10.1/n"), ("8", None, "z")]
    (tmp_path / "in").mkdir()
    schema = "request string, kind string, value string"
    write = lambda name, own: (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("request", "kind", "value"), r))) for r in own))
    write("a.json", rows)
    out, at = str(tmp_path / "out"), str(tmp_path / "at")

    def run():
        q = ingest.take_in(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), records, out, at)
        q.awaitTermination()
        good = sorted((r["request"], r["uid"], r["batch"]) for r in spark.read.parquet(f"{out}/accepted").collect())
        return good, sorted((r["request"], r["reason"], r["batch"]) for r in spark.read.parquet(f"{out}/rejected").collect())

    first = run()
    assert first == ([("1", "doi:10.1/a", 0), ("3", "arxiv:2401.00001", 0)], [("2", "repeated", 0), ("4", "bad kind", 0), ("5", "empty", 0), ("6", "not found", 0), ("7", "no title", 0), ("8", "bad kind", 0)])
    shutil.rmtree(f"{at}/commits")  # as if it had failed before the batch was committed
    assert run() == first
    write("b.json", [("9", "doi", "10.1/a")])
    assert run()[1][-1] == ("9", "already held", 1)


def test_only_committed_files_are_in_the_manifest(spark, tmp_path):
    path = str(tmp_path / "ft")
    p = spark.createDataFrame([(k, "s", i, "a b", 2) for k in range(6) for i in range(k)], "k long, section string, passage int, text string, words long")
    portal.write_passages(p, "k", path, 4)
    want = {k: (k, 2 * k) for k in range(1, 6)}
    read = lambda: {r["k"]: (r["n_passages"], r["n_words"]) for r in portal.manifest(spark, path, "k long").collect()}
    assert read() == want
    with pytest.raises(Exception, match="broken"):
        portal.write_passages(p.withColumn("words", F.when(F.col("k") == 5, F.raise_error(F.lit("broken"))).otherwise(F.col("words") + 1)), "k", path, 4)
    assert read() == want

"""Edge cases of functions and operators on hand-made rows."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import dates, ids, parse, text
from paperloom.operators import dedup, enrich, metrics, nearest, rank, retrieval, scoring, state, votes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


@pytest.mark.parametrize("doi,arxiv,url,title,want", [
    ("10.48550/arXiv.2401.00001v1", None, None, "t", "arxiv:2401.00001"), (None, "2401.00001v2", None, "t", "arxiv:2401.00001"),
    (None, None, "http://arxiv.org/abs/2401.00001v3", "t", "arxiv:2401.00001"), (None, None, "https://x.org/RePEc:arx:papers:2401.00001", "t", "arxiv:2401.00001"),
    ("10.1000/ABC", None, None, "t", "doi:10.1000/abc"), (None, None, None, "A Title", "t:" + __import__("hashlib").sha1(b"a title").hexdigest()[:16])])
def test_identity(spark, doi, arxiv, url, title, want):
    assert one(spark, ids.paper_uid(lit(doi), lit(arxiv), lit(url), lit(title))) == want


def test_batch_dedup(spark):
    items = spark.createDataFrame([("a", "s2", 1), ("a", "s1", 0), ("b", "s1", 2), ("c", "s9", 3), ("a", "s2", 4)], "uid string, source string, load_order int")
    archive = spark.createDataFrame([("c",)], "uid string")
    got = {r["uid"]: (r["source"], r["sources"]) for r in dedup.filter_new(items, archive, "uid", "source", "load_order").collect()}
    assert got == {"a": ("s1", ["s1", "s2"]), "b": ("s1", ["s1"])}
    assert dedup.fallback(items.limit(0), archive.withColumns({"source": F.lit("x"), "load_order": F.lit(1)})).count() == 1
    assert dedup.fallback(items, items).count() == 5


def test_fill_only_and_patch(spark):
    items = spark.createDataFrame([(1, 0, ""), (2, None, "kept"), (3, None, None)], "k int, cites int, abstract string")
    found = spark.createDataFrame([(1, 9, "new"), (2, 9, "new")], "k int, cites int, abstract string")
    got = {r["k"]: (r["cites"], r["abstract"]) for r in enrich.fill_only(items, found, "k", ["abstract"], ["cites"]).collect()}
    assert got == {1: (0, "new"), 2: (9, "kept"), 3: (None, None)}
    old = spark.createDataFrame([(1, "t", 5, True, ["a"])], "k int, t string, n int, f boolean, a array<string>")
    for change, want in (((None, None, None, None), ("t", 5, True, ["a"])), (("", 0, False, []), ("t", 0, False, ["a"]))):
        new = spark.createDataFrame([(1, *change)], old.schema)
        assert tuple(state.patch(old, new, "k").first())[1:] == want


@pytest.mark.parametrize("values,log,want", [([0, 0], False, [0, 0]), ([5, 5], False, [100, 100]), ([0, 5, 10], False, [0, 50, 100]), ([0, math.e - 1], True, [0, 100]), ([None, 1, 3], False, [None, 0, 100])])
def test_minmax(spark, values, log, want):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, v double")
    assert [r["s"] for r in scoring.pooled_global(df, {"s": (F.col("v"), log)}).orderBy("i").collect()] == want


def test_posteriors(spark):
    for topic, prior in [*scoring.NOVELTY_PRIOR.items(), ("none", 0.0476)]:
        for verdict, ratio in [*scoring.NOVELTY_LR.items(), ("none", 1.0)]:
            odds = prior / (1 - prior) * ratio
            assert one(spark, scoring.novelty_posterior(F.lit(topic), F.lit(verdict))) == pytest.approx(odds / (1 + odds))


def test_composite_redistributes(spark):
    base = dict(title="a paper", relevance_category="core_fit", cites=None, author_score=50.0, impact_percentile=None, age=0, generality=3, contribution=3, testability=3, provisional=True,
                isolated_backtest_only=None, no_costs_mentioned=None, extreme_claimed_sharpe=None, weak_stat_support=None)
    flags = {f: True for f in scoring.DISCOUNTS}
    rows = [base, base | dict(cites=10, age=2, provisional=False), base | dict(cites=100, age=1, provisional=False), base | flags, base | dict(title="Masthead"), base | dict(relevance_category="off_topic"), base | dict(relevance_category=None)]
    schema = "title string, relevance_category string, cites long, author_score double, impact_percentile double, age long, generality long, contribution long, testability long, provisional boolean, " + ", ".join(f"{f} boolean" for f in scoring.DISCOUNTS)
    order = [c.split()[0] for c in schema.split(", ")]
    got = scoring.composite(spark.createDataFrame([tuple(r[c] for c in order) for r in rows], schema)).collect()
    new = next(r for r in got if r["cites"] is None and r["robustness"] == 1)
    assert len(got) == 4 and new["base_quality"] == pytest.approx(88.3) and new["composite"] == pytest.approx(88.3) and new["cites_norm"] is None
    best = next(r for r in got if r["cites"] == 100)
    assert best["composite"] == 100 and best["velocity_norm"] == 100
    low = next(r for r in got if r["robustness"] < 1)
    assert low["robustness"] == pytest.approx(max(0.5, 0.85 * 0.9 * 0.85 * 0.85), abs=1e-3)


def test_author_score(spark):
    n = F.lit(None)
    call = lambda h=None, rh=None, m=None, rc=None, v=None: one(spark, scoring.author_score(F.lit(h).cast("int"), F.lit(rh).cast("int"), F.lit(m).cast("string"), F.lit(rc).cast("int"), F.lit(v).cast("double")))
    assert n is not None and call() == 50 and call(25) == 50 and call(60) == 100 and call(10, 30) == 60
    assert call(None, None, "canon") == 85 and call(None, None, "seed", 9999, 100.0) == pytest.approx(55 + 20 + 15 + 8)


def test_votes(spark):
    v = spark.createDataFrame([(1, 3, 0, True, ["a", "other"]), (1, 1, 3, None, ["a"]), (1, 2, 1, True, ["b"]), (2, 0, 2, False, ["other"]), (2, 3, 2, None, ["other", "x", "y", "z"]), (3, 1, 1, None, [])], "k int, level int, contribution int, flag boolean, tags array<string>")
    got = {r["k"]: r for r in votes.merge_votes(v, "k", ["level"], ["flag"], "tags", "contribution").collect()}
    assert (got[1]["level"], got[1]["flag"], got[1]["agree"], got[1]["tags"]) == (2, True, False, ["a"])
    assert (got[2]["level"], got[2]["flag"], got[2]["agree"], got[2]["tags"]) == (0, False, True, ["x", "y", "z"])
    assert (got[3]["n_votes"], got[3]["flag"], got[3]["agree"], got[3]["tags"]) == (1, None, True, ["other"])
    c = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (2, 0, "q"), (2, 1, "z"), (2, 2, "z"), (3, 1, "n"), (3, 0, "m"), (4, 0, None)], "k int, voter int, c string")
    c = c.selectExpr("*", "1 as level", "1 as contribution", "true as flag", "array('t') as tags")
    for neutral, want in (("none", {1: "a", 2: "z", 3: "none", 4: "none"}), (None, {1: "a", 2: "z", 3: "m", 4: None})):
        out = votes.merge_votes(c, "k", ["level"], ["flag"], "tags", "contribution", {"c": (["a", "b"], neutral)}, "voter").collect()
        assert {r["k"]: r["c"] for r in out} == want and all(r["provisional"] for r in out)
    m = spark.createDataFrame([(1, "b"), (1, "a"), (2, "z"), (2, "q"), (3, None)], "k int, v string")
    assert {r["k"]: r["v"] for r in votes.ordered_mode(m, ["k"], "v", ["b", "a"]).collect()} == {1: "b", 2: "q"}


def test_parsing(spark):
    for given, want in ((2, 2), ("67", 2), (100, 3), (-5, 0), ("x", 1), (None, 1), (2.6, 3)):
        assert one(spark, parse.level(F.lit(given), 1)) == want
    for given, want in ((None, None), ("null", None), ("false", False), ("0", False), ("whatever", True)):
        assert one(spark, parse.flag(lit(given))) is want
    tags = lambda xs: one(spark, parse.tags(F.array(*map(F.lit, xs)), ["a", "b", "c", "d"]))
    assert tags(["A", "a", "other"]) == ["a"] and tags(["other", "q"]) == ["other"] and tags(["a", "b", "c", "d"]) == ["a", "b", "c"] and tags(["q"]) == ["other"]
    assert one(spark, parse.tags(F.lit(None).cast("array<string>"), ["a"])) == ["other"]
    assert one(spark, parse.json_array(F.lit("sure: [1, [2]] bye"))) == "[1, [2]]" and one(spark, parse.json_array(F.lit("none"))) is None


def test_dates(spark):
    as_of = F.lit(dt.date(2024, 2, 1))
    assert one(spark, dates.month_name_date(F.lit("July 2026"), as_of)) == dt.date(2026, 7, 1) and one(spark, dates.month_name_date(F.lit("garbage"), as_of)) == dt.date(2024, 2, 1)
    assert [one(spark, dates.parts_to_iso(F.array(*map(F.lit, p)))) for p in ([2024], [2024, 5], [2024, 5, 9], [0])] == ["2024-01-01", "2024-05-01", "2024-05-09", ""]
    assert one(spark, dates.previous_month(F.lit("2024-01"))) == "2023-12" and one(spark, dates.months_between(F.lit("2023-11"), F.lit("2024-02"))) == ["2023-11", "2023-12", "2024-01", "2024-02"]
    assert [one(spark, dates.age_years(F.lit(y).cast("int"), F.lit(d), as_of)) for y, d in ((None, "2020-05"), (2030, ""), (None, "x"), (2024, "1999"))] == [4, 0, None, 0]
    assert one(spark, dates.quarter_label(as_of)) == "2024-Q1"


def test_texts(spark):
    assert one(spark, text.clean_html(F.lit("<p>a <b>b</b>\n c</p>"))) == "a b c"
    assert one(spark, text.tidy(F.lit("Abstract: one two three four"), 12)) == "one two…"
    assert one(spark, text.title_key(F.lit("A--B é: c"))) == "a b c"
    assert tuple(one(spark, text.person_key(F.lit("J. R. O'Neil-Smith")))) == ("j", "oneil-smith") and one(spark, text.person_key(F.lit("Plato"))) is None
    assert one(spark, text.surnames(F.lit("Ann Lee, Bo Li; Cy Ray and Di Ray"))) == ["lee", "ray"]
    assert one(spark, text.question_key(F.lit("What is the alpha of the alpha-beta model?"))) == "alpha beta model"
    assert one(spark, text.redact(F.lit("u?api_key=1&mailto=a@b&k=2"))) == "u?api_key=***&mailto=***&k=2"
    assert one(spark, text.slug_title(F.lit("https://a.b/c/123-the-long-road.html?x=1"))) == "The Long Road"
    assert one(spark, text.from_inverted_index(F.create_map(F.lit("b"), F.array(F.lit(1), F.lit(5)), F.lit("a"), F.array(F.lit(0))))) == "a b b"


def test_roster_and_titles(spark):
    items = spark.createDataFrame([(1, "X Y; Jane Q. Doe, John Roe"), (2, "Nobody"), (3, None)], "k int, authors string")
    roster = spark.createDataFrame([("J. Roe", 1), ("John Roe", 2), ("Jane Doe", 3)], "name string, pos int")
    assert [(r["k"], r["pos"]) for r in enrich.roster_match(items, "k", "authors", roster, "name", "pos").collect()] == [(1, 3)]
    docs = spark.createDataFrame([(1, "so A Long Title it is"), (2, "a long tale")], "k int, t string")
    titles = spark.createDataFrame([(7, "A Long Title"), (8, "Other"), (9, "")], "id int, title string")
    assert [tuple(r) for r in enrich.contains_match(docs, "t", titles, "title", "id", "k").collect()] == [(1, 7)]


def test_ranking(spark):
    df = spark.createDataFrame([(i, "p" if i % 3 == 0 else "a", float(i % 7), i) for i in range(30)], "k int, kind string, s double, t int")
    got = rank.reserved_slots(df, "kind", "p", "s", "k", 10, 3).collect()
    assert len(got) == 10 and sum(r["kind"] == "p" for r in got) == 3
    few = rank.reserved_slots(df.filter("kind = 'a' or k = 0"), "kind", "p", "s", "k", 10, 3).collect()
    assert len(few) == 10 and sum(r["kind"] == "p" for r in few) == 1
    assert rank.page(df, [F.col("k")], 1, 7).first()["k"] == 7
    assert {tuple(r) for r in rank.top_per_group(df, ["kind"], [F.desc("s"), F.col("k")], 2).select("kind", "k").collect()} == {("p", 6), ("p", 27), ("a", 13), ("a", 20)}


def test_retrieval(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [0.6, 0.8]), (3, [0.6, 0.8])], "k int, v array<double>")
    assert [r["q"] for r in v.select(retrieval.quantise(F.col("v")).alias("q")).collect()] == [[127, 0], [0, 0], [76, 102], [76, 102]]
    assert [r["k"] for r in retrieval.recall(v, v.filter("k = 0").select(F.col("v").alias("q")), "v", "k", 3).collect()] == [0, 2, 3]
    p = spark.createDataFrame([(1, "alpha beta alpha"), (2, "beta"), (3, None)], "k int, t string")
    got = {r["k"]: r["score"] for r in retrieval.bm25(p, "k", "t", ["alpha", "zzz"]).collect()}
    avg, idf = 4 / 3, math.log(1 + 2.5 / 1.5)
    assert got == {1: pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg)))}
    for n, want in ((2, [1, 2]), (9, [4, 5, 6, 7, 8, 9])):
        turns = spark.createDataFrame([(1, i + 1) for i in range(n)], "c int, t int")
        assert [r["t"] for r in retrieval.history(turns, "c", "t").orderBy("place").collect()] == want
    near = nearest.nearest(v, v.filter("k = 2"), "k", "v", 2)
    assert [r["k"] for r in near.orderBy("rank").collect()] == [3, 0]


def test_state(spark):
    p = lambda rows: state.next_month(spark.createDataFrame(rows, "m string, d boolean"), "m", "d", "2024-03", "2024-01").first()["m"]
    assert p([]) == "2024-02" and p([("2024-02", False)]) == "2024-02" and p([("2024-02", True)]) == "2024-01" and p([("2024-01", True)]) is None
    now = F.lit(dt.datetime(2024, 1, 4))
    assert [one(spark, state.due(lit(x), now)) for x in (None, "bad", "2024-01-01 00:00:00", "2024-01-03 00:00:00")] == [True, True, True, False]


def test_top_k_is_a_prefix(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.randrange(4), rng.random()) for i in range(200)], "k int, g int, s double")
    order = [F.desc("s"), F.col("k")]
    small, large = ({(r["g"], r["rank"], r["k"]) for r in rank.top_per_group(df, ["g"], order, n).collect()} for n in (3, 4))
    assert small == {x for x in large if x[1] <= 3}


@pytest.mark.parametrize("at_once", [10_000, 2])
def test_titles_in_texts_may_begin_and_end_inside_words(spark, monkeypatch, at_once):
    monkeypatch.setattr(enrich, "SHORT_TITLES", at_once)
    items = spark.createDataFrame([(1, "concat sat here"), (2, "the cat saturated a mat-like thing"), (3, None), (4, "cat, sat")], "i int, t string")
    titles = spark.createDataFrame([("a", "cat sat"), ("b", "at saturated a mat"), ("c", "e cat sat"), ("d", "!"), ("e", None), ("f", "-like")], "k string, title string")
    got = {(r["i"], r["k"]) for r in enrich.contains_match(items, "t", titles, "title", "k", "i").collect()}
    texts, names = {r["i"]: r["t"] for r in items.collect()}, {r["k"]: r["title"] for r in titles.collect()}
    assert got == {(i, k) for i, t in texts.items() for k, n in names.items() if t and n and n in t} and (1, "a") in got

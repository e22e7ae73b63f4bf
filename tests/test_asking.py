"""Many questions at once: numbering, screening by requests, refused widths, and answers that cite."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import asking, nearest, retrieval


@pytest.fixture(scope="module")
def archive(spark):
    n = 70
    questions = spark.createDataFrame([(1, "momentum crashes", [1.0, 0.0]), (2, "is it", [0.0, 1.0]), (3, "momentum crashes", [1.0, 0.0])], "qid long, question string, v array<double>")
    vectors = spark.createDataFrame([(i, [1.0 - i / 100, i / 100]) for i in range(n)] + [(500, [1.0, 0.0])], "uid long, v array<double>")
    items = spark.createDataFrame([(i, f"Paper {i}", "", f"On rain. Its momentum crashes hard in {i}. End" if i in (20, 33) else "nothing" if i % 2 else None, 50.0, 1.0, f"k{i}") for i in range(n)] + [(500, " paper 0", "", "", 0.0, 1.0, "k500")],
                                  "uid long, title string, summary string, abstract string, strength double, reputation double, key string")
    full = spark.createDataFrame([(3, [("Intro", "momentum crashes here"), ("", "rain")]), (4, [("Intro", "momentum crashes here"), ("B", "crashes")]), (60, [("x", "momentum crashes")])], "uid long, passages array<struct<s: string, t: string>>")
    outside = spark.createDataFrame([(1, p, k, f"o{p}", None) for p, k in enumerate(["K3", "z1", "z2", "z3", "k4", "z5", "z6"])], "qid long, pos int, key string, title string, abstract string")
    return questions, vectors, items, full, outside


def rows(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["qid"], r["place"])):
        out.setdefault(r["qid"], []).append(r)
    return out


def test_sources_are_numbered_in_the_order_of_the_context(spark, archive):
    got = rows(asking.sources(*archive))
    one = got[1]
    assert [r["place"] for r in one] == list(range(1, len(one) + 1))
    # one of two equal passages, of the paper that stands first; then six papers, what screening finds, and four from outside
    assert [(r["block"], r["uid"], r["section"]) for r in one[:2]] == [(0, 3, "Intro"), (0, 4, "B")]
    assert [r["uid"] for r in one[2:8]] == [0, 1, 2, 3, 4, 5] and [r["depth"] for r in one[2:5]] == ["summary_only", "abstract", "summary_only"]
    assert [(r["uid"], r["body"]) for r in one[8:10]] == [(20, "Its momentum crashes hard in 20"), (33, "Its momentum crashes hard in 33")]
    assert [r["title"] for r in one[10:]] == ["o1", "o2", "o3", "o5"] and [r["block"] for r in one[10:]] == [3] * 4
    # without terms there are no passages and nothing is found; the order is that of the vectors, one of each title
    assert [r["block"] for r in got[2]] == [1] * 12 and [r["uid"] for r in got[2]] == list(range(69, 57, -1))
    assert [(r["block"], r["uid"]) for r in got[3]] == [(r["block"], r["uid"]) for r in one[:10]]


def test_replies_count_for_their_own_papers(spark, archive):
    asked = []

    def model(requests):
        asked.extend(requests.collect())
        said = {0: 'Sure: [{"p": 13, "f": "first"}, {"p": 13, "f": "last"}, {"p": 40, "f": "not here"}, {"p": 15, "f": " "}] ok', 1: None, 2: "no array"}
        return spark.createDataFrame([(r["qid"], r["request"], said[r["request"]]) for r in asked], "qid long, request long, reply string")

    rest = spark.createDataFrame([(1, "q", ["t"], at, f"t{at}", "a" if at != 14 else " ") for at in range(13, 49)], "qid long, question string, terms array<string>, at int, title string, abstract string")
    found = asking.screened(rest, model).collect()
    assert [(r["qid"], r["at"], r["finding"]) for r in found] == [(1, 13, "last")]
    assert sorted(len(r["papers"]) for r in asked) == [3, 16, 16] and [p["i"] for r in asked if r["request"] == 0 for p in r["papers"]] == [13, *range(15, 30)]
    assert asking.screened(rest.limit(0), asking.extracts).collect() == []


def test_other_widths_are_refused(spark, archive):
    questions, vectors, *rest = archive
    with pytest.raises(ValueError, match="dimensions"):
        asking.sources(questions.withColumn("v", F.slice("v", 1, 1)), vectors, *rest)
    with pytest.raises(ValueError, match="dimensions"):
        nearest.nearest(vectors.unionByName(spark.createDataFrame([(900, [1.0])], "uid long, v array<double>")), vectors, "uid", "v", 3)


def test_passages_score_as_for_one_question(spark):
    rng_texts = ["alpha beta alpha", "beta", "gamma alpha", "", "delta " * 9 + "alpha"]
    parts = spark.createDataFrame([(q, i, t, terms) for q, terms in ((1, ["alpha", "zzz"]), (2, ["beta", "alpha"]), (3, [])) for i, t in enumerate(rng_texts)], "qid int, i int, t string, terms array<string>")
    got = {}
    for r in asking.bm25(parts, "terms", "t").collect():
        got.setdefault(r["qid"], {})[r["i"]] = r["score"]
    for q, terms in ((1, ["alpha", "zzz"]), (2, ["beta", "alpha"])):
        want = {r["i"]: r["score"] for r in retrieval.bm25(parts.filter(F.col("qid") == q), "i", "t", terms).collect()}
        assert got[q] == pytest.approx(want)
    assert 3 not in got


def test_answers_cite_their_sources(spark, archive):
    questions = archive[0]
    cited = asking.sources(*archive)
    told = {r["qid"]: r for r in asking.checked(asking.quoting(cited, questions), cited).collect()}
    assert told[1]["answer"] == "momentum crashes here [1]. crashes [2]. Its momentum crashes hard in 20 [9]." and told[1]["cited"] == [1, 2, 9] and told[1]["loose"] == [] and 2 not in told
    loose = asking.checked(spark.createDataFrame([(1, "so [1] and [99], [0]"), (9, "[1]")], "qid long, answer string"), cited).collect()
    assert {r["qid"]: (r["cited"], r["loose"]) for r in loose} == {1: ([1], [0, 99]), 9: ([], [1])}
    sent = {r["qid"]: r for r in asking.contexts(questions, cited).collect()}
    assert sent[1]["n_sources"] == 14 and sent[1]["context"].startswith("[1] Paper 3 — Intro | depth: full\nmomentum crashes here\n\n[2] ")
    assert json.dumps(sent[2]["context"]).count("depth:") == 12


def test_an_empty_archive(spark, archive):
    questions, vectors, items, full, outside = archive
    got = rows(asking.sources(questions, vectors.limit(0), items.limit(0), full, outside))
    assert {q: [r["block"] for r in own] for q, own in got.items()} == {1: [3] * 4}
    assert asking.sources(questions.limit(0), vectors, items, full, outside.limit(0)).collect() == []


def test_texts_and_rows_are_not_made_again_for_every_block(spark, sf, monkeypatch):
    """Whatever the vectors come from is worked out once, and whole texts aren't joined where their first lines do."""
    from paperloom.operators import nearest
    from paperloom.plans import questions

    made = spark.sparkContext.accumulator(0)

    def count(v):
        made.add(1)
        return v

    rows = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(40)], "id long, v array<double>")
    monkeypatch.setattr(nearest, "QUERIES", 2)
    assert nearest.nearest(rows.withColumn("v", F.udf(count, "array<double>").asNondeterministic()("v")), rows.filter("id % 5 = 0"), "id", "v", 3).count() == 24
    assert made.value == 40
    items = questions._given(spark, sf)[2]
    assert "AS title" in items._jdf.queryExecution().optimizedPlan().toString().split("Join LeftSemi", 1)[1].split(":  +-")[0]

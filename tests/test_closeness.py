"""Blocked neighbours against all pairs, purity and gain by hand, and odd entries of graded replies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import parse
from paperloom.operators import nearest, passages, portal, rank, views, votes
from paperloom.plans import more


@pytest.mark.parametrize(("block", "values"), [(3, None), (2048, None), (4, [0.0, 0.5, 1.0])])
def test_against_all_pairs(spark, monkeypatch, block, values):
    monkeypatch.setattr(nearest, "QUERIES", block)
    monkeypatch.setattr(nearest, "ROWS", 7)
    rng = random.Random(block)
    rows = [(i, [rng.choice(values) if values else rng.uniform(-1, 1) for _ in range(3)]) for i in range(60)] + [(None, [1.0] * 3), (99, None)]
    v = spark.createDataFrame(rows, "k long, v array<double>").repartition(3)
    got = nearest.nearest(v, v.filter("k % 5 = 0 or k is null or k = 99"), "k", "v", 4).collect()
    want = []
    for a, x in rows[:60:5]:
        near = sorted((-round(float(np.dot(x, y)), 4) + 0.0, b) for b, y in rows[:60] if b != a)[:4]
        want += [(a, b, -s, n) for n, (s, b) in enumerate(near, 1)]
    assert sorted((r["query"], r["k"], r["sim"] + 0.0, r["rank"]) for r in got) == sorted((a, b, s + 0.0, n) for a, b, s, n in want)


def test_few_rows_and_none(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "k long, v array<double>")
    assert [tuple(r) for r in nearest.nearest(v, v.filter("k = 1"), "k", "v", 5).collect()] == [(1, 2, 0.0, 1)]
    assert nearest.nearest(v, v.limit(0), "k", "v", 5).collect() == [] and nearest.nearest(v.limit(0), v, "k", "v", 5).collect() == []
    assert [r["u"] for r in spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>").select(nearest.unit(F.col("v")).alias("u")).collect()] == [[0.6, 0.8], [0.0, 0.0], None]


def test_groups_of_a_query(spark):
    near = spark.createDataFrame([(q, k, 1.0, r) for q in (1, 2, 3, 4) for r, k in enumerate((5, 6), 1)], "query long, k long, sim double, rank int")
    m = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, "a"), (1, "b"), (6, "b"), (6, "b"), (7, None)], "k long, g string")
    assert [tuple(r) for r in nearest.purity(near, m, "k", "g", 2).collect()] == [("a", 0.5, 4)]
    assert sorted(tuple(r) for r in nearest.purity(near, m, "k", "g", 2, 1).collect()) == [("a", 0.5, 4), ("b", 0.5, 1)]
    labels = spark.createDataFrame([(1, "x"), (2, None), (3, ""), (4, "y"), (5, "x"), (6, None)], "k long, l string")
    share = nearest.coherence(near, labels, "k", "l", 2)
    assert tuple(share.first()) == (0.25, 2)
    gain = {r["metric"]: (r["a"], r["b"], r["points"], r["worth"]) for r in nearest.gain({"p": (share, nearest.purity(near, m, "k", "g", 2)), "q": (share, nearest.purity(near, m, "k", "g", 2, 1))}).collect()}
    assert gain == {"coherence": (0.25, 0.25, 0.0, False), "purity": (0.5, 0.5, 0.0, False)}


def test_entries_of_replies_stand_alone(spark):
    read = lambda reply: spark.range(1).select(parse.graded(F.lit(reply), ["a", "b"], {}, ["t", "other"]).alias("g")).first()["g"]
    assert [r["i"] for r in read('[{"i": 1, "a": 2}, 5, "x", null, [1], {"a": 1}, {"i": "2"}]')] == [1, 2]
    assert [(r["i"], r["a"]["level"]) for r in read('[{"i": 1, "a": 2}, {"i": 1, "a": {"level": 1}}]')] == [(1, 1)]
    assert [(r["a"]["level"], r["b"]["level"]) for r in read('[{"i": 1, "a": 3}, {"i": 2, "b": "50"}, {"i": 3, "a": "2", "b": {"level": null}}]')] == [(3, 3), (0, 2), (2, 2)]
    assert read(None) == [] and read("none") == [] and read("[oops") == [] and read("[1, 2") == []


def test_fields_of_graded_replies_are_read_once(spark, sf):
    plan = more.QUERIES["graded_replies"][0](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("get_json_object") <= 9  # i, rel, gen, kind, tags; level and why of either axis
    for told, want in (("1e300", 3), ("-1e300", 0), ("Infinity", 1), ("NaN", 1)):
        assert spark.range(1).select(parse.level(F.lit(told), 1)).first()[0] == want


def test_last_entries_of_a_long_reply_count(spark, sf):
    plan = more.QUERIES["tolerant_replies"][0](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("get_json_object") <= 20  # 11 fields, level and why of four axes, provisional of one
    told = [(n * 7 % 1500, n % 4) for n in range(5000)]
    reply = "[" + ", ".join(f'{{"i": {i}, "a": {a}}}' for i, a in told) + "]"
    got = spark.createDataFrame([(reply,)], "r string").select(parse.graded(F.col("r"), ["a"], {}, ["other"]).alias("g")).first()["g"]
    last = {i: n for n, (i, _) in enumerate(told)}
    assert [(r["i"], r["a"]["level"]) for r in got] == [x for n, x in enumerate(told) if last[x[0]] == n]


def test_tags_keep_the_vocabulary_order(spark):
    v = spark.createDataFrame([(1, 0, ["d", "b", "a", "c"]), (1, 1, ["d", "c", "b", "zz"]), (2, 0, ["zz"]), (3, 0, None)], "k int, who int, tags array<string>").withColumns({"l": F.lit(1), "f": F.lit(None).cast("boolean"), "c": F.concat(F.lit("x"), F.col("who").cast("string"))})
    got = {r["k"]: r for r in votes.merge_votes(v, "k", ["l"], ["f"], "tags", "l", {"c": ([], None)}, vocabulary=["a", "b", "c", "d", "other"]).collect()}
    assert {k: r["tags"] for k, r in got.items()} == {1: ["a", "b", "c"], 2: ["other"], 3: ["other"]} and got[1]["c"] == "x0"


def test_numbers_by_ranges(spark):
    df = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "k int, i int").repartition(5)
    assert [r["n"] for r in rank.numbered(df, [F.desc("k")], "n").orderBy(F.desc("k")).collect()] == list(range(50))
    assert rank.numbered(df.limit(0), [F.col("k")], "n").collect() == []
    got = views.batches(df, [F.col("k")], 8).orderBy("k").collect()
    assert [(r["batch"], r["item"]) for r in got] == [(i // 8, i % 8) for i in range(50)]


def folded(paragraphs, full, least):
    """Passages of one section, one paragraph after the other."""
    out, held, n, no = [], [], 0, 0
    for t in [*paragraphs, None]:
        if t is not None:
            held.append(t)
            n += len(t.split())
        if n >= full or t is None:
            if held and n >= least:
                out.append((no, " ".join(held), n))
            held, n, no = [], 0, no + 1
    return out


def test_fold_against_a_loop(spark):
    rng = random.Random(2)
    texts = {(k, s): [" ".join(["w"] * rng.choice([0, 1, 5, 30])) for _ in range(rng.randint(1, 60))] for k in (1, 2, None) for s in ("a", None)}
    rows = [(k, s, i, t) for (k, s), own in texts.items() for i, t in enumerate(own)] + [(1, "a", 999, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, s string, o int, t string")
    got = {}
    for r in passages.fold(df, "k", "s", "o", "t", 40, 10).collect():
        got.setdefault((r["k"], r["s"]), []).append((r["passage"], r["text"], r["words"]))
    assert {x: sorted(y) for x, y in got.items()} == {x: y for x, own in texts.items() if (y := folded(own, 40, 10))}
    assert passages.fold(df.limit(0), "k", "s", "o", "t").collect() == []


def test_passages_meet_their_own_question_only(spark):
    p = "array<struct<s: string, t: string>>"
    df = spark.createDataFrame([(1, "a", 2, [("s", "same"), ("s", "")]), (1, "b", 1, [("s", "same")]), (2, "a", 1, [("s", "same"), ("s", None)])], f"q int, k string, r int, p {p}")
    assert sorted((r["q"], r["k"]) for r in passages.explode_passages(df, "k", "p", ("q",), ("r",)).collect()) == [(1, "b"), (2, "a")]
    assert [r["k"] for r in passages.explode_passages(df, "k", "p").collect()] == ["a"]


def test_prior_art_of_nothing(spark):
    known = spark.createDataFrame([], "pos int, title string, authors string, year int, note string, cites int")
    canon = spark.createDataFrame([(2, "M2", "Method", None), (1, "M1", "Method", "why"), (0, "T", "Theory", "no")], "pos int, title string, kind string, why string")
    assert portal.prior_art(known, canon).first()["block"] == "- M1: why\n- M2: "
    assert portal.prior_art(known, canon.limit(0)).first()["block"] == ""


def test_members_without_keys(spark, tmp_path):
    """Words are looked for in lower-cased texts, as in their keys, which aren't made for every word again."""
    from paperloom.functions import text
    from paperloom.plans import closeness

    texts = ["The End", "the-end", "the\nend", "bathe é", "THE", "queñ", "que n", "a-b c", "a.b c", "x Émention", None, "", "the😀", "breathe İ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    low, key = F.lower(text.filled(F.col("text"))), text.title_key_hyphens(F.col("text"))
    for part in ["the ", "queñ", "ment", "a-b", "e e", "b c", " "]:
        assert rows.filter(~closeness._holds(low, part).eqNullSafe(F.contains(key, F.lit(part)))).count() == 0, part
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = closeness._members(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(0, "g4"), (1, "odd"), (2, "g4"), (3, "g4"), (9, "g2"), (12, "g4"), (13, "g4")]
    assert "regexp_replace" not in got._jdf.queryExecution().toString()


def test_scan_by_a_bounded_number_of_tasks(spark, monkeypatch):
    """Rows of many partitions are written once and scanned by few tasks, in blocks, with ties, kins and absent values."""
    rng = np.random.default_rng(3)
    m = rng.integers(-2, 3, (400, 3)).astype(float)
    m[7, 1] = np.nan
    rows = spark.createDataFrame([(i, m[i].tolist(), i % 60) for i in range(400)], "id long, v array<double>, kin long").repartition(64)
    scans = []
    block = nearest._block
    monkeypatch.setattr(nearest, "_block", lambda r, *a: scans.append((r.rdd.getNumPartitions(), "RepartitionByExpression" in r._jdf.queryExecution().toString() or "Repartition 64" in r._jdf.queryExecution().toString())) or block(r, *a))
    monkeypatch.setattr(nearest, "QUERIES", 3)
    for kin, others in (("kin", False), (None, True)):
        got = {(r["query"], r["rank"]): (r["id"], r["sim"]) for r in nearest.nearest(rows, rows.filter("id % 50 = 1"), "id", "v", 7, 6, kin=kin, others=others).collect()}
        want = {}
        for q in range(1, 400, 50):
            seen, place = set(), 0
            for s, i in sorted((-float(m[q] @ m[i]), i) for i in range(400) if i != 7 and not (others and i == q)):
                if (kin and i % 60) not in seen and place < 7:
                    place += 1
                    want[q, place] = i, -s + 0.0
                    if kin:
                        seen.add(i % 60)
        assert got == want
    assert len(scans) >= 4 and all(n <= max(nearest.TASKS, spark.sparkContext.defaultParallelism) and not again for n, again in scans)

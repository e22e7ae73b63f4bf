import math
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from paperloom.llm import queries, rules

SPACE = " \t\n\x0b\x0c\r"


def words_of(t):
    return [w for w in "".join(" " if c in SPACE else c for c in t or "").split(" ") if w]


def brute(t):
    w = words_of(t)
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


CASES = [None, "", " \n\n ", "one", "a b c", "a a a a a", "a b c a b c", "x y\nx y\n \nx y \r\nx y", "é # €  b\x1cc | <>" * 3, "w " * 40000, " ".join(map(str, range(5000))) + " 7 8 9", "\n".join(["same line here"] * 30)]


def test_statistics(spark):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(CASES)], "doc_id int, text string, n_words int")
    got = rules.text_statistics(df, "text").orderBy("doc_id").collect()
    for t, r in zip(CASES, got):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(t), repr(t)[:60]
    assert rules.text_statistics(df.limit(0), "text").count() == 0


def test_binomial_tail(spark):
    cases = [(k, n, p) for p in (0.005, 0.02, 0.3) for n in (1, 10, 500, 3000) for k in (0, 1, 3, 10, 14) if k <= n]
    for p in (0.005, 0.02, 0.3):
        own = [(k, n) for k, n, q in cases if q == p]
        df = spark.createDataFrame(own, "k long, n long").withColumn("t", rules.binomial_tail(F.col("k"), F.col("n"), p))
        for r in df.collect():
            exact = sum(math.comb(r["n"], j) * p ** j * (1 - p) ** (r["n"] - j) for j in range(r["k"] + 1)) if r["n"] <= 500 else math.fsum(math.exp(math.lgamma(r["n"] + 1) - math.lgamma(j + 1) - math.lgamma(r["n"] - j + 1) + j * math.log(p) + (r["n"] - j) * math.log1p(-p)) for j in range(r["k"] + 1))
            assert r["t"] == (1 if r["k"] > r["n"] * p else pytest.approx(exact, rel=1e-8))


def labelled(spark, n=6000):
    rows = []
    for i in range(n):
        bad = i % 10 == 0
        body = " ".join(f"word{(i * 31 + k * 7) % 997}x{k}" + ("%%" if bad or (i % 500 == 1 and k % 3 == 0) else "") for k in range(60))
        rows.append((i, body, "en" if i % 4 else None, 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")


def test_cutoffs_hold_on_the_holdout_and_reject_junk(spark):
    df = labelled(spark)
    out = rules.risk_controlled(df.drop("quality"), "doc_id", "text", "lang", df.select("doc_id", "quality"))
    got = {(r["lang"], r["quality"]): (r["n"], r["kept"]) for r in out.join(df.select("doc_id", "quality"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"), F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert got["en", 0][1] == 0 and got["en", 1][1] >= 1 - len(rules.GRID) * rules.RISK
    assert got[None, 1][1] >= 0.98


def test_few_labels_certify_nothing(spark):
    df = labelled(spark, 200)
    out = rules.risk_controlled(df, "doc_id", "text", "lang", df.select("doc_id", "quality"), keep_text=True)
    assert out.filter("kept").count() == 200 and set(df.columns) <= set(out.columns)
    none = rules.risk_controlled(df.limit(0), "doc_id", "text", "lang", df.select("doc_id", "quality").limit(0))
    assert none.count() == 0


def by_sql(tables):
    """Columns and sorted rows of the query's SQL over tables given as names and files."""
    con = duckdb.connect()
    for name, files in tables.items():
        con.sql(f"create view {name} as select * from '{files}'")
    want = con.sql(queries.oracle_sql()["op8_rules"])
    return want.columns, sorted(want.fetchall())


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.01"
    columns, want = by_sql({f[:-8]: f"{sf}/{f}" for f in os.listdir(sf)})
    assert want == sorted(tuple(r[c] for c in columns) for r in queries.quality_rules(spark, sf).collect())


def test_sql_agrees_where_cutoffs_are_certified(spark, tmp_path):
    """Two strata with more good labels than a cutoff needs, one with too few; some labels are missing."""
    df = labelled(spark).withColumn("lang", F.when(F.col("doc_id") % 50 == 3, "fr").otherwise(F.col("lang")))
    df.select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    df.filter("doc_id % 13 <> 5").select("doc_id", "quality").write.parquet(f"{tmp_path}/labels.parquet")
    columns, want = by_sql({t: f"{tmp_path}/{t}.parquet/*.parquet" for t in ("documents", "labels")})
    got = queries.quality_rules(spark, str(tmp_path)).collect()
    assert want == sorted(tuple(r[c] for c in columns) for r in got)
    lang = {r["doc_id"]: r["lang"] for r in df.select("doc_id", "lang").collect()}
    rejected = [lang[r["doc_id"]] for r in got if not r["kept"] and not r["base_failed"]]
    assert {"en", None} <= set(rejected) and "fr" not in rejected

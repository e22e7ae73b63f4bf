import random
import re

import pytest

from paperloom.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def corpus(spark, seed=1, n=900):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["b", "a", "a", "a", "a", "é", "Z", None, "tiny"] if i % 50 else ["tiny"])
        text = None if i % 97 == 0 else " ".join("w" for _ in range(int(rng.paretovariate(1.2) * 3)))
        rows.append((i, text, source if source != "tiny" or i % 10 == 0 else "a", 0.5))
    return spark.createDataFrame([*rows, rows[5], rows[5]], "doc_id long, text string, source string, rate double")


def test_mix(spark):
    df = corpus(spark)
    got = mixing.mix(df, "doc_id", "text", "source").collect()
    assert len(got) == df.count()
    sizes, taken, largest = {}, {}, {}
    for r in got:
        assert r["size"] == len(re.findall(r"\S+", r["text"] or "")) and r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    want = brute_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s]
    again = mixing.mix(df.repartition(7), "doc_id", "text", "source").collect()
    key = lambda rs: sorted((r["doc_id"], r["taken"], r["target"]) for r in rs)
    assert key(got) == key(again)


def test_rates_are_tilted_and_meet_the_constraints(spark):
    rows = spark.createDataFrame([(str(i % 2), s, 0.5) for i, s in enumerate([1, 5, 9, 20, 50, 80, 100, 300] * 20)], "source string, size long, draw double")
    plan = {r["source"]: r for r in mixing.balance(rows, mixing.targets(rows)).collect()}
    for source, p in plan.items():
        own = [r["size"] for r in rows.collect() if r["source"] == source]
        import math
        words = sum(s * min(3.0, math.exp(p["multiplier"] * s / p["mean"])) for s in own)
        assert words == pytest.approx(p["target"], rel=1e-5)


def test_edge_tables(spark):
    for rows in ([], [(1, None, None, 1.0)], [(1, "a b", "x", 1.0)], [(1, "", "x", 1.0), (2, "a", "x", 1.0)]):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, rate double")
        got = mixing.mix(df, "doc_id", "text", "source").collect()
        assert len(got) == len(rows) and all(r["taken"] == r["size"] for r in got)

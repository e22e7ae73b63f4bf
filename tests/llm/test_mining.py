"""Hard negatives against a search over all rows, and the tree's bounds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import mining

SCHEMA = "vec_id long, embedding array<float>, label int, score long, query int"


def brute(rows, anchor, positives=5, negatives=10, low=30, high=90):
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (i, lab, v) in enumerate(kept):
        if not anchor(i):
            continue
        scored = sorted((-dot(v, w), j, m, l2 == lab) for m, (j, l2, w) in enumerate(kept) if m != n)
        for s, j, _, _ in [x for x in scored if x[3]][:positives]:
            fits = [x for x in scored if not x[3] and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k, _, _) in enumerate(fits, 1)]
    return sorted(out)


def rows_of(seed, n, width, labels=10, values=None, shift=0.0):
    rng = random.Random(seed)
    value = (lambda: rng.choice(values)) if values else (lambda: rng.uniform(-1, 1) + shift)
    single = lambda x: float(np.float32(x))
    return [(i, [single(value()) for _ in range(width)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize(("rows", "every", "blocks"), [
    (rows_of(1, 600, 8), 20, (64, 16)),
    (rows_of(2, 500, 4, 3, [0.0, 0.25, 0.5]), 25, (100, 8)),  # many ties
    (rows_of(3, 300, 6, 2, shift=0.7), 10, (512, 4)),
    ([(i, [0.5] * 4, i % 2) for i in range(200)] + [(1000 + i, v, lab) for i, v, lab in rows_of(4, 200, 4, 2)], 50, (64, 8)),  # one vector is half of all rows
    ([(7, [0.5, 0.25], 1)] * 30 + [(8, [0.25, 0.25], 2)] * 30, 7, (16, 4)),  # repeated rows, anchors among them
    (rows_of(5, 40, 3, 1), 1, (16, 4)),  # one label: no negatives
    (rows_of(6, 60, 2) + [(None, [1.0, 1.0], 1), (100, None, 2), (200, [math.nan, 0.0], 3), (300, [0.1, None], 4), (400, [0.1, 0.2], None), (500, [math.inf, 0.0], 1)], 10, (32, 8)),
])
def test_against_all_rows(spark, monkeypatch, rows, every, blocks):
    for name, value in zip(("BLOCK", "LEAF", "ANCHORS"), (*blocks, 7)):
        monkeypatch.setattr(mining, name, value)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(2)
    got = mining.hard_negatives(df, "vec_id", "embedding", "label", F.col("vec_id") % every == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % every == 0)


def test_nothing_to_mine(spark):
    df = spark.createDataFrame([(1, [0.5], 1, 1, 2)], SCHEMA)
    assert mining.hard_negatives(df.limit(0), "vec_id", "embedding", "label", F.lit(True)).collect() == []
    assert mining.hard_negatives(df, "vec_id", "embedding", "label", F.lit(False)).collect() == []
    assert mining.hard_negatives(df, "vec_id", "embedding", "label", F.lit(True)).collect() == []


def test_bounds_prune():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 8)) * 200
    x = np.floor(np.repeat(centers, 50, 0) + rng.normal(size=(2000, 8)) * 5).astype(np.int64)
    labels = np.repeat(np.arange(40), 50) % 7
    tree = mining.BallTree(x, np.arange(2000), labels, np.arange(2000))
    some = np.arange(0, 2000, 100)
    low, high = np.full(20, mining.LEAST), np.full(20, mining.MOST)
    best = mining.Best(20, 5)
    computed = mining.search(tree, x[some], labels[some], some, True, low, high, best)
    assert computed < 20 * 2000 / 3
    for q, r in enumerate(some):
        want = sorted((-int(x[r] @ x[i]), i) for i in range(2000) if i != r and labels[i] == labels[r])[:5]
        assert list(zip((-best.score[q]).tolist(), best.id[q].tolist())) == want
    for a, b, *_ in tree.nodes:
        assert a < b
    for (a, b, *_), c, r in zip(tree.nodes, tree.centers, tree.radii):
        assert np.sqrt(((tree.x[a:b] - c) ** 2).sum(1)).max() <= r * (1 + 1e-12) + 1e-9


def test_large_components():
    x = np.array([[2**30, 1], [2**30, 2], [-(2**30), 3]])
    tree = mining.BallTree(x, np.arange(3), np.array([0, 0, 1]), np.arange(3))
    best = mining.Best(1, 2)
    mining.search(tree, x[:1], np.array([0]), np.array([0]), True, np.full(1, mining.LEAST), np.full(1, mining.MOST), best)
    assert best.score[0, 0] == 2**60 + 2 and best.score[0, 1] == mining.LEAST
    with pytest.raises(OverflowError):
        mining.search(tree, x[:1] * 8, np.array([0]), np.array([0]), True, np.full(1, mining.LEAST), np.full(1, mining.MOST), best)

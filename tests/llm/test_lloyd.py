"""Vector codes against Lloyd's rounds in plain Python integers."""

import hashlib
import math
import random

import pytest

from paperloom.llm import lloyd

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int"


def brute(rows, parts, entries, rounds, scale):
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, p: min((far(x, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        own = [[[] for _ in first] for _ in range(parts)]
        for _, v, _ in kept:
            for p in range(parts):
                own[p][near(cut(v, p), p)[1]].append(cut(v, p))
        books = [[[sum(x) // len(g) for x in zip(*g)] if g else books[p][e] for e, g in enumerate(own[p])] for p in range(parts)]
    out = [(i, [near(cut(v, p), p) for p in range(parts)], lab) for i, v, lab in kept]
    total = {}
    for _, found, lab in out:
        total[lab] = total.get(lab, 0) + sum(d for d, _ in found)
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), total[lab], sha) for i, found, lab in out), key=str)


def rows_of(seed, n, width, values=None):
    rng = random.Random(seed)
    value = (lambda: rng.choice(values)) if values else (lambda: round(rng.uniform(-1, 1), 3))
    return [(i * 3 % n, [value() for _ in range(width)], rng.choice([None, 0, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("rows", [
    rows_of(1, 200, 16),
    rows_of(2, 150, 8, [0.0, 0.5, -0.5]),  # ties between entries, and equal ones
    rows_of(3, 9, 8),  # fewer rows than entries
    [(7, [0.25] * 8, 1)] * 90 + rows_of(4, 60, 8),  # one vector and id has most rows
    rows_of(5, 40, 8) + [(1, None, 1), (2, [None] * 8, 1), (3, [math.inf] + [0.0] * 7, 2), (4, [math.nan] * 8, None), (None, [0.1] * 8, None), (-5, [0.3] * 8, 3)],
])
def test_against_plain_rounds(spark, rows):
    import struct
    single = lambda x: x if x is None or not math.isfinite(x) else struct.unpack("f", struct.pack("f", x))[0]
    rows = [(i, v and [single(x) for x in v], lab) for i, v, lab in rows]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = lloyd.coded(df, "vec_id", "embedding", "label")
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 8, 16, 6, 4096)


def test_only_changed_parts_are_summed(spark):
    table = spark.createDataFrame([([1, 2, 3, 4], [0, 1], [0, 1]), ([5, 6, 7, 8], [0, 1], [1, 1]), ([9, 1, 2, 3], None, [1, 0])], "vector array<bigint>, old array<int>, code array<int>")
    got = {(r["p"], r["entry"]): (r["n"], r["s0"], r["s1"]) for r in lloyd._changes(table, 2, 2).collect()}
    assert got == {(0, 0): (-1, -5, -6), (0, 1): (2, 14, 7), (1, 0): (1, 2, 3)}


def test_empty_lengths_and_overflow(spark):
    empty = spark.createDataFrame([], SCHEMA)
    got = lloyd.coded(empty, "vec_id", "embedding", "label")
    assert got.collect() == [] and got.columns[0] == "vec_id"
    assert lloyd.coded(spark.createDataFrame([(1, None, 1, "", 1)], SCHEMA), "vec_id", "embedding", "label").collect() == []
    with pytest.raises(ValueError, match="one length"):
        lloyd.coded(spark.createDataFrame([(1, [0.1] * 8, 1, "", 1), (2, [0.1] * 16, 1, "", 1)], SCHEMA), "vec_id", "embedding", "label")
    with pytest.raises(Exception, match="fit into a long|overflow|OVERFLOW"):
        lloyd.coded(spark.createDataFrame([(1, [3e30] * 8, 1, "", 1)], SCHEMA), "vec_id", "embedding", "label").collect()

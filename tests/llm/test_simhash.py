import random

import numpy as np
import xxhash

from paperloom.llm import graph, simhash


def brute_fingerprint(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({i: " " for i in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(50)) for _ in range(300)) for _ in range(12)]
    texts = list(base)
    for t in base[:6]:
        for _ in range(6):
            w = t.split()
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = f"other{rng.randrange(9)}"
            texts.append(" ".join(w))
    texts += [base[0], base[0].upper(), None, "", " \t\n", "one", "One two", "École école ÉCOLE", "a\x1cb c d e", base[3]]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    prints = {i: brute_fingerprint(t, 3) for i, t in rows}
    near = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3]
    want = {i: (f"{prints[i]:016x}", c) for i, c in classes(near, prints).items()}
    assert any(bin(prints[a] ^ prints[b]).count("1") in (1, 2, 3) for a, b in near)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df, "doc_id", "text", 3).collect()}
    assert got == want
    assert simhash.near_duplicates(df.limit(0), "doc_id", "text", 3).count() == 0


def test_links_are_exact(spark):
    rng = random.Random(9)
    prints = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        prints.add(f)
        for _ in range(4):
            g = f
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                g ^= 1 << b
            prints.add(g)
            f = g if rng.random() < 0.5 else f
    signed = [simhash._signed(f) for f in prints]
    df = spark.createDataFrame([(f,) for f in signed], "f long")
    kept = {r["f"] for r in simhash.with_neighbours(df).collect()}
    near = [(simhash._signed(a), simhash._signed(b)) for a in prints for b in prints if a != b and bin(a ^ b).count("1") <= 3]
    assert {x for p in near for x in p} <= kept
    edges = [(r["a"], r["b"]) for r in simhash.links(df).collect()]
    assert all(np.bitwise_count(np.uint64((a ^ b) & (1 << 64) - 1)) <= 3 for a, b in edges)
    assert classes(edges, signed) == classes(near, signed)


def test_connected_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7), (500, 200)]
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    df = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(df).collect()}
    assert got == {n: c for n, c in classes(pairs, nodes | {7}).items() if n in nodes}
    assert graph.connected_components(df.limit(0)).count() == 0


def test_similar_classes_catch_copies_and_leave_others(spark, sf):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, want = [], {}
    for g in range(30):
        base = [word() for _ in range(400)]
        for c in range(4):
            w = list(base)
            for _ in range(c * 2):
                w[rng.randrange(400)] = word()
            rows.append((100 * g + c, " ".join(w), "s"))
            want[100 * g + c] = 100 * g
    alone = [(10_000 + i, " ".join(word() for _ in range(200)), "s") for i in range(40)]
    df = spark.createDataFrame([*rows, *alone, (20_000, None, "s"), (None, "odd one", "s")], "doc_id long, text string, source string")
    got = {r["id"]: r["component_id"] for r in simhash.similar_classes(df, "doc_id", "text").collect()}
    assert got == want
    kept = {r["doc_id"] for r in simhash.keep_one_of_each(df, "doc_id", "text").collect()}
    assert kept == {100 * g for g in range(30)} | {a[0] for a in alone} | {20_000, None}


def jaccard(a, b, words=5):
    x, y = set(simhash.shingles_of(a.encode(), words)), set(simhash.shingles_of(b.encode(), words))
    return len(x & y) / len(x | y)


def brute_classes(rows):
    pairs = [(a, b) for a, x in rows for b, y in rows if a < b and jaccard(x, y) >= 0.8]
    linked = classes(pairs, [i for i, _ in rows])
    return pairs, {i: linked[i] for p in pairs for i in p}


def similar(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["id"]: r["component_id"] for r in simhash.similar_classes(df, "doc_id", "text").collect()}


def changed(rng, text, at):
    w = text.split()
    for i in at:
        w[i] = f"new{rng.getrandbits(40)}"
    return " ".join(w)


def test_true_copies_among_siblings_below_the_threshold(spark):
    rng = random.Random(11)
    template = " ".join(f"t{i}" for i in range(200))
    siblings = [changed(rng, template, range(164, 200)) for _ in range(150)]  # alike by 0.69
    copies = [changed(rng, t, range(12, 26)) for t in siblings[100:]]  # alike to one by 0.84
    rows = list(enumerate(siblings + copies))
    pairs, want = brute_classes(rows)
    assert pairs == [(100 + i, 150 + i) for i in range(50)] and 0.6 < jaccard(siblings[0], siblings[1]) < 0.75
    assert similar(spark, rows) == want


def test_repeated_passages_count_once(spark):
    rng = random.Random(12)
    rows = []
    for i in range(40):
        w = [f"w{rng.getrandbits(40)}" for _ in range(404)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:100] + w[50:100] * 5 + w[100:]))]
    assert all(jaccard(rows[2 * i][1], rows[2 * i + 1][1]) > 0.95 for i in range(40))
    assert similar(spark, rows) == {i: i // 2 * 2 for i in range(80)}


def test_pairs_at_the_threshold_against_brute_force(spark):
    rng = random.Random(13)
    rows = []
    for i in range(150):
        base = " ".join(f"w{rng.getrandbits(40)}" for _ in range(rng.randrange(150, 300)))
        n = len(base.split())
        at = rng.randrange(20, n // 2)
        rows += [(2 * i, base), (2 * i + 1, changed(rng, base, range(at, at + int(n * rng.uniform(0.06, 0.11)))))]
    pairs, want = brute_classes(rows)
    assert sum(jaccard(dict(rows)[a], dict(rows)[b]) < 0.85 for a, b in pairs) > 60 and len(pairs) < 150
    assert similar(spark, rows) == want


def test_a_large_group_of_different_copies_needs_few_comparisons(spark):
    n, compared = 3000, []
    # sets of 100 shingles: 90 that all share, one of two halves of 5, and 5 of their own; halves are alike by less than 0.9
    rows = [(f"{k}", i, 100, pos) for i in range(n) for pos, k in enumerate([*(f"own {i} {j}" for j in range(5)), *(f"half {i % 2} {j}" for j in range(5)), *range(11)])]
    entries = spark.createDataFrame(rows, "name string, id long, size int, pos int").selectExpr("xxhash64(name) as key", "id", "size", "pos")
    entries = simhash.materialise(entries)

    def verify(pairs):
        compared.append(pairs.count())
        return pairs.filter("(b - a) % 2 = 0")
    edges = [(r["a"], r["b"]) for r in simhash.similar_links(entries, 0.8, verify).collect()]
    assert classes(edges, range(n)) == {i: i % 2 for i in range(n)}
    # the halves, which differ, are compared in full; pairs of one half are not
    assert sum(compared) <= n * n / 4 + 20 * n


def test_a_shingle_of_thousands_of_unrelated_rows(spark, monkeypatch):
    """What is common isn't known beforehand, so it stands in many prefixes; unrelated rows that share it alone aren't compared."""
    monkeypatch.setattr(simhash, "COUNTED", 1)
    monkeypatch.setattr(simhash, "EVERY", 10_000)
    monkeypatch.setattr(simhash, "HOT", 30)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    compared = []
    plain = simhash._perhaps
    monkeypatch.setattr(simhash, "_perhaps", lambda rows, wanted: compared.append(wanted.count()) or plain(rows, wanted))
    rng = random.Random(21)
    word = lambda: f"w{rng.getrandbits(40)}"
    hot = "this line is in all of them"
    rows = []
    for i in range(0, 3000, 2):
        w = [word() for _ in range(rng.randrange(10, 40))]
        rows += [(i, f"{hot} {' '.join(w)}"), (i + 1, f"{hot} {' '.join(w[:-1])} {word()}" if i % 10 == 0 else f"{' '.join(word() for _ in range(20))} {hot}")]
    want = {x: i for i in range(0, 3000, 10) if jaccard(rows[i][1], rows[i + 1][1]) >= 0.8 for x in (i, i + 1)}
    assert len(want) > 300 and similar(spark, rows) == want
    assert sum(compared) < 40 * len(rows)


def test_keys_told_apart_by_a_second_one(spark, monkeypatch):
    """Keys of all rows with few pairs in common, and hot keys whose rows are all alike, against all pairs."""
    for name, value in (("HOT", 5), ("BLOCK", 4), ("PIVOTS", (1, 1))):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(22)
    sets = {i: ["a", "b"] + [f"k{rng.randrange(12)}" for _ in range(4)] + [f"s{i // 3}"] for i in range(90)}
    rows = [(k, i, 100, pos) for i, own in sets.items() for pos, k in enumerate(dict.fromkeys(sorted(own)))]
    entries = simhash.materialise(spark.createDataFrame(rows, "name string, id long, size int, pos int").selectExpr("xxhash64(name) as key", "id", "size", "pos"))
    alike = lambda a, b: len(set(sets[a]) & set(sets[b])) >= 4
    good = [(a, b) for a in sets for b in sets if a < b and alike(a, b)]
    table = spark.createDataFrame(good, "a long, b long")
    got = [(r["a"], r["b"]) for r in simhash.similar_links(entries, 0.8, lambda pairs: pairs.join(table, ["a", "b"], "left_semi")).collect()]
    assert set(got) <= set(good) and classes(got, sets) == classes(good, sets)

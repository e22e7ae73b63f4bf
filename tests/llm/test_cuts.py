"""Sharding of linked rows against the exact best balanced cut."""

import random
from itertools import combinations

import pytest

from paperloom.llm import shard


def cut(links, where):
    """Pairs of rows that share a link and are in different shards."""
    by = {}
    for row, link in links:
        by.setdefault(link, []).append(row)
    return sum(where[a] != where[b] for own in by.values() for a, b in combinations(own, 2))


def pairs(edges):
    return [(r, f"{a}-{b}") for a, b in edges for r in (a, b)]


RINGS = [(a + i, a + (i + k) % 6) for a in (0, 6) for i in range(6) for k in (1, 2)] + [(0, 6)]
CHAINS = [(i, i + 1) for i in range(11)]


@pytest.mark.parametrize("edges", [RINGS, CHAINS])
def test_cut_against_the_best(spark, edges):
    links = pairs(edges)
    got = shard.propagate(spark.range(12).withColumnRenamed("id", "row"), spark.createDataFrame(links, "row long, link string"), 2).collect()
    where = {r["row"]: r["shard"] for r in got}
    assert sorted(where) == list(range(12)) and sum(where.values()) == 6
    best = min(cut(links, {r: int(r in half) for r in range(12)}) for half in map(set, combinations(range(12), 6)))
    start = cut(links, {r: r % 2 for r in range(12)})
    assert best <= cut(links, where) <= best + (start - best) / 4, (best, cut(links, where), start)


def test_communities_of_hidden_rows(spark):
    """Ten groups linked in chains and by few links across, with no row that is not linked."""
    group = {r: r // 20 for r in range(200)}
    own = {g: [r for r in group if group[r] == g] for g in range(10)}
    edges = [(rows[i], rows[(i + k) % 20]) for rows in own.values() for i in range(20) for k in (1, 2, 3)] + [(r, (r * 13 + 5) % 200) for r in range(0, 200, 10)]
    links = pairs([e for e in edges if e[0] != e[1]])
    got = shard.propagate(spark.range(200).withColumnRenamed("id", "row"), spark.createDataFrame(links, "row long, link string"), 5).collect()
    where = {r["row"]: r["shard"] for r in got}
    sizes = [list(where.values()).count(s) for s in range(5)]
    start = cut(links, {r: r % 5 for r in range(200)})
    planted = cut(links, {r: g // 2 for r, g in group.items()})
    assert sizes == [40] * 5 and cut(links, where) <= 2 * planted and start > 10 * planted, (planted, cut(links, where), start)


def test_many_communities(spark):
    """24 groups of 50 rows with random links inside, and few across, in eight shards."""
    rng = random.Random(1)
    edges = {tuple(sorted(rng.sample(range(50 * g, 50 * g + 50), 2))) for g in range(24) for _ in range(150)}
    edges |= {tuple(sorted(rng.sample(range(1200), 2))) for _ in range(60)}
    group = {r: r * 7 % 1200 for r in range(1200)}  # so that row numbers say nothing
    links = pairs([(group[a], group[b]) for a, b in edges])
    got = shard.propagate(spark.range(1200).withColumnRenamed("id", "row"), spark.createDataFrame(links, "row long, link string"), 8).collect()
    where = {r["row"]: r["shard"] for r in got}
    planted = cut(links, {group[r]: r // 150 for r in range(1200)})
    assert [list(where.values()).count(s) for s in range(8)] == [150] * 8 and cut(links, where) <= 2 * planted, (planted, cut(links, where))


def test_a_link_with_a_third_of_the_rows(spark):
    """It fills shards, and groups of copies and single rows go round it."""
    links = [(r, "hot") for r in range(0, 900, 3)] + [(r, f"g{r // 30}") for r in range(900) if r % 3 == 1]
    got = shard.propagate(spark.range(900).withColumnRenamed("id", "row"), spark.createDataFrame(links, "row long, link string"), 8).collect()
    where = {r["row"]: r["shard"] for r in got}
    assert sorted(list(where.values()).count(s) for s in range(8)) == [112] * 4 + [113] * 4
    hot = sorted(([where[r] for r in range(0, 900, 3)].count(s) for s in range(8)), reverse=True)
    assert hot[:3] == [113, 113, 74] or hot[:3] == [113, 112, 75]
    assert sum(len({where[r] for r in range(30 * g, 30 * g + 30) if r % 3 == 1}) > 1 for g in range(30)) <= 7

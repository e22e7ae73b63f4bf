"""Queries on neighbours of vectors."""

from __future__ import annotations

import string
from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import nearest

from .items import read

#: Groups by words in the texts, which overlap; two more go by label.
SEEDS = {"g1": ["einen", "schon"], "g2": ["ment", "tion"], "g3": ["queñ", "ción"], "g4": ["the "]}
_DOT = "list_dot_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE))"


def _vectors(spark, sf_dir, width=None):
    v = read(spark, sf_dir, "embeddings")
    cut = F.col("embedding") if width is None else F.slice("embedding", 1, width)
    return v.select("vec_id", "label", nearest.unit(cut).alias("v"))


def _holds(low, part: str):
    """Whether `text.title_key_hyphens` of a text holds `part`, from the lower-cased text: a space of the key is any
    character that the key doesn't keep, and what it doesn't keep is nowhere in it.  No key is made."""
    if not set(part) <= set(string.ascii_lowercase + string.digits + "- "):
        return F.lit(False)
    if " " not in part:
        return F.contains(low, F.lit(part))
    return F.rlike(low, F.lit(part.replace("-", r"\-").replace(" ", "[^a-z0-9-]")))


def _members(spark, sf_dir):
    groups = lambda low: F.array_compact(F.array(*[F.when(reduce(or_, [_holds(low, p) for p in seeds]), F.lit(g)) for g, seeds in SEEDS.items()]))
    # a text is lower-cased once, as a variable of a function, and an outer explode isn't looked into by a filter before it
    found = F.flatten(F.transform(F.array(F.lower(text.filled(F.col("text")))), groups))
    worded = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.explode_outer(found).alias("group")).filter("group is not null")
    return worded.unionByName(read(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("group")))


def _near(spark, sf_dir, width=None):
    v = _vectors(spark, sf_dir, width)
    return v, nearest.nearest(v, v.filter("vec_id % 50 = 0"), "vec_id", "v", 10, 6)


def _ranked(width=None) -> str:
    """Neighbours by rank for the ids that 50 divides."""
    cut = "embedding" if width is None else f"embedding[1:{width}]"
    return f"""u{width or ''} AS (SELECT vec_id, label, list_transform(e, lambda x: x / s) AS e FROM (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS s FROM (SELECT vec_id, label, list_transform({cut}, lambda x: x::DOUBLE) AS e FROM embeddings))),
    r{width or ''} AS (SELECT a.vec_id AS q, a.label AS ql, b.vec_id AS o, b.label AS ol, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.e, b.e), 6) DESC, b.vec_id) AS r
        FROM u{width or ''} a JOIN u{width or ''} b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY r <= 10)"""


_MEMBERS = "m AS (" + " UNION ALL ".join(
    "SELECT DISTINCT doc_id AS k, '{}' AS g FROM documents WHERE {}".format(g, " OR ".join(f"contains(regexp_replace(lower(text), '[^a-z0-9 -]', ' ', 'g'), '{p}')" for p in seeds)) for g, seeds in SEEDS.items()) + " UNION ALL SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END FROM embeddings)"


def _purity(width=None) -> str:
    return f"""SELECT g, avg(s) AS purity, count(*) AS n FROM (SELECT x.g, q, count(y.k) / 10.0::DOUBLE AS s FROM r{width or ''} JOIN m x ON x.k = q LEFT JOIN m y ON y.g = x.g AND y.k = o GROUP BY x.g, q) GROUP BY g HAVING n >= 4"""


def _coherence(width=None) -> str:
    return f"SELECT avg(s) FROM (SELECT q, count(*) FILTER (WHERE ql = ol) / 5.0::DOUBLE AS s FROM r{width or ''} WHERE r <= 5 AND ql IS NOT NULL GROUP BY q)"


def purity(spark, sf_dir):
    _, near = _near(spark, sf_dir)
    return nearest.purity(near, _members(spark, sf_dir), "vec_id", "group")


PURITY = f"WITH {_ranked()}, {_MEMBERS} SELECT g AS \"group\", round(purity, 6) AS purity, n FROM ({_purity()})"


def ab_gain(spark, sf_dir):
    """Whole vectors against their first 16 components."""
    members = _members(spark, sf_dir)
    scores = {}
    for name, width in (("narrow", 16), ("whole", None)):
        v, near = _near(spark, sf_dir, width)
        scores[name] = nearest.coherence(near, v, "vec_id", "label", 5), nearest.purity(near, members, "vec_id", "group")
    return nearest.gain(scores)


AB_GAIN = f"""WITH {_ranked(16)}, {_ranked()}, {_MEMBERS},
    s AS (SELECT 'coherence' AS metric, round(({_coherence(16)}), 6) AS a, round(({_coherence()}), 6) AS b UNION ALL
          SELECT 'purity', (SELECT avg(round(purity, 6)) FROM ({_purity(16)})), (SELECT avg(round(purity, 6)) FROM ({_purity()}))),
    p AS (SELECT *, round(100 * (b - a), 4) AS points FROM s)
    SELECT metric, round(a, 6) AS a, round(b, 6) AS b, points, (SELECT sum(points) > 1 FROM p) AS worth FROM p"""


def neighbours(spark, sf_dir):
    """Every fiftieth vector's ten nearest."""
    _, near = _near(spark, sf_dir)
    return near.select("query", "vec_id", "sim", "rank")


NEIGHBOURS = f"WITH {_ranked().replace('list_dot_product(a.e, b.e), 6) DESC, b.vec_id) AS r', 'list_dot_product(a.e, b.e), 6) DESC, b.vec_id)::INTEGER AS r, round(list_dot_product(a.e, b.e), 6) AS sim')} SELECT q AS query, o AS vec_id, sim, r AS rank FROM r"

QUERIES = {"knn_purity": (purity, PURITY), "ab_gain": (ab_gain, AB_GAIN), "knn_neighbours": (neighbours, NEIGHBOURS)}

"""Hard negatives by branch and bound over ball trees.

Every task builds ball trees over blocks of its rows and writes them.  Anchors come in chunks of a fixed number, which are
broadcast one after another; each task goes through its trees with all anchors of the chunk at once, and keeps for each
the best rows so far.  A node's ball bounds the inner product with an anchor from both sides: an anchor leaves a node whose
bounds lie outside its score window or strictly beneath its current kth score, or whose labels can't match.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release, shared_dir
from .lloyd import EXACT, whole_numbers
from .shard import numbered

#: Rows of a tree, of a leaf unless they are all equal, and of a leaf that are looked at together.
BLOCK, LEAF = 16_384, 64
#: Anchors of a chunk: what is broadcast and what a task keeps is bounded by these times their positives.
ANCHORS = 4096
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column's rows as 64-bit integers; shorter rows get zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class BallTree:
    """Nodes over rows in an order in which each node's rows stand together."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.leaf = leaf
        order = np.lexsort((rows, ids))  # equal vectors stand by id
        wide = x.astype(np.float64)
        self.nodes, centers, radii = [], [], []  # (start, end, left child or -1, right child, least and greatest label)
        todo = [(0, len(order), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = order[a:b]
            points = wide[own]
            center = points.mean(0)
            centers.append(center)
            radii.append(np.sqrt(((points - center) ** 2).sum(1).max()))
            me = len(self.nodes)
            self.nodes.append([a, b, -1, -1, int(labels[own].min()), int(labels[own].max())])
            if parent >= 0:
                self.nodes[parent][2 + side] = me
            spread = points.max(0) - points.min(0)
            if b - a > leaf and spread.max() > 0:
                axis = points[:, spread.argmax()]
                half = (b - a) // 2
                cut = np.partition(axis, half)[half]
                low = axis < cut
                if not low.any():  # over half of the rows have the least value
                    low = axis <= cut
                order[a:b] = np.concatenate([own[low], own[~low]])
                middle = a + int(low.sum())
                todo += [(a, middle, me, 0), (middle, b, me, 1)]
        top = int(np.abs(x).max(initial=0))
        self.top = top
        self.x = x[order].astype(np.int16 if top < 2**15 else np.int64)
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        self.centers, self.radii = np.array(centers), np.array(radii)


class Best:
    """The k best of what each query has seen: by score, then the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), LEAST, np.int64)
        self.id = np.full((queries, k), MOST, np.int64)
        self.row = np.full((queries, k), MOST, np.int64)
        self._held: list[tuple[np.ndarray, ...]] = []
        self._n = 0

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        self._held.append((query, score, ids, rows))
        self._n += len(query)
        if self._n >= self.score.size:
            self.settle()

    def settle(self) -> None:
        if not self._n:
            return
        query, score, ids, rows = (np.concatenate(x) for x in zip(*self._held))
        self._held, self._n = [], 0
        some = np.unique(query)
        query = np.concatenate([query, np.repeat(some, self.k)])
        score, ids, rows = (np.concatenate([new, old[some].ravel()]) for new, old in ((score, self.score), (ids, self.id), (rows, self.row)))
        order = np.lexsort((rows, ids, ~score, query))  # ~ turns the order round without overflow
        query = query[order]
        first = np.searchsorted(query, some)
        take = order[(first[:, None] + np.arange(self.k)[None, :]).ravel()]
        for new, old in ((score, self.score), (ids, self.id), (rows, self.row)):
            old[some] = new[take].reshape(len(some), self.k)


def search(tree: BallTree, q: np.ndarray, label: np.ndarray, row: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, best: Best) -> int:
    """Bring `best` up to date with the rows of `tree` that have the query's label (`same`) or another, a score from `low`
    to `high`, and are not the query's own `row`.  Gives the number of scores that were computed."""
    if tree.x.shape[1] * tree.top * int(np.abs(q).max(initial=0)) >= 2**62:
        raise OverflowError("inner products of these vectors don't fit into a long")
    kind = np.float64 if tree.x.shape[1] * tree.top * int(np.abs(q).max(initial=0)) < EXACT else np.int64
    exact, wide = q.astype(kind), q.astype(np.float64)
    norm = np.sqrt((wide * wide).sum(1))
    floor, ceiling = low.astype(np.float64), high.astype(np.float64)
    computed = 0
    todo = [(0, np.arange(len(q)))]
    while todo:
        at, active = todo.pop()
        a, b, left, right, least, most = tree.nodes[at]
        fit = (label[active] >= least) & (label[active] <= most) if same else ~((label[active] == least) & (least == most))
        active = active[fit]
        if not len(active):
            continue
        center, radius = tree.centers[at], tree.radii[at]
        mid = wide[active] @ center
        reach = norm[active] * radius
        reach += 1e-9 * (norm[active] * (np.sqrt(center @ center) + radius)) + 1e-6  # what rounding may add
        near = (mid + reach >= np.maximum(best.score[active, -1], floor[active])) & (mid - reach <= ceiling[active])
        active = active[near]
        if not len(active):
            continue
        if left >= 0:
            pair = (wide[active] @ tree.centers[left]).mean(), (wide[active] @ tree.centers[right]).mean()
            todo += [(x, active) for x in ((left, right) if pair[0] < pair[1] else (right, left))]
            continue
        for s in range(a, b, tree.leaf):
            e = min(b, s + tree.leaf)
            score = (exact[active] @ tree.x[s:e].astype(kind).T).astype(np.int64)
            computed += score.size
            ids, kth = tree.ids[s:e], best.score[active, -1][:, None]
            good = (score >= low[active][:, None]) & (score <= high[active][:, None]) & ((score > kth) | ((score == kth) & (ids[None, :] < best.id[active, -1][:, None])))
            good &= (tree.labels[s:e][None, :] == label[active][:, None]) == same
            good &= tree.rows[s:e][None, :] != row[active][:, None]
            i, j = np.nonzero(good)
            if len(i):
                best.add(active[i], score[i, j], ids[j], tree.rows[s:e][j])
    best.settle()
    return computed


def _trees(rows: DataFrame, width: int) -> DataFrame:
    """(tree) of the rows of each task, in blocks; pickled, for this module alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def made() -> pa.RecordBatch:
            tree = BallTree(*(np.concatenate(x) for x in zip(*held)), LEAF)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tree, 5)], pa.binary())], ["tree"])

        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                held.append((matrix(b.column(3), width), *(b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 0))))
                n += b.num_rows
                if n >= BLOCK:
                    yield made()
                    n = 0
        if n:
            yield made()

    return rows.select("row", "id", "label", "vector").mapInArrow(run, "tree binary")


#: What the task's trees give for each query: its number, and the rows found.
FOUND = "query long, score long, id long, row long"


def _ask(trees: DataFrame, queries: dict[str, np.ndarray], same: bool, k: int) -> DataFrame:
    """The `k` best rows for each query over all trees: FOUND and rank from 1."""
    sent = trees.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, best = sent.value, None
        for b in batches:
            for blob in b.column(0):
                best = best or Best(len(ask["row"]), k)
                search(pickle.loads(blob.as_py()), ask["vector"][ask["of"]], ask["label"][ask["of"]], ask["row"], same, ask["low"], ask["high"], best)
        if best is not None:
            query, at = np.nonzero(best.score != LEAST)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (query, best.score[query, at], best.id[query, at], best.row[query, at])], ["query", "score", "id", "row"])

    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")
    return trees.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(df: DataFrame, id_col: str, vector: str, label: str, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `anchor` is true.

    Vectors become floor(scale * x); a score is an inner product, higher ones come first, then smaller ids.  Positives are
    the first rows of the anchor's label but itself; negatives of each are the first rows of other labels whose score is
    from `low` to `high` hundredths of the positive's, so none if that is negative.  Rows with a null id or label, or a
    vector that is null or has a null or non-finite component, take no part; labels are whole numbers.  Repeated ids are
    rows like others: a copy of an anchor may be its positive.  Shorter vectors count as filled with zeros.  Anchors, in
    chunks of ANCHORS, and their positives are all that is sent to the driver and broadcast.
    """
    spark = df.sparkSession
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole_numbers(vector, scale).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = materialise(slim.filter("id is not null and label is not null and vector is not null").withColumn("row", F.monotonically_increasing_id()))
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    trees = materialise(_trees(rows, width))
    anchors = materialise(numbered(rows.filter("anchor"), [F.col("row")], [F.col("row")], "n").select("n", "row", "id", "label", "vector"))
    total = anchors.count()
    release(rows)
    path = f"{shared_dir(spark)}/paperloom/{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for chunk in count():
        if chunk * ANCHORS >= total:
            break
        some = anchors.filter(f"n >= {chunk * ANCHORS} and n < {(chunk + 1) * ANCHORS}").toArrow().sort_by("n").combine_chunks()
        own = {c: some[c].to_numpy() for c in ("id", "label", "row")}
        x = matrix(some["vector"].combine_chunks(), width)
        every = np.arange(len(x))
        ask = {"vector": x, "label": own["label"], "of": every, "row": own["row"], "low": np.full(len(x), LEAST), "high": np.full(len(x), MOST)}
        found = _ask(trees, ask, True, positives).toArrow().sort_by([("query", "ascending"), ("rank", "ascending")])
        of, score, ids = (found[c].to_numpy() for c in ("query", "score", "id"))
        if np.abs(score).max(initial=0) > 2**62 // 100:
            raise OverflowError("a hundred times these scores doesn't fit into a long")
        ask |= {"of": of, "row": own["row"][of], "low": -(-low * score // 100), "high": high * score // 100}
        named = spark.createDataFrame(pa.table({"query": np.arange(len(of)), "anchor_id": own["id"][of], "positive_id": ids, "positive_score": score}), "query long, anchor_id long, positive_id long, positive_score long")
        mined = _ask(trees, ask, False, negatives).join(F.broadcast(named), "query")
        mined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{path}/chunk={chunk}")
    if not total:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/chunk={c}" for c in range(-(-total // ANCHORS))])

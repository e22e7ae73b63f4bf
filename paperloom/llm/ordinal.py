"""Toxicity: a cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w . x - theta_k) with one weight vector for all thresholds, which are ordered.  Features are the
presence of words and of word beginnings.  Labels say only toxic or not.  The grades 1 to 3 of toxic documents are the
thirds of the log-odds of their features, each learnt from the half of the documents that the document is not in; the
regression sees only which features a document has, and no log-odds.  Features are counted over a bounded sample of the
labelled documents, and the regression is fitted on a smaller one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, materialise, release, utf8
from .textvec import LETTERS_AND_DIGITS, Words, chunks

GRADES = 3
PREFIXES = (4, 5, 6)
#: A feature counts if it is in this share of the toxic labelled documents (and three of them): at most the mean number
#: of a document's features divided by it can be, whatever the number of documents.
LEAST_SHARE, LEAST_DOCS = 0.003, 3
LIFT, Z = 4.0, 4.0
#: About how many labelled documents' features are counted, and on how many the regression is fitted, toxic or not each:
#: if there are more, those whose hash of the id is below the share wanted.  Only their texts leave the scan.
COUNTED, SAMPLE = 60_000, 15_000


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and word beginning, repeats included."""
    w = Words(texts, LETTERS_AND_DIGITS)
    hashed = w.hashes(*PREFIXES)
    owner, feature = np.concatenate([w.owner] * len(hashed)), np.concatenate(hashed)
    ok = feature != 0
    return owner[ok], feature[ok].view(np.int64)


def _document_counts(df: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """(feature, toxic, half, n): in how many documents (columns t, toxic, half) a feature is; only `wanted` ones, if given."""
    shared = None if wanted is None else df.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").to_pylist()
            kind = 2 * np.array(batch.column("toxic").to_pylist(), int) + np.array(batch.column("half").to_pylist(), int)
            for a, b in chunks(texts):
                owner, feature = _features(texts[a:b])
                if shared is not None:
                    keep = np.isin(feature, shared.value)
                    owner, feature = owner[keep], feature[keep]
                order = np.lexsort((owner, feature))
                owner, feature = owner[order], feature[order]
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (feature[1:] != feature[:-1])
                owner, feature = owner[new], feature[new]
                for k in range(4):
                    f, n = np.unique(feature[kind[a:b][owner] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(np.full(len(f), k > 1)), pa.array(np.full(len(f), k % 2, np.int32)), pa.array(n.astype(np.int64))], names=["feature", "toxic", "half", "n"])

    return df.mapInArrow(run, "feature long, toxic boolean, half int, n long").groupBy("feature", "toxic", "half").agg(F.sum("n").alias("n"))


def _found(texts: list[bytes], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in `wanted`) of the distinct features found, sorted."""
    owner, feature = _features(texts)
    place = np.searchsorted(wanted, feature)
    hit = wanted[np.minimum(place, len(wanted) - 1)] == feature if len(wanted) else np.zeros(len(feature), bool)
    pairs = np.unique(owner[hit] * (len(wanted) + 1) + place[hit])
    return pairs // (len(wanted) + 1), pairs % (len(wanted) + 1)


def _sparse(df: DataFrame, chosen: np.ndarray) -> DataFrame:
    """`features` (places in `chosen`, distinct) of each row of `df` (t, toxic, half)."""
    shared = df.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for a, b in chunks(texts):
                whose, which = _found(texts[a:b], shared.value)
                cut = np.searchsorted(whose, np.arange(b - a + 1)).astype(np.int32)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("toxic"), part.column("half"), pa.ListArray.from_arrays(pa.array(cut), pa.array(which.astype(np.int32)))],
                    names=["toxic", "half", "features"])

    return df.select("t", "toxic", "half").mapInArrow(run, "toxic boolean, half int, features array<int>")


class Model:
    """Chosen features (sorted hashes), their weights, and the ordered thresholds."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.chosen, self.weights, self.thresholds = chosen, weights, thresholds

    def above(self, owner: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
        """P(grade >= k) of each of `n` documents for k = 1 to 3; document owner[i] has the feature which[i]."""
        return _sigmoid(np.bincount(owner, weights=self.weights[which], minlength=n)[:, None] - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fit(owner: np.ndarray, which: np.ndarray, grade: np.ndarray, n_features: int, steps: int = 800, penalty: float = 1e-4, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Maximum penalised likelihood of the cumulative-link model by Adam; thresholds by their first value and gaps.

    All weights start equal, with thresholds between the numbers of features that the grades have on average.  `weight`
    says for how many documents each one stands.
    """
    n = len(grade)
    each = np.full(n, 1 / max(1, n)) if weight is None else weight / weight.sum()
    number = np.bincount(owner, minlength=n)
    means = np.array([number[grade == k].mean() if (grade == k).any() else np.nan for k in range(GRADES + 1)])
    means = np.maximum.accumulate(np.where(np.isnan(means), 0, means))
    start = np.maximum((means[1:] + means[:-1]), 1.0)  # twice the middle, for weights of 2
    w, first, gaps = np.full(n_features, 2.0), start[0], np.clip(np.log(np.maximum(np.diff(start), 0.05)), -3, 5)
    state = [np.zeros(n_features + GRADES), np.zeros(n_features + GRADES)]
    for t in range(1, steps + 1):
        theta = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        x = np.bincount(owner, weights=w[which], minlength=n)
        p = np.column_stack([np.ones(n), _sigmoid(x[:, None] - theta), np.zeros(n)])  # P(grade >= k)
        s = p * (1 - p)
        at = np.arange(n)
        mass = np.maximum(p[at, grade] - p[at, grade + 1], 1e-9)
        by_x = -(s[at, grade] - s[at, grade + 1]) / mass * each
        by_theta = np.zeros(GRADES)
        for k in range(1, GRADES + 1):
            by_theta[k - 1] = (np.where(grade == k, s[:, k], 0) - np.where(grade == k - 1, s[:, k], 0)) @ (each / mass)
        tail = np.cumsum(by_theta[::-1])[::-1]
        grad = np.concatenate([np.bincount(which, weights=by_x[owner], minlength=n_features) + penalty * w / max(1, n_features) ** 0.5, [tail[0]], tail[1:] * np.exp(gaps)])
        for i, power in ((0, 1), (1, 2)):
            state[i] = (0.9, 0.999)[i] * state[i] + (0.1, 0.001)[i] * grad ** power
        step = 0.05 * (state[0] / (1 - 0.9 ** t)) / (np.sqrt(state[1] / (1 - 0.999 ** t)) + 1e-10)
        # features were chosen as signs of toxicity, so they can only raise the grade
        w, first, gaps = np.maximum(w - step[:n_features], 0), first - step[n_features], np.clip(gaps - step[n_features + 1:], -3, 5)
    return w, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def _below(id_col: str, share: dict[bool, float]) -> Column:
    """Whether a row's id hashes below the share of its class (column toxic) that is wanted."""
    u = F.shiftrightunsigned(F.xxhash64(id_col), 11) / float(1 << 53)
    return u < F.when(F.col("toxic"), share.get(True, 1.0)).otherwise(share.get(False, 1.0))


def train(df: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, sample: int = SAMPLE, counted: int = COUNTED) -> Model:
    """Fit on rows of `df` that `labels` (id, 0/1 `label`) covers, within the bounds; null ids, texts and labels are left out.

    Of contradicting labels for one id the toxic one counts; repeated ids are rows like others.  Without toxic labels
    nothing is ever toxic.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text).alias("t")).filter("t is not null")
    known = labels.select(F.col(id_col).alias("id"), F.col(label).alias("y")).filter("id is not null and y is not null").groupBy("id").agg((F.max("y") == 1).alias("toxic"))
    present = materialise(known.join(texts.select("id"), "id", "left_semi"))
    known_ids = {r["toxic"]: r["count"] for r in present.groupBy("toxic").count().collect()}
    # about twice `counted` ids are broadcast, so that no text is shuffled
    picked = F.broadcast(present.filter(_below("id", {v: counted / n for v, n in known_ids.items()})))
    rows = materialise(texts.withColumn("t", utf8("t")).join(picked, "id").withColumn("half", F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int")))
    sizes = {(r["toxic"], r["half"]): r["count"] for r in rows.groupBy("toxic", "half").count().collect()}
    size = {v: sizes.get((v, 0), 0) + sizes.get((v, 1), 0) for v in (True, False)}
    toxic, clean = size[True], size[False]
    none = Model(np.zeros(0, np.int64), np.zeros(0), np.full(GRADES, 40.0))
    if not toxic:
        release(rows, present)
        return none
    least = max(LEAST_DOCS, LEAST_SHARE * toxic)
    first = _document_counts(rows.filter("toxic"), None).groupBy("feature").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("feature").toArrow()
    candidates = np.sort(first.column("feature").to_numpy())
    table = _document_counts(rows, candidates).toArrow()
    count = np.zeros((2, 2, len(candidates)))  # by toxic and half
    count[np.array(table.column("toxic").to_pylist(), int), table.column("half").to_numpy(), np.searchsorted(candidates, table.column("feature").to_numpy())] = table.column("n").to_numpy()
    outside, inside = count.sum(1)
    p, q = inside / toxic, outside / max(1, clean)
    pooled = (inside + outside) / (toxic + clean)
    z = (p - q) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / toxic + 1 / max(1, clean)))
    good = (z >= Z) & (p >= LIFT * (outside + 0.5) / max(1, clean))
    chosen, count = candidates[good], count[:, :, good]
    if not len(chosen):
        release(rows, present)
        return none
    # of each half of the documents: how much a feature speaks for toxic
    odds = [np.maximum(np.log((count[1, h] + 0.5) / (sizes.get((True, h), 0) + 1)) - np.log((count[0, h] + 0.5) / (sizes.get((False, h), 0) + 1)), 0) for h in (0, 1)]
    sampled = rows.filter(_below("id", {v: sample / n for v, n in size.items() if n}))
    seen = _sparse(sampled, chosen).toArrow()
    release(rows, present)
    y, half = np.array(seen.column("toxic").to_pylist(), bool), seen.column("half").to_numpy()
    lengths = seen.column("features").combine_chunks().value_lengths().to_numpy()
    owner = np.repeat(np.arange(len(y)), lengths)
    which = seen.column("features").combine_chunks().flatten().to_numpy().astype(np.int64)
    gravity = np.bincount(owner, weights=np.where(half[owner] == 0, odds[1][which], odds[0][which]), minlength=len(y))
    thirds = np.quantile(gravity[y], [1 / 3, 2 / 3]) if y.any() else np.zeros(2)
    grade = np.where(y, 1 + np.searchsorted(thirds, gravity, side="left"), 0).clip(0, GRADES)
    # a bound on one class must not change the ratio of the classes
    weight = np.where(y, known_ids[True] / max(1, y.sum()), known_ids.get(False, 0) / max(1, (~y).sum()))
    weights, thresholds = _fit(owner, which, grade, len(chosen), weight=weight)
    return Model(chosen, weights, thresholds)


def score(df: DataFrame, text: str, model: Model) -> DataFrame:
    """Add severity (expected grade, 0 to 3), p_toxic (grade 1 or more), grade (the likeliest) and toxic (p_toxic >= 0.5).

    Null and empty texts have no features and get the clean end of the scale.  Of equally likely grades the lower one is
    taken.  Columns of these names are replaced, all others pass through.
    """
    own, name = apart(df)
    new = [T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]
    kept = {name[f.name]: f for f in df.schema.fields if f.name not in {x.name for x in new}}
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts, parts = batch.column("__utf8").to_pylist(), [np.zeros((0, GRADES))]
            for a, b in chunks(texts):
                whose, which = _found(texts[a:b], m.chosen)
                parts.append(m.above(whose, which, b - a))
            p = np.concatenate(parts)
            mass = np.column_stack([np.ones(len(p)), p]) - np.column_stack([p, np.zeros(len(p))])
            columns = [pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(mass.argmax(1).astype(np.int32)), pa.array(p[:, 0] >= 0.5)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, *(f.name for f in new)])

    schema = T.StructType([*(T.StructField(c, f.dataType, f.nullable) for c, f in kept.items()), *new])
    out = own.select(*kept, utf8(name[text]).alias("__utf8")).mapInArrow(run, schema)
    return out.toDF(*[f.name for f in kept.values()], *[f.name for f in new])


def keep_civil(df: DataFrame, text: str, model: Model) -> DataFrame:
    """The rows of `df` that are not toxic, with their columns as they are."""
    own, name = apart(df)
    return score(own, name[text], model).filter("not toxic").select(*name.values()).toDF(*df.columns)

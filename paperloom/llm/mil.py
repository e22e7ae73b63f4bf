"""Quality by attention-based multiple-instance learning.

A document is a bag of passages.  Each passage is encoded; gated attention, learned from document labels alone, weighs
the encodings; the weighted sum gives the score.  The network is fitted on a bounded sample of labelled documents and
then applied to every passage of every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import utf8
from .textvec import LETTERS, Words, chunks

PASSAGE_WORDS = 64
HASHED = 96
#: The bounded sample that the network is fitted on: at most so many labelled documents, those with the lowest hash of id
#: and text, and together at most so many passages (556 bytes each).  Every one of them is seen whole.
SAMPLE, PASSAGES = 3000, 96_000
#: Labelled documents of over this share of PASSAGES (768,000 words) are not in the sample; all documents are scored.
LARGEST = 8
ENCODED, GATES = 24, 12


def _classes() -> np.ndarray:
    """Class of each byte: blank, line end, lower case, capital, digit, beyond ASCII, other control, each punctuation."""
    out = np.full(256, 6, np.int64)
    out[[32, 9]], out[[10, 13]] = 0, 1
    out[97:123], out[65:91], out[48:58], out[128:] = 2, 3, 4, 5
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    out[marks] = 7 + np.arange(len(marks))
    return out


CLASS = _classes()
N_CLASSES = int(CLASS.max()) + 1
N_FEATURES = N_CLASSES + 4 + HASHED


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text of each passage, features of each passage); a text without words has one passage of zeros.

    Features: shares of byte classes, mean word length, share of words equal to the one before, of distinct words, of
    lines by words, and a hashed bag of words.
    """
    w = Words(texts, LETTERS)
    blank = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    kind = CLASS[blank]
    solid = (blank > 32).astype(np.int8)
    step = np.diff(solid)
    start, end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    owner = np.searchsorted(w.bounds, start, side="right") - 1
    count = np.bincount(owner, minlength=len(texts))
    per = np.maximum(1, -(-count // PASSAGE_WORDS))
    first_passage = np.cumsum(per) - per
    place = np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
    of_word = first_passage[owner] + place // PASSAGE_WORDS
    n = int(per.sum())
    out = np.zeros((n, N_FEATURES), np.float32)
    # every byte goes with the last word that starts at or before it, if that is of the same text
    if len(start):
        word = np.clip(np.searchsorted(start, np.arange(len(blank)), side="right") - 1, 0, None)
        byte_owner = np.searchsorted(w.bounds, np.arange(len(blank)), side="right") - 1
        ok = (byte_owner == owner[word]) & (np.arange(len(blank)) >= start[word])
        counts = np.bincount(of_word[word[ok]] * N_CLASSES + kind[ok], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
        total = np.maximum(counts.sum(1, keepdims=True), 1)
        out[:, :N_CLASSES] = counts / total
        words = np.maximum(np.bincount(of_word, minlength=n), 1)
        out[:, N_CLASSES] = np.bincount(of_word, weights=np.minimum(end - start, 40), minlength=n) / words / 10
    if len(w.start):
        h = w.hashes()[0]
        at = np.clip(np.searchsorted(start, w.start, side="right") - 1, 0, None)
        p = of_word[at]
        letters = np.maximum(np.bincount(p, minlength=n), 1)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (p[1:] == p[:-1])
        out[:, N_CLASSES + 1] = np.bincount(p, weights=again, minlength=n) / letters
        order = np.lexsort((h, p))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (p[order][1:] != p[order][:-1])
        out[:, N_CLASSES + 2] = np.bincount(p[order], weights=new, minlength=n) / letters
        out[:, N_CLASSES + 3] = letters / PASSAGE_WORDS
        bag = np.bincount(p * HASHED + (h % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
        out[:, N_CLASSES + 4:] = bag / letters[:, None]
    return np.repeat(np.arange(len(texts)), per), out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Weights of the encoder, the gated attention and the output."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, rng: np.random.Generator, bias: float):
        self.mean, self.scale = mean, scale
        d = len(mean)
        self.p = {"W": rng.normal(0, d ** -0.5, (d, ENCODED)), "b": np.zeros(ENCODED), "V": rng.normal(0, 0.2, (ENCODED, GATES)), "U": rng.normal(0, 0.2, (ENCODED, GATES)), "a": rng.normal(0, 0.2, GATES), "c": rng.normal(0, 0.2, ENCODED), "d": np.array(bias)}

    def forward(self, owner: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        """`owner` is sorted and names every document from 0."""
        p = self.p
        h = np.tanh((x - self.mean) / self.scale @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        raw = (t * g) @ p["a"]
        first = np.searchsorted(owner, np.arange(owner[-1] + 1))
        e = np.exp(raw - np.maximum.reduceat(raw, first)[owner])
        attention = e / np.add.reduceat(e, first)[owner]
        z = np.add.reduceat(attention[:, None] * h, first, axis=0)
        return {"h": h, "t": t, "g": g, "attention": attention, "z": z, "first": first, "y": _sigmoid(z @ p["c"] + p["d"])}

    def gradient(self, owner: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(owner, x)
        out = (f["y"] - y) / len(y)
        dz = (out[:, None] * p["c"])[owner]
        along = (dz * f["h"]).sum(1)
        mean = np.add.reduceat(f["attention"] * along, f["first"])[owner]
        draw = f["attention"] * (along - mean)
        dt, dg = draw[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2), draw[:, None] * p["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["attention"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        s = (x - self.mean) / self.scale
        return {"W": s.T @ dh + 1e-4 * p["W"], "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ draw, "c": f["z"].T @ out, "d": out.sum()}


def fit(owner: np.ndarray, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 200, seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    share = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
    model = Model(x.mean(0) if len(x) else np.zeros(N_FEATURES), (x.std(0) if len(x) else np.ones(N_FEATURES)) + 1e-3, rng, float(np.log(share / (1 - share))))
    if not len(y):
        return model
    first = np.searchsorted(owner, np.arange(len(y) + 1))
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.p.items()}
    for t in range(1, steps + 1):
        docs = rng.choice(len(y), min(batch, len(y)), replace=False)
        rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in docs])
        own = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
        rate = 0.01 * (1 - t / (steps + 1)) + 1e-4
        for k, g in model.gradient(own, x[rows], y[docs]).items():
            m = moment[k]
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
            model.p[k] = model.p[k] - rate * (m[0] / (1 - 0.9 ** t)) / (np.sqrt(m[1] / (1 - 0.999 ** t)) + 1e-8)
    return model


def train(df: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, sample: int = SAMPLE) -> Model:
    """Fit on up to `sample` of the rows of `df` that `labels` (id, 0/1 `label`) covers; null labels are left out.

    The sample is rows, in the order of a hash of id and text, until they have PASSAGES passages together; rows that are equal
    in both count once, other rows of a repeated id each for itself.  All passages of a sampled row are fitted.  So at
    most PASSAGES passages (53 MB) reach the driver, however long or often repeated rows are.  Of contradicting labels for
    one id the lower one counts.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg(F.min(label).alias("y"))
    own = df.select(F.col(id_col).alias("id"), F.col(text).alias("t")).withColumn("h", F.xxhash64("id", "t"))
    long = F.greatest(F.lit(1), F.ceil(F.regexp_count(F.coalesce("t", F.lit("")), F.lit(r"[^\x00-\x20]+")) / PASSAGE_WORDS))
    # only hashes and lengths are shuffled; texts are read again and stay where they are
    found = own.select("id", "h", long.alias("n")).join(known.withColumnRenamed(id_col, "id"), "id").filter(F.col("n") <= PASSAGES // LARGEST)
    order = found.groupBy("h").agg(F.max("n").alias("n"), F.min("y").alias("y")).orderBy("h").limit(sample).collect()
    room, chosen = PASSAGES, []
    for r in order:
        if r["n"] > room:
            break
        room -= r["n"]
        chosen.append((r["h"], float(r["y"])))
    picked = df.sparkSession.createDataFrame(pa.table({"h": pa.array([h for h, _ in chosen], pa.int64()), "y": pa.array([y for _, y in chosen], pa.float64())}), "h long, y double")
    rows = own.join(F.broadcast(picked), "h").select("h", utf8("t").alias("t"), "y")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for a, b in chunks(texts):
                owner, x = passages(texts[a:b])
                cut = np.searchsorted(owner, np.arange(b - a + 1))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("y"), pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in range(b - a)], pa.binary())], names=["h", "y", "x"])

    once = rows.mapInArrow(encode, "h long, y double, x binary").groupBy("h").agg(F.min("y").alias("y"), F.first("x").alias("x"))
    got = once.toArrow().sort_by("h")
    each = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in got.column("x").to_pylist()]
    owner = np.repeat(np.arange(len(each)), [len(e) for e in each])
    return fit(owner, np.concatenate(each) if each else np.zeros((0, N_FEATURES), np.float32), got.column("y").to_numpy())


def score(df: DataFrame, text: str, model: Model) -> DataFrame:
    """Add score (0 to 1, higher: better), predicted (1 if score >= 0.5), passages, and attention (the largest weight).

    Null and empty texts count as one passage of zeros.  Columns of these names are replaced.
    """
    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", T.IntegerType()), T.StructField("attention", T.DoubleType())]
    kept = [f for f in df.schema.fields if f.name not in {x.name for x in new}]
    names = [f.name for f in kept]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__utf8").to_pylist()
            for a, b in chunks(texts):
                owner, x = passages(texts[a:b])
                f = shared.value.forward(owner, x)
                part = batch.slice(a, b - a)
                new_columns = [pa.array(f["y"]), pa.array((f["y"] >= 0.5).astype(np.int32)), pa.array(np.bincount(owner).astype(np.int32)), pa.array(np.maximum.reduceat(f["attention"], f["first"]))]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *new_columns], names=[*names, *(f.name for f in new)])

    return df.select(*names, utf8(text).alias("__utf8")).mapInArrow(run, T.StructType([*kept, *new]))

"""Language identification by multilingual mixtures.

Every language has a model of byte trigrams, counted over all training documents.  A document's words are drawn from a
mixture of languages; expectation-maximisation estimates the proportions, and languages leave the set as long as the
penalised likelihood (half the logarithm of the number of words for each language) does not fall.  However many languages
there are, they enter AT_ONCE at a time in code-point order, each such block together with what a document has kept of the
blocks before, so that every language is tried against all that are left.  Of languages that are equally likely the first
leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, release, utf8
from .textvec import CHUNK, LETTERS, Words, chunks

BINS = 1 << 16
SMOOTHING = 0.1
#: A document's EM steps end when no proportion moves by more than this.
TOLERANCE = 0.002
#: Languages whose numbers stand side by side: 65,536 for each language of the model, and one for each of a chunk's words.
AT_ONCE = 32
#: Words that are scored at once.
SCORED = 1 << 15


def _bins(data: np.ndarray) -> np.ndarray:
    """Bin of the trigram that starts at every byte but the last two."""
    x = data.astype(np.uint32)
    h = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(16)).astype(np.int64)


def _inside(data: np.ndarray) -> np.ndarray:
    """Trigrams whose middle byte belongs to a word; the space before and after counts as its edge."""
    return data[1:-1] != 32


def trigram_counts(df: DataFrame, text: str, language: str) -> DataFrame:
    """(lang, bin, n): how often the trigrams of each bin occur in all texts of a language; nulls are left out."""

    def rows(names: list[str], at: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(at.astype(np.int32)), pa.array(c.astype(np.int64))], names=["lang", "bin", "n"])

    def flushed(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, c in total.items():
            at = np.flatnonzero(c)
            yield rows([name] * len(at), at, c[at])
        total.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("t").to_pylist(), np.array(batch.column("l").to_pylist(), object)
            for a, b in chunks(texts):
                w = Words(texts[a:b], LETTERS)
                bins = _bins(w.data)
                names, own = np.unique(langs[a:b].astype(str), return_inverse=True)
                owner = own[np.minimum(np.searchsorted(w.bounds, np.arange(1, len(bins) + 1), side="right") - 1, b - a - 1)]
                ok = _inside(w.data)
                key = owner[ok] * BINS + bins[ok]
                if len(names) > AT_ONCE:
                    at, c = np.unique(key, return_counts=True)
                    yield rows(names[at // BINS].tolist(), at % BINS, c)
                    continue
                counts = np.bincount(key, minlength=len(names) * BINS).reshape(-1, BINS)
                for name, c in zip(names, counts):
                    total[name] = total.get(name, 0) + c
                if len(total) > 2 * AT_ONCE:
                    yield from flushed(total)
        yield from flushed(total)

    known = df.filter(F.col(text).isNotNull() & F.col(language).isNotNull()).select(utf8(text).alias("t"), F.col(language).alias("l"))
    return known.mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


class Model:
    """How often the bins occur in each language, in blocks of AT_ONCE languages, of which one is laid out at a time.

    It holds the (language, bin) pairs that occur: at most 65,536 for each language, 11 bytes each.
    """

    def __init__(self, counts: DataFrame):
        self.languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
        self.blocks = []
        for a in range(0, len(self.languages), AT_ONCE):
            names = self.languages[a:a + AT_ONCE]
            rows = counts.filter(F.col("lang").isin(names)).toArrow()
            place = {x: i for i, x in enumerate(names)}
            self.blocks.append((len(names), np.array([place[x] for x in rows.column("lang").to_pylist()], np.uint8), rows.column("bin").to_numpy().astype(np.uint16), rows.column("n").to_numpy()))
        self._laid_out: tuple[int, np.ndarray] | None = None

    def log_p(self, block: int) -> np.ndarray:
        """Log-probabilities of the bins (rows) in the languages of a block."""
        if self._laid_out is None or self._laid_out[0] != block:
            size, lang, at, n = self.blocks[block]
            table = np.full((size, BINS), SMOOTHING)
            table[lang, at] += n
            self._laid_out = block, np.log(table / table.sum(1, keepdims=True)).astype(np.float32).T.copy()
        return self._laid_out[1]

    def word_scores(self, w: Words, block: int) -> np.ndarray:
        """Log-likelihood of each word in each language of a block."""
        log_p = self.log_p(block)
        out = np.zeros((len(w.start), log_p.shape[1]), np.float32)
        for a in range(0, len(w.start), SCORED):
            start = w.start[a:a + SCORED]
            data = w.data[start[0] - 1:w.end[a:a + SCORED][-1] + 1]
            ok = _inside(data)
            before = np.concatenate([[0], np.cumsum(ok)])
            out[a:a + SCORED] = np.add.reduceat(log_p[_bins(data)[ok]], before[start - start[0]], axis=0)
        return out

    def mixtures(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of languages in each text, zero outside the chosen set; and the number of its words."""
        w = Words(texts, LETTERS)
        n_langs = len(self.languages)
        words = np.bincount(w.owner, minlength=len(texts))
        out = np.zeros((len(texts), n_langs))
        docs = np.flatnonzero(words)
        if not len(docs) or not n_langs:
            return out, words
        first, n = np.cumsum(words[docs]) - words[docs], words[docs]
        kept, labels = np.zeros((len(w.owner), 0), np.float32), np.zeros((len(docs), 0), int)
        for block, (size, *_) in enumerate(self.blocks):
            scores, own = self.word_scores(w, block), sum(b[0] for b in self.blocks[:block]) + np.arange(size)
            if kept.shape[1]:
                scores = np.concatenate([kept, scores], axis=1)
            labels = np.concatenate([labels, np.broadcast_to(own, (len(docs), size))], axis=1)
            share = _chosen(scores, labels >= 0, first, n)
            # what each document keeps, side by side; places that it doesn't need have no language
            order = np.argsort(share == 0, axis=1, kind="stable")[:, :(share > 0).sum(1).max()]
            share = np.take_along_axis(share, order, axis=1)
            labels = np.where(share > 0, np.take_along_axis(labels, order, axis=1), -1)
            if block + 1 < len(self.blocks):
                kept = np.take_along_axis(scores, np.repeat(order, n, axis=0), axis=1)
                kept[np.repeat(labels < 0, n, axis=0)] = -np.inf
        doc, at = np.nonzero(labels >= 0)
        out[docs[doc], labels[doc, at]] = share[doc, at]
        return out, words


def _chosen(scores: np.ndarray, there: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Proportions of the languages (columns) in each document, zero outside its chosen set.

    scores: log-likelihoods of words, a document's from `first` on, `n` of them; there: the languages that it may have.
    """
    like = np.exp(scores - scores.max(1, keepdims=True))

    def em(like, first, n, share):
        share = share.copy()
        at, own, rows, rows_first = np.arange(len(n)), n, like, first  # of the documents that still move
        while len(at):
            r = rows * np.repeat(share[at], own, axis=0)
            r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
            new = np.add.reduceat(r, rows_first, axis=0) / own[:, None]
            moving = np.abs(new - share[at]).max(1) > TOLERANCE
            share[at] = new
            if not moving.all():
                rows, at, own = rows[np.repeat(moving, own)], at[moving], own[moving]
                rows_first = np.cumsum(own) - own
        return share, np.add.reduceat(np.log(np.maximum((like * np.repeat(share, n, axis=0)).sum(1), 1e-300)), first)

    share, fit = em(like, first, n, there / there.sum(1, keepdims=True))
    going = np.arange(len(n))
    for _ in range(scores.shape[1] - 1):
        # each document that is still going tries to do without its smallest language
        going = going[(share[going] > 0).sum(1) > 1]
        if not len(going):
            break
        tried = share[going].copy()
        least = np.where(tried > 0, tried, 2).argmin(1)
        tried[np.arange(len(going)), least] = 0
        tried /= np.maximum(tried.sum(1, keepdims=True), 1e-300)
        rows = np.repeat(first[going] - (np.cumsum(n[going]) - n[going]), n[going]) + np.arange(n[going].sum())
        tried, new_fit = em(like[rows], np.cumsum(n[going]) - n[going], n[going], tried)
        better = new_fit + 0.5 * np.log(n[going]) >= fit[going]
        going = going[better]
        share[going], fit[going] = tried[better], new_fit[better]
    return share


def train(df: DataFrame, text: str, language: str) -> Model:
    """Counts over all rows with a text and a language."""
    counts = materialise(trigram_counts(df, text, language))
    model = Model(counts)
    release(counts)
    return model


def identify(df: DataFrame, text: str, model: Model) -> DataFrame:
    """Add lang_pred, score (its share of the words) and proportions (map of the chosen languages).

    `und` with score 0 and an empty map for null texts and those without a letter, and for all if no language was
    learned.  A text whose letters give no word gets the first language.  Columns of these names are replaced.
    """
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("proportions", T.MapType(T.StringType(), T.DoubleType()))]
    kept = [f for f in df.schema.fields if f.name not in {x.name for x in new}]
    names = [f.name for f in kept]
    shared = df.sparkSession.sparkContext.broadcast(model)
    most = CHUNK * 8 // max(8, min(len(model.languages), AT_ONCE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts, lettered = batch.column("__utf8").to_pylist(), np.array(batch.column("__lettered").to_pylist(), bool)
            shares = np.concatenate([m.mixtures(texts[a:b])[0] for a, b in chunks(texts, most)]) if texts else np.zeros((0, len(m.languages)))
            known = lettered & bool(m.languages)
            best = shares.argmax(1) if m.languages else np.zeros(len(texts), int)
            pred = [m.languages[i] if ok else "und" for i, ok in zip(best, known)]
            score = [min(1.0, float(s[i])) if ok else 0.0 for s, i, ok in zip(shares, best, known)]
            maps = [[(m.languages[j], float(s[j])) for j in np.flatnonzero(s)] if ok else [] for s, ok in zip(shares, known)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(maps, pa.map_(pa.string(), pa.float64()))], names=[*names, *(f.name for f in new)])

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) if text in df.columns else F.lit(False)
    return df.select(*names, utf8(text).alias("__utf8"), lettered.alias("__lettered")).mapInArrow(run, T.StructType([*kept, *new]))

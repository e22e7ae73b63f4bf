"""Product codes of vectors by Lloyd's rounds in integers, maintained from what changes.

Vectors are cut into parts, each with a small codebook.  A round assigns every part and writes the assignments beside the
vectors; sums and counts by entry run on from the round before: only parts whose entry changed are shuffled, as minus
from the old entry and plus to the new one, added up in each task first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, release

#: Integers that a double holds exactly.
EXACT = 2**53


def whole_numbers(vector: str, scale: int) -> Column:
    """Components times `scale`, rounded down; null where the vector is null or has a null or non-finite component."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf")))
    return F.when(F.col(vector).isNotNull() & ~bad, F.transform(wide, lambda x: F.floor(x * float(scale))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column's rows as a matrix of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) for each row of `parts`: the nearest row of `book`, of equals the first."""
    top = int(max(np.abs(parts).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * top * top * parts.shape[1] >= 2**62:
        raise OverflowError("squared distances of these vectors don't fit into a long")
    kind = np.float64 if 4 * top * top * parts.shape[1] < EXACT else np.int64
    x, c = parts.astype(kind), book.astype(kind)
    far = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    at = far.argmin(1)
    return at, far[np.arange(len(x)), at].astype(np.int64)


def _assign(df: DataFrame, books: list[np.ndarray], with_error: bool = False) -> DataFrame:
    """`df` (id, label, vector, code) with its code moved to `old` and the new one in `code`; with the error if asked for."""
    part = books[0].shape[1]
    width = part * len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2), width)
            found = [nearest(x[:, p * part : (p + 1) * part], book) for p, book in enumerate(books)]
            codes = np.stack([f[0] for f in found], 1).astype(np.int32).reshape(-1)
            offsets = pa.array(np.arange(0, len(codes) + 1, len(books), dtype=np.int32))
            new = pa.ListArray.from_arrays(offsets, pa.array(codes))
            error = pa.array(sum(f[1] for f in found) if with_error else np.zeros(len(x), np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), new, error], ["id", "label", "vector", "old", "code", "error"])

    ids, labels = (df.schema[c].dataType.simpleString() for c in ("id", "label"))
    return df.select("id", "label", "vector", "code").mapInArrow(run, f"id {ids}, label {labels}, vector array<bigint>, old array<int>, code array<int>, error bigint")


def _changes(now: DataFrame, parts: int, part: int) -> DataFrame:
    """(p, entry, n, s): by part and entry, how counts and sums change from `old` to `code`."""
    changed = now.filter(F.col("old").isNull() | (F.col("old") != F.col("code"))).select("vector", "old", "code")
    each = changed.select("vector", "old", "code", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"))
    each = each.select("p", F.get("old", "p").alias("a"), F.get("code", "p").alias("b"), F.slice("vector", F.col("p") * part + 1, part).alias("x"))
    each = each.filter(F.col("a").isNull() | (F.col("a") != F.col("b")))
    signed = F.explode(F.filter(F.array(F.struct(F.col("a").alias("entry"), F.lit(-1).cast("long").alias("sign")), F.struct(F.col("b").alias("entry"), F.lit(1).cast("long").alias("sign"))), lambda m: m["entry"].isNotNull()))
    moves = each.select("p", "x", signed.alias("m")).select("p", F.col("m.entry").alias("entry"), F.col("m.sign").alias("sign"), "x")
    return moves.groupBy("p", "entry").agg(F.sum("sign").alias("n"), *[F.sum(F.col("x")[i] * F.col("sign")).alias(f"s{i}") for i in range(part)])


def codes(df: DataFrame, id_col: str, vector: str, label: str, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, vector, code, error) of the rows whose vector has finite components only, and the codebooks by part).

    `vector` becomes floor(scale * x).  Codebooks start as the parts of the rows with the `entries` smallest ids, of equal
    ids those with the smaller vector first; null ids come last, and fewer rows make fewer entries.  Entries that no part
    has stay.  Codebooks (parts times entries) are all that reaches the driver.  Vectors must be of one length, a
    multiple of `parts`; without rows there are no codebooks.  Repeated ids are rows like others.
    """
    slim = df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), whole_numbers(vector, scale).alias("vector")).filter("vector is not null")
    now = materialise(slim.withColumn("code", F.lit(None).cast("array<int>")))
    lengths = now.agg(F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).first()
    if lengths["least"] is None:
        return now.withColumn("error", F.lit(None).cast("long")), []
    width = lengths["least"]
    if width != lengths["most"] or width % parts or not width:
        raise ValueError(f"vectors must have one length, a multiple of {parts}; there are {width} to {lengths['most']} components")
    part = width // parts
    first = now.select("id", "vector").orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()
    start = np.array([r["vector"] for r in first], np.int64)
    books = [start[:, p * part : (p + 1) * part].copy() for p in range(parts)]
    sums, counts = np.zeros((parts, len(start), part), object), np.zeros((parts, len(start)), object)
    for _ in range(rounds):
        new = materialise(_assign(now, books).drop("error"))
        release(now)
        now = new
        for r in _changes(now, parts, part).collect():
            p, e = r["p"], r["entry"]
            counts[p, e] += r["n"]
            sums[p, e] += np.array([r[f"s{i}"] for i in range(part)], object)
        for p in range(parts):
            for e in range(len(start)):
                if counts[p, e]:
                    books[p][e] = sums[p, e] // counts[p, e]
    last = materialise(_assign(now, books, with_error=True).drop("old"))
    release(now)
    return last, books


def coded(df: DataFrame, id_col: str, vector: str, label: str, **how: int) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of the rows that `codes` keeps: codes as two hex digits a part;
    label_error is the error summed over the rows of a label, those with none together."""
    last, books = codes(df, id_col, vector, label, **how)
    flat = ",".join(str(x) for book in books for entry in book.tolist() for x in entry)
    by_label = last.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    text = F.array_join(F.transform("code", lambda e: F.lower(F.lpad(F.hex(e.cast("long")), 2, "0"))), "")
    return last.join(by_label, F.col("label").eqNullSafe(F.col("__label"))).select(
        F.col("id").alias(id_col), text.alias("code"), "error", "label_error", F.sha2(F.lit(flat), 256).alias("codebooks_sha256"))

"""Long runs that may end at any time: batches that commit once, cascades of providers, months that are made anew."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.text import blank
from paperloom.session import materialise

from .rank import numbered
from .state import patch


def committed(spark: SparkSession, path: str) -> list[str]:
    """Folders of the batches below `path` that were written to their end, in order."""
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(here):
        return []
    folders = [s.getPath() for s in fs.listStatus(here) if s.isDirectory()]
    return sorted(str(f.toString()) for f in folders if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed batches."""
    done = committed(spark, path)
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def run_batches(todo: DataFrame, key: str, order: list[Column], step: Callable[[DataFrame], DataFrame], schema: str, path: str, size: int, budget: int | None = None, seconds: float | None = None, clock: Callable[[], float] = time.monotonic) -> int:
    """Work off `todo` by `step` in batches of `size` rows, in order; gives the number of batches that this run committed.

    A batch's results (rows by `schema`, with `key`) are written to a folder of their own, which counts once Spark has
    committed it, so a run that is killed loses the batch it was at.  A run takes what committed batches lack, so the next
    one goes on from there, and what a step gave no row for is asked again then.  `budget` batches or `seconds` end a run
    between batches.  Null keys can't be committed and are left out; repeated ones are worked off once.
    """
    spark = todo.sparkSession
    began = clock()
    once = todo.filter(F.col(key).isNotNull()).dropDuplicates([key])
    left = once.join(results(spark, path, schema).select(key), key, "left_anti")
    rows = materialise(numbered(left, [*order, F.col(key)], "__n"))
    total, done = rows.count(), 0
    for at in range(0, total, size):
        if done == budget or (seconds is not None and clock() - began >= seconds):
            break
        some = rows.filter((F.col("__n") >= at) & (F.col("__n") < at + size)).drop("__n")
        step(some).select(*spark.createDataFrame([], schema).columns).write.parquet(f"{path}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}")
        done += 1
    return done


def applied(items: DataFrame, answers: DataFrame, key: str, texts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the items with the answers' fields that aren't empty, the keys whose vector is stale).

    A vector is stale if one of the fields that its text is made of, `texts`, has another value than before.
    """
    new = patch(items, answers, key)
    both = items.select(key, *[F.col(c).alias(f"__{c}") for c in texts]).join(new.select(key, *texts), key)
    changed = F.lit(False)
    for c in texts:
        changed |= ~F.coalesce(F.col(c), F.lit("")).eqNullSafe(F.coalesce(F.col(f"__{c}"), F.lit("")))
    return new, both.filter(changed).select(key)


def requests(missing: DataFrame, key: str, order: list[Column], size: int) -> DataFrame:
    """(request, keys): keys packed `size` to a request, in order."""
    rows = numbered(missing.filter(F.col(key).isNotNull()).dropDuplicates([key]), [*order, F.col(key)], "__n")
    packed = rows.groupBy(F.floor(F.col("__n") / size).alias("request")).agg(F.array_sort(F.collect_list(F.struct("__n", F.col(key).alias("k")))).alias("p"))
    return packed.select("request", F.transform("p", lambda x: x["k"]).alias("keys"))


def by_position(asked: DataFrame, replies: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of replies (request, values) that are aligned with the keys of their request; places without a value, or
    behind the keys' end, give nothing, and a reply that is shorter than its request nothing for the rest."""
    pairs = asked.join(replies, "request").select(F.posexplode("keys").alias("__at", key), "values")
    return pairs.select(key, F.get("values", F.col("__at")).alias(value)).filter(F.col(value).isNotNull())


def cascade(missing: DataFrame, key: str, value: str, providers: list[Callable[[DataFrame], DataFrame]], least: int = 1) -> DataFrame:
    """(key, value, provider): what the first provider has that knows a key; each sees only what is still missing.

    A provider maps the missing rows to (key, value); values that are blank or shorter than `least` characters count as
    none, of several the longest, then the first, is taken.  What each leaves is written, so no provider is asked twice.
    """
    out = None
    for number, provider in enumerate(providers):
        found = provider(missing).filter(~blank(F.col(value)) & (F.length(value) >= least))
        w = Window.partitionBy(key).orderBy(F.desc(F.length(value)), value)
        got = materialise(found.join(missing.select(key).distinct(), key, "left_semi").withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(key, value, F.lit(number).alias("provider")))
        out = got if out is None else out.unionByName(got)
        missing = materialise(missing.join(got.select(key), key, "left_anti"))
    return out


def make_months(months: list[str], build: Callable[[str], DataFrame], path: str, month: str = "month") -> dict[str, str]:
    """Make months anew, one after the other: their rows replace those of their partition alone; gives the failures by month.

    A month whose build fails or has no rows keeps what it had, and the others go on.  Each month is one commit, so a run
    that is killed leaves every month old or new.
    """
    failed = {}
    for m in months:
        try:
            rows = materialise(build(m).filter(F.col(month) == m))
            if not rows.isEmpty():
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)
        except Exception as e:  # one month's failure is its own
            failed[m] = type(e).__name__
    return failed

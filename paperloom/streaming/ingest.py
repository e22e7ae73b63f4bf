"""A queue of papers to take in: what is found goes to the archive, what isn't is rejected with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import ids
from paperloom.functions.text import blank, filled
from paperloom.operators.dedup import keep_first

# What a request may ask for.
KINDS = ("doi", "arxiv", "title")


def key_of(kind: Column, value: Column) -> Column:
    """The identity key that a request names, null if it names none."""
    none = F.lit(None).cast("string")
    return F.when(blank(value), none).when(kind == "doi", ids.paper_uid(F.trim(value), none, none, none)).when(kind == "arxiv", ids.paper_uid(none, F.trim(value), none, none)).when(kind == "title", ids.paper_uid(none, none, none, F.trim(value)))


def ingest(asked: DataFrame, records: DataFrame, archive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of requests (request, kind, value) by records (uid, title, ...) and the archive's keys (uid).

    Accepted ones are records with the smallest request that asked for them, each once.  Rejected ones have one reason, the
    first that holds: bad kind, empty, not found, no title, already held, or repeated.
    """
    keyed = asked.withColumn("uid", key_of(F.lower(F.trim(filled(F.col("kind")))), F.col("value")))
    found = records.withColumn("__found", F.lit(True))
    joined = keyed.join(found, "uid", "left").join(archive.select("uid").distinct().withColumn("__held", F.lit(True)), "uid", "left")
    reason = (F.when(~F.lower(F.trim(filled(F.col("kind")))).isin(*KINDS), "bad kind").when(blank(F.col("value")), "empty").when(F.col("__found").isNull(), "not found")
              .when(blank(F.col("title")), "no title").when(F.col("__held"), "already held"))
    told = joined.withColumn("reason", reason).drop("__found", "__held")
    good = keep_first(told.filter("reason is null"), ["uid"], [F.col("request")])
    repeated = told.filter("reason is null").join(good.select("request"), "request", "left_anti").withColumn("reason", F.lit("repeated"))
    rejected = told.filter("reason is not null").unionByName(repeated)
    return good.select("request", *records.columns), rejected.select("request", "kind", "value", "reason")


def take_in(queue: DataFrame, records: DataFrame, path: str, checkpoint: str):
    """A stream of requests into `path`/accepted and `path`/rejected, a partition for each batch; runs through what is there.

    A batch replaces its own partitions, so one that is run again, after a failure halfway, gives the state it would have
    given once; the archive that it is held against is that of the batches before it.
    """
    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        here = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/accepted")
        before = spark.createDataFrame([], "uid string")
        if here.getFileSystem(spark._jsc.hadoopConfiguration()).exists(here):
            kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema)
            before = spark.read.schema(f"request string, {kinds}, batch long").parquet(f"{path}/accepted").filter(F.col("batch") < number)
        good, bad = ingest(rows, records, before)
        for part, name in ((good, "accepted"), (bad, "rejected")):
            part.withColumns({"request": F.col("request").cast("string"), "batch": F.lit(number).cast("long")}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")

    return queue.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

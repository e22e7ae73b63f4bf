"""Structured Streaming forms of the incremental operators: an extension, as sources here are batches otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """Files of events as a stream; event time becomes TIMESTAMP, as watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts by window and type; state older than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def first_seen(events: DataFrame, key: list[str], late: str = "30 days") -> DataFrame:
    """Each key once within the watermark: repeats from overlapping reads are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def append_new(events: DataFrame, table: str, key: str, checkpoint: str) -> StreamingQuery:
    """Insert-if-absent of every micro-batch into a Parquet table, by a batch folder that a rerun overwrites."""
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        try:
            old = spark.read.parquet(f"{table}/*").filter(F.col("batch") < number)
            new = new.join(old.select(key), key, "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch-{number:09d}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Bounds of an Arrow batch that go to a session which has none of its own: a worker holds one batch of texts, however
#: many rows of a long text's size stand together.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
_own_dir: str | None = None


def on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this library from where the driver has it, if it isn't installed, and bound batches."""
    for name, value in BATCH.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{path}".rstrip(":")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which spark.checkpoint.dir names; where all run on one machine and
    it is unset, as in tests, a temporary one."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="paperloom-")
    return _own_dir


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/paperloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete what `materialise` wrote for these, when their last reader has run."""
    for df in tables:
        spark = df.sparkSession
        for name in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
            if folder.getParent().getName() == "paperloom":
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

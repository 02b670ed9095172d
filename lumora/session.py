"""Session helpers: reading the given tables and cutting lineage in shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Where nothing is set, a temporary folder serves a local session, whose executors are the driver itself; on a
    cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lumora-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder once and read it back: later plans start from files that any executor can read."""
    path = f"{shared_dir(df.sparkSession)}/lumora-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that settle returned, once everything that reads them is settled itself."""
    for df in frames:
        spark, path = df.sparkSession, df.settled_path
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Fewer rows a batch between the JVM and Python for the actions inside: whole texts are long, and both sides hold a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(rows if int(was) <= 0 else min(int(was), rows)))
    try:
        yield
    finally:
        spark.conf.set(name, was)

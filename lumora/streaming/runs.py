"""Running streams to the end of what has arrived: landing folders, restarts, results of complete and append mode."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.session import shared_dir

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fresh_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared folder."""
    return f"{shared_dir(spark)}/lumora-stream-{uuid.uuid4().hex}"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which arbitrary state and timers need."""
    was = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if was is None else spark.conf.set(STORE, was)


@contextmanager
def state_partitions(spark: SparkSession, rows: int, each: int = 50_000, least: int = 8) -> Iterator[None]:
    """Streams that start inside keep their state in a part for every `each` rows expected, as many as the session's shuffles have at most.

    A stream keeps the number that it began with, so what counts is the size that its state will grow to; every batch opens every part.
    """
    name = "spark.sql.shuffle.partitions"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(int(was), max(least, rows // each + 1))))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    fs, at = _files(spark, path)
    fs.delete(at, True)


def land(rows: DataFrame, folder: str, number: Column, numbers: range) -> None:
    """Append rows to a landing folder, one file for each number in turn: a stream over the folder meets them in that order."""
    fs, at = _files(rows.sparkSession, folder)
    fs.mkdirs(at)
    for k in numbers:
        rows.where(number == k).coalesce(1).write.mode("append").parquet(folder)


def arriving(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """A stream over a landing folder, `files` files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def run_to_end(stream: DataFrame, mode: str, base: str | None = None) -> DataFrame:
    """What a stream has put out once it has read all that is there now; base keeps its checkpoint and output, for a later run that goes on.

    Each batch writes a version of its own, so a batch that is repeated after a failure replaces its own rows. In complete mode a batch holds the whole
    result: only the last version counts, and the one before it is deleted. In append mode all versions together are the result. No batch: no rows.
    """
    spark = stream.sparkSession
    base = base or fresh_folder(spark)
    done: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/v={number}")
        if mode == "complete" and done and done[-1] != number:
            forget(spark, f"{base}/out/v={done[-1]}")
        done.append(number)

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(stream.schema)
    fs, at = _files(spark, f"{base}/out")
    kept = sorted(int(x.getPath().getName().partition("=")[2]) for x in fs.listStatus(at)) if fs.exists(at) else []
    where = [f"{base}/out/v={kept[-1]}"] if mode == "complete" else [f"{base}/out"]
    found = out.parquet(*where).select(*stream.columns) if kept else spark.createDataFrame([], stream.schema)
    found.dropped_late = sum(s.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for s in p["stateOperators"])
    return found

"""Tables that are replaced whole: a new version is written beside the old one, then named in one step."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _names(spark: SparkSession, path: str) -> tuple[object, object, list[tuple[int, str]]]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(f"{path}/_names")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
    return hadoop, files, sorted((int(n.partition("-")[0]), n.partition("-")[2]) for n in found)


def publish(rows: DataFrame, path: str, keep: int = 2) -> DataFrame:
    """Make rows the table at path; readers see the old rows or all of the new ones, never none and never a part.

    The rows are written to a folder of their own; then an empty file whose name holds the next number and that folder's name is created, which a file system
    does at once. A job that fails before that changes nothing. Two writers that chose the same number: the later one in name wins, and both are whole. The
    last `keep` versions stay for readers that began before.
    """
    spark = rows.sparkSession
    name = uuid.uuid4().hex
    rows.write.parquet(f"{path}/{name}")
    hadoop, files, before = _names(spark, path)
    number = before[-1][0] + 1 if before else 0
    files.mkdirs(hadoop.Path(f"{path}/_names"))
    files.create(hadoop.Path(f"{path}/_names/{number}-{name}"), False).close()
    for n, old in [*before, (number, name)][:-keep]:
        files.delete(hadoop.Path(f"{path}/_names/{n}-{old}"), False)
        files.delete(hadoop.Path(f"{path}/{old}"), True)
    return current(spark, path, rows.schema)


def current(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The table as it is now; empty before its first version, which needs the schema."""
    _, _, found = _names(spark, path)
    if not found:
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/{found[-1][1]}")

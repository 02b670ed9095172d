"""Change feeds, work queues and windows, as Structured Streaming and as the batch they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.operators.library import merge_latest
from lumora.streaming.runs import forget

OPEN = ("pending", "running")


def trusted(entries: DataFrame, trust: DataFrame) -> DataFrame:
    """Entries whose author is on the trust list; works on streams (stream-static join)."""
    return entries.join(trust.select("author"), "author", "left_semi")


def routed(entries: DataFrame) -> DataFrame:
    """entries(key) with `route` by the key's prefix: meta, member, key, revoke or unknown."""
    key, out = F.col("key"), F.lit("unknown")
    for prefix, route in (("c/meta", "meta"), ("c/mem", "member"), ("c/key", "key"), ("c/rev", "revoke")):
        out = F.when(key.startswith(prefix), route).otherwise(out)
    return entries.withColumn("route", out)


def last_writes(entries: DataFrame) -> DataFrame:
    """(namespace, key, value, ts): the last write of each key, ties by value; also as a stream in update mode."""
    latest = F.max(F.struct("ts", "value")).alias("l")
    return entries.groupBy("namespace", "key").agg(latest).select("namespace", "key", F.col("l.value").alias("value"), F.col("l.ts").alias("ts"))


def apply_feed(stream: DataFrame, path: str, keys: list[str], at: str, checkpoint: str):
    """Keep the table at path up to date from a stream of upserts and deletes; each batch is merged and versioned.

    A batch writes version <batch id> beside the earlier one, so a repeated batch (after a failure) starts from the version before it; older ones are deleted.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        names = [c for c in batch.columns if c != "op"]
        old = spark.read.parquet(f"{path}/v={number - 1}") if number else batch.select(*names).limit(0)
        merge_latest(old.select(*names), batch, keys, at).write.mode("overwrite").parquet(f"{path}/v={number}")
        forget(spark, f"{path}/v={number - 2}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def enqueued(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """New pending jobs (kind, asset_id) of wanted, without those that already wait or run."""
    waiting = jobs.where(F.col("state").isin(*OPEN)).select("kind", "asset_id")
    return wanted.select("kind", "asset_id").distinct().join(waiting, ["kind", "asset_id"], "left_anti").select("kind", "asset_id", F.lit("pending").alias("state"), F.lit(0).alias("attempts"))


def claimed(jobs: DataFrame, many: int = 1) -> DataFrame:
    """jobs after the `many` oldest pending ones began to run, each with one attempt more."""
    head = jobs.where("state = 'pending'").orderBy("id").limit(many).select("id", F.lit(True).alias("mine"))
    out = jobs.join(head, "id", "left")
    mine = F.coalesce("mine", F.lit(False))
    return out.withColumn("state", F.when(mine, "running").otherwise(F.col("state"))).withColumn("attempts", F.col("attempts") + mine.cast("int")).drop("mine")


def finished(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """jobs after results(id, error): done where error is null, failed else; only running jobs change."""
    told = results.select("id", F.col("error").alias("__e"), F.lit(True).alias("__t"))
    out = jobs.join(told, "id", "left").withColumn("__t", F.coalesce("__t", F.lit(False)) & (F.col("state") == "running"))
    state = F.when(F.col("__t"), F.when(F.col("__e").isNull(), "done").otherwise("failed")).otherwise(F.col("state"))
    error = F.when(F.col("__t"), F.col("__e")).otherwise(F.col("error"))
    return out.withColumns({"state": state, "error": error}).drop("__e", "__t")


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) over event time; a slide makes windows overlap. Streams drop what is later than late."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): a user's events with less than gap between them."""
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return by.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark; in batch, of all."""
    marked = events.withWatermark("ts", late)
    return marked.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def latest_state(progress: DataFrame) -> DataFrame:
    """(source_id, state, seq): the newest progress of each source."""
    return progress.groupBy("source_id").agg(F.max(F.struct("seq", "state")).alias("l")).select("source_id", F.col("l.state").alias("state"), F.col("l.seq").alias("seq"))

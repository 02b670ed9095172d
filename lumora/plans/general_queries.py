"""Queries of streams (run to the end over files) and of general relational coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumora.plans.book import query
from lumora.session import load
from lumora.streaming import feeds
from lumora.streaming.runs import run_to_end

# how much a batch of a stream takes
PER_TRIGGER = {"maxBytesPerTrigger": str(1 << 30)}


def _event_stream(spark, d):
    """A stream over the table's own files, whether it is one file (a stream wants a folder, so a glob names it) or a folder of them."""
    e = load(spark, d, "events")
    return spark.readStream.schema(e.schema).options(**PER_TRIGGER).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def _batch(spark, d):
    return load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windows_tumbling(spark, d):
    return feeds.tumbling(_batch(spark, d)).withColumn("total", F.round("total", 4))


@query("SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start FROM events) GROUP BY 1, 2")
def windows_sliding(spark, d):
    return feeds.tumbling(_batch(spark, d), "12 hours", slide="6 hours").select("start", "event_type", "n")


@query(
    """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g
FROM (SELECT *, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE, true) AS INT) AS new FROM events)) GROUP BY user_id, g"""
)
def windows_session(spark, d):
    return feeds.sessions(_batch(spark, d))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_totals(spark, d):
    """A streaming aggregate in complete mode; its last batch equals the batch result."""
    s = _event_stream(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return run_to_end(s, "complete").withColumn("total", F.round("total", 4))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    """Windows of event time as a stream over the files, in complete mode."""
    return run_to_end(feeds.tumbling(_event_stream(spark, d)).select("start", "event_type", "n"), "complete")


@query(
    """WITH j AS (SELECT event_id AS id, event_type, CASE WHEN event_type = 'view' THEN 'running' ELSE 'pending' END AS state FROM events)
SELECT id, CASE WHEN state = 'running' AND id % 2 = 0 THEN CASE WHEN id % 3 = 0 THEN 'failed' ELSE 'done' END ELSE state END AS state, CASE WHEN state = 'running' AND id % 6 = 0 THEN 'broken' END AS error FROM j"""
)
def queue_finished(spark, d):
    """Every second job reports: done, or failed with its error; only running ones change."""
    e = load(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "running").otherwise("pending").alias("state"), F.lit(None).cast("string").alias("error"))
    told = e.where("id % 2 = 0").select("id", F.when(F.col("id") % 3 == 0, "broken").alias("error"))
    return feeds.finished(e, told).select("id", "state", "error")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe_watermark(spark, d):
    s = feeds.deduplicated(_event_stream(spark, d), ["user_id", "event_type"], "60 days")
    return run_to_end(s.select("user_id", "event_type"), "append")


@query(
    """WITH x AS (SELECT user_id % 5 AS namespace, 'c/' || CASE event_type WHEN 'click' THEN 'meta' WHEN 'view' THEN 'mem' WHEN 'purchase' THEN 'key' ELSE 'rev' END || '/' || user_id AS key, event_type, ts, event_id FROM events WHERE user_id % 4 <> 1)
SELECT namespace, key, max(event_id) FILTER (r = 1) AS value FROM (SELECT *, row_number() OVER (PARTITION BY namespace, key ORDER BY ts DESC, event_id DESC) AS r FROM x) GROUP BY 1, 2"""
)
def feed_apply(spark, d):
    """Last write of each key from trusted authors, out of a stream."""
    kind = F.when(F.col("event_type") == "click", "meta").when(F.col("event_type") == "view", "mem").when(F.col("event_type") == "purchase", "key").otherwise("rev")
    s = _event_stream(spark, d).select(
        (F.col("user_id") % 5).alias("namespace"), (F.col("user_id") % 4).alias("author"), F.concat(F.lit("c/"), kind, F.lit("/"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("value"), "ts"
    )
    trust = spark.createDataFrame([(0,), (2,), (3,)], "author long")
    return run_to_end(feeds.last_writes(feeds.trusted(s, trust)), "complete").select("namespace", "key", "value")


@query(
    """WITH x AS (SELECT CASE event_type WHEN 'click' THEN 'c/meta/1' WHEN 'view' THEN 'c/mem/2' WHEN 'purchase' THEN 'c/rev' ELSE 'other' END AS key FROM events)
SELECT CASE WHEN key LIKE 'c/meta%' THEN 'meta' WHEN key LIKE 'c/mem%' THEN 'member' WHEN key LIKE 'c/rev%' THEN 'revoke' ELSE 'unknown' END AS route, count(*) AS n FROM x GROUP BY 1"""
)
def feed_routes(spark, d):
    key = F.when(F.col("event_type") == "click", "c/meta/1").when(F.col("event_type") == "view", "c/mem/2").when(F.col("event_type") == "purchase", "c/rev").otherwise("other")
    return feeds.routed(load(spark, d, "events").select(key.alias("key"))).groupBy("route").agg(F.count("*").alias("n"))


@query("SELECT user_id AS source_id, arg_max(event_type, (event_id, event_type)) AS state, max(event_id) AS seq FROM events GROUP BY 1")
def progress_latest(spark, d):
    return feeds.latest_state(load(spark, d, "events").select(F.col("user_id").alias("source_id"), F.col("event_type").alias("state"), F.col("event_id").alias("seq")))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.floor("o_totalprice").cast("long").alias("p"))
    return o.cube("status", "priority").agg(F.count("*").alias("n"), F.sum("p").alias("total"))


@query("SELECT year(l_shipdate) AS y, month(l_shipdate) AS m, count(*) AS n FROM lineitem GROUP BY ROLLUP (year(l_shipdate), month(l_shipdate))")
def rollup_counts(spark, d):
    x = load(spark, d, "lineitem").select(F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m"))
    return x.rollup("y", "m").agg(F.count("*").alias("n"))


@query("SELECT k, 'both' AS side FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT k, 'idle' FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)")
def set_operations(spark, d):
    a, b = load(spark, d, "customer").select(F.col("c_custkey").alias("k")), load(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("idle")))


@query(
    """SELECT o_orderkey AS id, CAST(rank() OVER w AS INT) AS r, CAST(ntile(4) OVER w AS INT) AS q, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after,
count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS near FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"""
)
def window_functions(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    k = F.col("o_orderkey")
    near = F.count("*").over(w.rangeBetween(-500, 0))
    return load(spark, d, "orders").select(k.alias("id"), F.rank().over(w).alias("r"), F.ntile(4).over(w).alias("q"), F.lag(k).over(w).alias("before"), F.lead(k).over(w).alias("after"), near.alias("near"))


@query()
def approximate_people(spark, d):
    """Approximate distinct assets per person."""
    return load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("person_id")).agg(F.approx_count_distinct("l_orderkey", 0.02).alias("n"))

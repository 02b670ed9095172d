"""Streams over landing folders: out-of-order files, late rows, keyed state with timers, restarts; and the SQL that states their rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.plans.book import query
from lumora.session import load
from lumora.streaming import feeds, stateful
from lumora.streaming.runs import arriving, fresh_folder, keyed_state, land, run_to_end, state_partitions

DAY_MS = 86_400_000
#: Files hold three days of events each; rows may come one file late, which the watermark allows, or five, which it doesn't.
SPAN_DAYS = 3
LATE = f"{SPAN_DAYS} days"
IDLE_MS, BACKOFF_MS = 2 * DAY_MS, DAY_MS
#: Events expected in a part of a Python processor's state: each batch starts a worker for each part, which takes as long as tens of thousands of events.
PART = 500_000


def _numbered(spark, d, stragglers: bool):
    """events with `file`, the landing file they come in, the range of file numbers, and how many there are."""
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    span = F.floor(F.unix_micros("ts") / (SPAN_DAYS * DAY_MS * 1000)).cast("long")
    lo, hi, n = e.agg(F.min(span), F.max(span), F.count("*")).first()
    if lo is None:
        return e.withColumn("file", F.lit(0)), range(0), 0
    more = F.when(F.col("event_id") % 4 == 0, 1).otherwise(0)
    if stragglers:
        more = F.when((F.col("event_id") % 17 == 3) & (span + 5 <= hi), 5).otherwise(more)
    return e.withColumn("file", span - lo + more), range(hi - lo + 2), n


def _landed(spark, d, columns, build, mode: str, stragglers: bool = False, runs: int = 1, part: int = 50_000):
    """The output of build(stream) over landed files; with several runs the stream stops in between and starts again from its checkpoint."""
    rows, numbers, n = _numbered(spark, d, stragglers)
    rows, base = rows.select(*columns, "file"), fresh_folder(spark)
    if n:  # dealt once, so that landing a file reads that file's rows only
        rows.write.partitionBy("file").parquet(f"{base}/dealt")
        rows = spark.read.schema(rows.schema).parquet(f"{base}/dealt")
    given = rows.drop("file").schema
    cuts = [len(numbers) * k // runs for k in range(runs + 1)]
    out = None
    for a, b in zip(cuts, cuts[1:]):
        land(rows, f"{base}/in", F.col("file"), numbers[a:b])
        stream = arriving(spark, f"{base}/in", rows.schema).select(*given.names)
        with state_partitions(spark, n, part):
            out = run_to_end(build(stream), mode, base)
    return out


FILES = f"""e AS (SELECT *, floor(epoch_us(ts) / {SPAN_DAYS * DAY_MS * 1000}.0) AS b FROM events), m AS (SELECT min(b) AS lo, max(b) AS hi FROM e),
f AS (SELECT e.*, b - lo + CASE WHEN event_id % 17 = 3 AND b + 5 <= hi THEN 5 WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS file FROM e, m),
mx AS (SELECT file, date_trunc('millisecond', max(ts)) AS t FROM f GROUP BY 1),
w AS (SELECT g.file, (SELECT max(t) FROM mx WHERE mx.file <= g.file - 2) - INTERVAL {SPAN_DAYS} DAY AS late FROM mx g),
z AS (SELECT max(t) - INTERVAL {SPAN_DAYS} DAY AS done FROM mx)"""
# a row is dropped if its window had ended before the watermark that the batch before its own had; a window comes out once the watermark passes its end


@query(f"""WITH {FILES} SELECT start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, late FROM f JOIN w USING (file)), z
WHERE (late IS NULL OR start + INTERVAL 1 DAY > late) AND start + INTERVAL 1 DAY <= done GROUP BY 1, 2""")
def stream_tumbling_late(spark, d):
    """Daily windows in append mode: out-of-order rows count, rows behind the watermark are dropped, closed windows leave the state."""
    return _landed(spark, d, ["event_id", "ts", "event_type", "value"], lambda s: feeds.tumbling(s, late=LATE).select("start", "event_type", "n"), "append", stragglers=True)


@query(f"""WITH {FILES} SELECT start, event_type, count(*) AS n FROM (SELECT event_type, late, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start FROM f JOIN w USING (file)), z
WHERE (late IS NULL OR start + INTERVAL 12 HOUR > late) AND start + INTERVAL 12 HOUR <= done GROUP BY 1, 2""")
def stream_sliding_late(spark, d):
    """Half days that begin every six hours, in append mode; each of a row's windows is late by itself."""
    return _landed(spark, d, ["event_id", "ts", "event_type", "value"], lambda s: feeds.tumbling(s, "12 hours", LATE, "6 hours").select("start", "event_type", "n"), "append", stragglers=True)


@query(f"""WITH {FILES}, k AS (SELECT user_id, ts FROM f JOIN w USING (file) WHERE late IS NULL OR ts + INTERVAL 30 MINUTE > late),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE, true) AS INT) AS new FROM k))
SELECT * FROM (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, g) WHERE "end" <= (SELECT done FROM z)""")
def stream_sessions_late(spark, d):
    """Sessions of users in append mode; rows that come after their session was closed are dropped."""
    return _landed(spark, d, ["event_id", "ts", "user_id"], lambda s: feeds.sessions(s, late=LATE), "append", stragglers=True)


def _jobs(stream, buckets):
    op = F.when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "purchase", "finish").when(F.col("event_type") == "error", "fail").otherwise("enqueue")
    events = stream.select(
        F.when(F.col("event_id") % 2 == 0, "embed_asset").otherwise("detect_faces").alias("kind"), F.col("user_id").alias("asset_id"), F.unix_millis("ts").alias("at"),
        F.col("event_id").alias("id"), op.alias("op"), F.when(op == "fail", F.col("props")).alias("error"), "ts",
    )
    return stateful.job_changes(events.withWatermark("ts", LATE), IDLE_MS, BACKOFF_MS, buckets)


@query(f"""WITH RECURSIVE j AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'embed_asset' ELSE 'detect_faces' END AS kind, user_id AS asset_id, epoch_us(ts) // 1000 AS at_ms, event_id AS id,
  CASE event_type WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' ELSE 'enqueue' END AS op, CASE WHEN event_type = 'error' THEN props END AS error FROM events),
wm AS (SELECT max(at_ms) - {SPAN_DAYS * DAY_MS} AS w FROM j),
a AS (SELECT kind, asset_id, at_ms, id, op, error FROM j, wm WHERE at_ms <= w UNION ALL SELECT DISTINCT kind, asset_id, w, 9223372036854775807, 'end', NULL FROM j, wm WHERE at_ms <= w),
q AS (SELECT *, row_number() OVER (PARTITION BY kind, asset_id ORDER BY at_ms, id) AS n FROM a),
r AS (SELECT DISTINCT kind, asset_id, 0::BIGINT AS n, NULL::VARCHAR AS s, 0 AS tries, NULL::VARCHAR AS er, NULL::BIGINT AS due, NULL::BIGINT AS t1, NULL::VARCHAR AS c1, 0 AS a1, NULL::BIGINT AS t2, NULL::VARCHAR AS s2, 0 AS a2, NULL::VARCHAR AS e2, NULL::VARCHAR AS c2 FROM q
UNION ALL SELECT kind, asset_id, n, CASE WHEN s2 = 'done' THEN NULL ELSE s2 END, CASE WHEN s2 = 'done' THEN 0 ELSE a2 END, CASE WHEN s2 = 'done' THEN NULL ELSE e2 END,
  CASE WHEN c2 IS NULL THEN due ELSE CASE s2 WHEN 'running' THEN at_ms + {IDLE_MS} WHEN 'failed' THEN at_ms + {BACKOFF_MS} WHEN 'held' THEN due END END, t1, c1, a1, at_ms, s2, a2, e2, c2
FROM (SELECT *, CASE WHEN op = 'enqueue' AND s IS NULL THEN 'pending' WHEN op = 'enqueue' AND s = 'failed' THEN 'held' WHEN op = 'claim' AND s = 'pending' THEN 'running' WHEN op = 'finish' AND s = 'running' THEN 'done' WHEN op = 'fail' AND s = 'running' THEN 'failed' ELSE s END AS s2,
  CASE WHEN op = 'enqueue' AND (s IS NULL OR s = 'failed') OR op = 'claim' AND s = 'pending' OR op IN ('finish', 'fail') AND s = 'running' THEN op END AS c2,
  CASE WHEN op = 'enqueue' AND (s IS NULL OR s = 'failed') THEN 0 WHEN op = 'claim' AND s = 'pending' THEN tries + 1 ELSE tries END AS a2,
  CASE WHEN op = 'fail' AND s = 'running' THEN error WHEN op = 'enqueue' AND s = 'failed' OR op = 'finish' AND s = 'running' THEN NULL ELSE er END AS e2
  FROM (SELECT q.kind, q.asset_id, q.n, q.at_ms, q.op, q.error, CASE WHEN due <= q.at_ms THEN CASE WHEN s <> 'failed' THEN 'pending' END ELSE s END AS s, CASE WHEN due <= q.at_ms AND s = 'failed' THEN 0 ELSE tries END AS tries, CASE WHEN due <= q.at_ms AND s = 'failed' THEN NULL ELSE er END AS er,
    CASE WHEN due <= q.at_ms THEN NULL ELSE due END AS due, due AS t1, CASE WHEN due <= q.at_ms AND s = 'running' THEN 'idle' WHEN due <= q.at_ms AND s = 'held' THEN 'backoff' END AS c1, tries AS a1
    FROM r JOIN q ON q.kind = r.kind AND q.asset_id = r.asset_id AND q.n = r.n + 1)))
SELECT kind, asset_id, t1 AS at_ms, 0 AS step, 'pending' AS state, a1 AS attempts, NULL AS error, c1 AS cause FROM r WHERE c1 IS NOT NULL
UNION ALL SELECT kind, asset_id, t2, 1, s2, a2, e2, c2 FROM r WHERE c2 IS NOT NULL""")
def stream_job_queue(spark, d):
    """Every change of every (kind, asset) job, from keyed state with idle and back-off timers; the stream is stopped halfway and goes on from its checkpoint."""
    buckets = load(spark, d, "events").count() // 4096 + 16
    with keyed_state(spark):
        return _landed(spark, d, ["event_id", "ts", "user_id", "event_type", "props"], lambda s: _jobs(s, buckets), "append", runs=2, part=PART).withColumnRenamed("at", "at_ms")


def _entries(stream):
    op = F.when(F.col("event_type") == "click", "revoke").when(F.col("event_type") == "error", "other").otherwise("grant")
    peer = F.when(F.col("value") >= 5, F.concat(F.lit("p"), (F.col("event_id") * 7 % 9).cast("string")))
    return stream.select((F.col("user_id") % 20).alias("namespace"), (F.col("user_id") % 7).alias("author"), F.unix_millis("ts").alias("at"), F.col("event_id").alias("id"), op.alias("op"), peer.alias("peer"), "ts").withWatermark("ts", LATE)


def _feed(spark, d):
    trust = spark.createDataFrame([(k,) for k in (0, 1, 2, 4, 5, 6)], "author long")
    with keyed_state(spark):
        return _landed(spark, d, ["event_id", "ts", "user_id", "event_type", "value"], lambda s: stateful.shared_keys(_entries(s), trust), "append", runs=2, part=PART)


ENTRIES = f"""x AS (SELECT user_id % 20 AS namespace, user_id % 7 <> 3 AS trusted, epoch_us(ts) // 1000 AS at_ms, event_id AS id, CASE event_type WHEN 'click' THEN 'revoke' WHEN 'error' THEN 'other' ELSE 'grant' END AS op,
  CASE WHEN value >= 5 THEN 'p' || event_id * 7 % 9 END AS peer FROM events), wm AS (SELECT max(at_ms) - {SPAN_DAYS * DAY_MS} AS w FROM x),
o AS (SELECT *, row_number() OVER (ORDER BY at_ms, id) AS k FROM x, wm WHERE at_ms <= w), v AS (SELECT *, lag(op) OVER (PARTITION BY namespace, peer ORDER BY k) AS prev FROM o WHERE trusted AND op <> 'other' AND peer IS NOT NULL),
good AS (SELECT *, lead(k) OVER (PARTITION BY namespace, peer ORDER BY k) AS until FROM v WHERE (op = 'grant') = (prev IS NULL OR prev = 'revoke')),
told AS (SELECT o.*, 1 + coalesce(sum(CASE WHEN g.op = 'revoke' THEN 1 END) OVER (PARTITION BY o.namespace ORDER BY o.k), 0) AS version FROM o LEFT JOIN good g USING (k))"""


@query(f"""WITH {ENTRIES} SELECT t.namespace, t.at_ms, t.id, t.peer, CASE t.op WHEN 'grant' THEN 'active' ELSE 'revoked' END AS status, CAST(t.version AS INT) AS version FROM told t JOIN good g USING (k)
UNION ALL SELECT t.namespace, t.at_ms, t.id, h.peer, 'rotated', CAST(t.version AS INT) FROM told t JOIN good g USING (k) JOIN good h ON h.namespace = t.namespace AND h.op = 'grant' AND h.k < t.k AND coalesce(h.until > t.k, true) WHERE t.op = 'revoke'""")
def stream_shared_keys(spark, d):
    """Keys handed out, taken back and handed out anew to those who stay, from the state of each namespace."""
    return _feed(spark, d).where("output = 'key'").select("namespace", F.col("at").alias("at_ms"), "id", "peer", "status", "version")


@query(f"""WITH {ENTRIES} SELECT namespace, at_ms, id, peer, reason FROM (SELECT t.namespace, t.at_ms, t.id, t.peer, CASE WHEN NOT t.trusted THEN 'untrusted' WHEN t.op = 'other' THEN 'unknown' WHEN t.peer IS NULL THEN 'no peer'
  WHEN t.op = 'revoke' AND (v.prev IS NULL OR v.prev = 'revoke') THEN 'not a member' END AS reason FROM told t LEFT JOIN v USING (k)) WHERE reason IS NOT NULL""")
def stream_dead_letters(spark, d):
    """Entries of the feed that could not be applied, with the reason."""
    return _feed(spark, d).where("output = 'dead'").select("namespace", F.col("at").alias("at_ms"), "id", "peer", "reason")

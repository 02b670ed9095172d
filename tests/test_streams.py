"""Streams over several files, late rows, restarts, and keyed state."""

import os

import pytest
from pyspark.sql import functions as F

from lumora.plans import general_queries, registry, stream_queries
from lumora.streaming import runs
from tests.test_oracles import duck, rows_of  # noqa: F401


@pytest.fixture(scope="module")
def split(spark, sf, tmp_path_factory):
    """The tables with events as three files whose rows are mixed."""
    d = str(tmp_path_factory.mktemp("split"))
    for name in os.listdir(sf):
        if name != "events.parquet":
            os.symlink(f"{sf}/{name}", f"{d}/{name}")
    e = spark.read.parquet(f"{sf}/events.parquet")
    for k in range(3):
        e.where(F.xxhash64("event_id") % 3 == k - 1).coalesce(1).write.mode("append").parquet(f"{d}/events.parquet")
    e.where(~(F.xxhash64("event_id") % 3).isin(-1, 0, 1)).coalesce(1).write.mode("append").parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", ["stream_totals", "stream_windows", "feed_apply", "stream_dedupe_watermark", "stream_job_queue"])
def test_several_files_give_the_same_rows(spark, split, duck, name, monkeypatch):  # noqa: F811
    monkeypatch.setattr(general_queries, "PER_TRIGGER", {"maxFilesPerTrigger": "1"})
    df = registry.QUERIES[name](spark, split)
    con = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in con.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, con.fetchall())


def test_late_rows_are_dropped_and_counted(spark, sf):
    rows, _, _ = stream_queries._numbered(spark, sf, True)
    late = rows.where("event_id % 17 = 3").count()
    out = stream_queries.stream_tumbling_late(spark, sf)
    assert 0 < out.dropped_late <= late
    whole = stream_queries._landed(spark, sf, ["event_id", "ts", "event_type", "value"], lambda s: stream_queries.feeds.tumbling(s, late=stream_queries.LATE).select("n"), "append")
    assert whole.dropped_late == 0 and whole.agg(F.sum("n")).first()[0] > out.agg(F.sum("n")).first()[0]


def _events(spark, rows):
    return spark.createDataFrame(rows, "kind string, asset_id long, at long, id long, op string, error string").withColumn("ts", F.timestamp_millis("at"))


def _changes(spark, batches, idle=100, backoff=50, late="0 seconds"):
    base = runs.fresh_folder(spark)
    for k, rows in enumerate(batches):
        df = _events(spark, rows)
        runs.land(df.withColumn("file", F.lit(0)), f"{base}/in", F.col("file"), range(1))
        with runs.keyed_state(spark):
            s = runs.arriving(spark, f"{base}/in", df.schema)
            out = runs.run_to_end(stream_queries.stateful.job_changes(s.withWatermark("ts", late), idle, backoff), "append", base)
    return sorted((r["at"], r["step"], r["state"], r["attempts"], r["error"], r["cause"]) for r in out.collect())


def test_job_timers_and_order(spark):
    k = ("faces", 1)
    one = [(*k, 1030, 3, "fail", "lost"), (*k, 1000, 1, "enqueue", None), (*k, 1010, 2, "claim", None), (*k, 1001, 9, "enqueue", None), (*k, 1000, 0, "finish", None)]
    two = [(*k, 1040, 4, "enqueue", None), (*k, 1090, 5, "claim", None), ("tick", 9, 5000, 6, "enqueue", None)]
    got = _changes(spark, [one, two])
    assert got == [
        (1000, 1, "pending", 0, None, "enqueue"),
        (1010, 1, "running", 1, None, "claim"),
        (1030, 1, "failed", 1, "lost", "fail"),
        (1040, 1, "held", 0, None, "enqueue"),
        (1080, 0, "pending", 0, None, "backoff"),
        (1090, 1, "running", 1, None, "claim"),
        (1190, 0, "pending", 1, None, "idle"),
        (5000, 1, "pending", 0, None, "enqueue"),
    ]


def test_nothing_arrives(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("stream_totals", "stream_job_queue", "stream_sessions_late", "stream_dead_letters"):
        assert registry.QUERIES[name](spark, str(tmp_path)).count() == 0


class Kept:
    """A handle and its states, which count what is written."""

    def __init__(self):
        self.items, self.value, self.calls, self.timers = [], None, 0, set()

    def getListState(self, *_):
        return self

    def getValueState(self, name, _):
        return self if name == "clock" else Kept()

    def appendValue(self, v):
        self.items.append(v)
        self.calls += 1

    def get(self):
        return self.value

    def update(self, v):
        self.value = v
        self.calls += 1

    def registerTimer(self, at):
        self.timers.add(at)
        self.calls += 1


def test_events_wait_in_packs():
    kept, queue = Kept(), stream_queries.stateful.JobQueue(100, 50)
    queue.init(kept)
    rows = iter([{"at": 9000 - k, "id": k, "op": "enqueue", "error": None} for k in range(5000)])
    list(queue.handleInputRows(("faces", 1), rows, None))
    assert kept.calls <= 4 and len(kept.items) == 2 and kept.timers == {4001}


class Held:
    """A handle whose states are dicts of their own; calls counts all that is asked of any of them."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getListState(self, name, _):
        return HeldState(self, [])

    def getValueState(self, name, _):
        return HeldState(self, None)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class HeldState:
    def __init__(self, handle, value):
        self.handle, self.empty, self.value = handle, value, value

    def _set(self, value):
        self.handle.calls += 1
        self.value = value

    def get(self):
        self.handle.calls += 1
        return iter(self.value) if isinstance(self.value, list) else self.value

    def update(self, v):
        self._set(v)

    put = update

    def appendValue(self, v):
        self._set([*self.value, v])

    def clear(self):
        self._set(self.empty)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def _played(processors, dealt, batches):
    """Rows and state calls of one processor a group of keys: batches of (watermark, events)."""
    held, out = {g: Held() for g in processors}, []
    for g, p in processors.items():
        p.init(held[g])
    for now, events in batches:
        for g in processors:
            if mine := [e for e in events if dealt(e) == g]:
                list(processors[g].handleInputRows(g, iter(mine), None))
        for g, p in processors.items():
            if due := [t for t in held[g].timers if t <= now]:
                held[g].timers -= set(due)
                out += [tuple(r) for r in p.handleExpiredTimer(g, Clock(now), None)]
    return sorted(map(repr, out)), sum(h.calls for h in held.values())


def test_keys_of_a_bucket_move_as_if_alone_with_few_calls():
    import random

    S, rng = stream_queries.stateful, random.Random(3)
    keys = [("faces", k) for k in range(60)] + [("embed", None)]
    def event(k, i, late):
        kind, asset = rng.choice(keys)
        return {"kind": kind, "asset_id": asset, "at": 1000 * k + rng.randrange(1000) + late, "id": i, "op": rng.choice(["enqueue", "claim", "finish", "fail"]), "error": rng.choice([None, "lost"])}

    batches = [(1000 * k - 500, [event(k, 1000 * k + i, 0) for i in range(300 if k < 9 else 0)]) for k in range(12)]
    own = lambda e: (e["kind"], e["asset_id"])
    alone, calls = _played({k: S.JobQueue(700, 400) for k in keys}, own, batches)
    together, fewer = _played({(0,): S.Bucketed(S.JobQueue(700, 400), "kind string, asset_id long")}, lambda e: (0,), batches)
    assert together == alone and len(alone) > 500 and fewer * 20 < calls

"""Keyed state with timers: a job queue and a feed with tombstones, as processors that apply events in event-time order."""

from __future__ import annotations

import pickle
from collections import namedtuple
from collections.abc import Iterable, Iterator
from itertools import chain, islice
from operator import itemgetter
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


#: Events that wait in one piece of state.
CHUNK = 4096


class InOrder(StatefulProcessor):
    """Events of a key, applied in the order of (at, id) once the watermark has passed them, whatever order they came in.

    Events wait in state until then, packed many to a piece: a call to the state costs far more than an event. Between events a key may have one deadline, which comes before
    events of the same time. A key holds one timer, for what comes next, and no state at all once nothing waits and `memory` says nothing is left.
    """

    waiting = "at long, id long"
    keeps = "x long"
    puts = "x long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getListState("waiting", "events binary")
        self.clock = handle.getValueState("clock", "first long, due long")  # of what waits, and of the key itself
        self.own = handle.getValueState("own", self.keeps)
        self.names = [x.split()[0] for x in self.waiting.split(", ")]
        self.event = namedtuple("Event", self.names)
        self.made = Row(*(x.split()[0] for x in self.puts.split(", ")))

    def close(self) -> None:
        pass

    def start(self) -> Any:
        """A key's memory before its first event."""
        raise NotImplementedError

    def deadline(self, memory: Any) -> int | None:
        """When (ms) the key acts by itself, if nothing else happens."""
        return None

    def expire(self, key: tuple, memory: Any, at: int) -> Iterator[Row]:
        return iter(())

    def apply(self, key: tuple, memory: Any, event: Any) -> Iterator[Row]:
        raise NotImplementedError

    def load(self, kept: tuple) -> Any:
        raise NotImplementedError

    def left(self, memory: Any) -> tuple | None:
        """What `load` makes a memory of again; None if nothing is left."""
        raise NotImplementedError

    def save(self, memory: Any) -> None:
        left = self.left(memory)
        self.own.clear() if left is None else self.own.update(left)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, names = None, self.names
        while chunk := [tuple(r[n] for n in names) for r in islice(rows, CHUNK)]:
            self.queue.appendValue((pickle.dumps(chunk),))
            least = min(e[0] for e in chunk)
            first = least if first is None else min(first, least)
        if first is not None:
            before, due = self.clock.get() or (None, None)
            self._wait((before, due), (first if before is None else min(first, before), due))
        return iter(())

    def _wait(self, was: tuple, now: tuple) -> None:
        old, new = (min((t for t in ts if t is not None), default=None) for ts in (was, now))
        if old != new and old is not None:
            self.handle.deleteTimer(old)
        if old != new and new is not None:
            self.handle.registerTimer(new)
        if was != now:
            self.clock.clear() if new is None else self.clock.update(now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        kept, was = self.own.get(), tuple(self.clock.get() or (None, None))
        memory = self.start() if kept is None else self.load(kept)
        rows = self._queued() if was[0] is not None else []
        ready, rest = sorted((r for r in rows if r[0] <= now), key=itemgetter(0, 1)), [r for r in rows if r[0] > now]
        yield from self.moved(key, memory, map(self.event._make, ready), now)
        if ready:
            self._requeue(rest)
        self.save(memory)
        self._wait(was, (min((r[0] for r in rest), default=None), self.deadline(memory)))

    def _queued(self) -> list[tuple]:
        return list(chain.from_iterable(pickle.loads(bytes(r[0])) for r in self.queue.get()))

    def _requeue(self, rest: list[tuple]) -> None:
        self.queue.put([(pickle.dumps(rest[k : k + CHUNK]),) for k in range(0, len(rest), CHUNK)]) if rest else self.queue.clear()

    def moved(self, key: tuple, memory: Any, ready: Iterable[Any], now: int) -> Iterator[Row]:
        """What comes out when events in order are applied to a memory, and deadlines up to now."""
        for event in chain(ready, [None]):
            while (due := self.deadline(memory)) is not None and due <= (now if event is None else event.at):
                yield from self.expire(key, memory, due)
            if event is not None:
                yield from self.apply(key, memory, event)


class Bucketed(InOrder):
    """The rules of an InOrder for many small keys: a bucket of keys shares one queue, one piece of memory and one timer, as calls to the state cost far more than events do.

    Every key's events are applied in their own order and it has its own deadline, so what comes out is what keys by themselves would give.
    """

    keeps = "memories binary"

    def __init__(self, rules: InOrder, key: str) -> None:
        self.rules, self.waiting, self.puts = rules, f"{rules.waiting}, {key}", rules.puts

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.width = len(self.rules.waiting.split(", "))
        self.event = namedtuple("Event", self.names[: self.width])
        self.rules.made = self.made

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, rules, width = timerValues.getCurrentWatermarkInMs(), self.rules, self.width
        kept, was = self.own.get(), tuple(self.clock.get() or (None, None))
        memories = {} if kept is None else pickle.loads(bytes(kept[0]))
        rows = self._queued() if was[0] is not None else []
        ready, rest = {}, []
        for r in rows:
            if r[0] <= now:
                ready.setdefault(r[width:], []).append(r[:width])
            else:
                rest.append(r)
        for k, left in memories.items():
            if (due := rules.deadline(rules.load(left))) is not None and due <= now:
                ready.setdefault(k, [])
        for k, events in ready.items():
            memory = rules.load(memories.pop(k)) if k in memories else rules.start()
            yield from rules.moved(k, memory, map(self.event._make, sorted(events, key=itemgetter(0, 1))), now)
            if (left := rules.left(memory)) is not None:
                memories[k] = left
        if len(rest) < len(rows):
            self._requeue(rest)
        if ready:
            self.own.update((pickle.dumps(memories),)) if memories else self.own.clear()
        dues = (rules.deadline(rules.load(left)) for left in memories.values())
        self._wait(was, (min((r[0] for r in rest), default=None), min((t for t in dues if t is not None), default=None)))


class JobQueue(InOrder):
    """The job of one (kind, asset_id): enqueue, claim, finish and fail events move it, two timers too.

    enqueue makes a pending job unless one is open. claim makes a pending job running and counts an attempt. finish and fail end a running one. Anything
    else changes nothing. A running job that nobody ends within `idle` is pending again. A job enqueued less than `backoff` after its key failed is held,
    and pending when that time is over. Done jobs leave no state, failed ones none after `backoff`.
    """

    waiting = "at long, id long, op string, error string"
    keeps = "state string, attempts int, error string, due long"
    puts = "kind string, asset_id long, at long, step int, state string, attempts int, error string, cause string"

    def __init__(self, idle_ms: int, backoff_ms: int) -> None:
        self.idle_ms, self.backoff_ms = idle_ms, backoff_ms

    def start(self) -> dict:
        return {"state": None, "attempts": 0, "error": None, "due": None}

    def load(self, kept: tuple) -> dict:
        return dict(zip(("state", "attempts", "error", "due"), kept))

    def left(self, memory: dict) -> tuple | None:
        return None if memory["state"] is None else (memory["state"], memory["attempts"], memory["error"], memory["due"])

    def deadline(self, memory: dict) -> int | None:
        return memory["due"]

    def _row(self, key: tuple, memory: dict, at: int, step: int, cause: str) -> Row:
        return self.made(key[0], key[1], at, step, memory["state"], memory["attempts"], memory["error"], cause)

    def expire(self, key, memory, at) -> Iterator[Row]:
        if memory["state"] == "failed":  # the back-off is over and nothing was asked for
            memory.update(self.start())
            return
        cause = "idle" if memory["state"] == "running" else "backoff"
        memory.update(state="pending", due=None)
        yield self._row(key, memory, at, 0, cause)

    def apply(self, key, memory, event) -> Iterator[Row]:
        state, at = memory["state"], event.at
        if event.op == "enqueue" and state in (None, "failed"):
            held = state == "failed"
            memory.update(state="held" if held else "pending", attempts=0, error=None, due=memory["due"] if held else None)
        elif event.op == "claim" and state == "pending":
            memory.update(state="running", attempts=memory["attempts"] + 1, due=at + self.idle_ms)
        elif event.op == "finish" and state == "running":
            memory.update(state="done", error=None, due=None)
        elif event.op == "fail" and state == "running":
            memory.update(state="failed", error=event.error, due=at + self.backoff_ms)
        else:
            return
        yield self._row(key, memory, at, 1, event.op)
        if memory["state"] == "done":
            memory.update(self.start())


def job_changes(events: DataFrame, idle_ms: int, backoff_ms: int, buckets: int = 1024) -> DataFrame:
    """Every change of every job, from a stream of events(kind, asset_id, at, id, op, error, ts) whose watermark is on ts; at is ts in ms.

    Changes come out when the watermark has passed them. Jobs are dealt to `buckets` by hash, each with one piece of state; a stream keeps the number that it began
    with, so it should follow the events expected (some thousand a bucket). The stream must run under `runs.keyed_state`.
    """
    by = events.withColumn("bucket", F.pmod(F.xxhash64("kind", "asset_id"), F.lit(buckets))).groupBy("bucket")
    return by.transformWithState(Bucketed(JobQueue(idle_ms, backoff_ms), "kind string, asset_id long"), JobQueue.puts, outputMode="Append", timeMode="EventTime")


class SharedKeys(InOrder):
    """The keys of one namespace: who holds the present one. Grants add a peer, a revoke removes it and hands the rest a new key.

    Output rows are of two kinds: `key` rows (active, revoked, rotated, with the key's version) and `dead` rows for entries that can't be applied.
    A namespace without peers keeps only its version.
    """

    waiting = "at long, id long, op string, peer string, author long, trusted boolean"
    keeps = "version int"
    puts = "output string, namespace long, at long, id long, peer string, status string, version int, reason string"

    def init(self, handle) -> None:
        super().init(handle)
        self.peers = handle.getMapState("peers", "peer string", "since long")

    def start(self) -> dict:
        return {"version": 1, "peers": {}, "changed": set()}

    def load(self, kept: tuple) -> dict:
        return {"version": kept[0], "peers": {peer: since for (peer,), (since,) in self.peers.iterator()} if self.peers.exists() else {}, "changed": set()}

    def save(self, memory: dict) -> None:
        self.own.update((memory["version"],))
        for peer in memory["changed"]:
            if peer in memory["peers"]:
                self.peers.updateValue((peer,), (memory["peers"][peer],))
            else:
                self.peers.removeKey((peer,))

    def apply(self, key, memory, event) -> Iterator[Row]:
        def row(output: str, peer: str | None, status: str | None, reason: str | None = None) -> Row:
            return self.made(output, key[0], event.at, event.id, peer, status, memory["version"], reason)

        held = event.peer is not None and event.peer in memory["peers"]
        bad = None
        if not event.trusted:
            bad = "untrusted"
        elif event.op not in ("grant", "revoke"):
            bad = "unknown"
        elif event.peer is None:
            bad = "no peer"
        elif event.op == "revoke" and not held:
            bad = "not a member"
        if bad:
            yield row("dead", event.peer, None, bad)
        elif event.op == "grant" and not held:
            memory["peers"][event.peer] = event.at
            memory["changed"].add(event.peer)
            yield row("key", event.peer, "active")
        elif event.op == "revoke":
            del memory["peers"][event.peer]
            memory["changed"].add(event.peer)
            memory["version"] += 1
            yield row("key", event.peer, "revoked")
            for peer in sorted(memory["peers"]):
                yield row("key", peer, "rotated")


def shared_keys(entries: DataFrame, trust: DataFrame) -> DataFrame:
    """Key rows and dead letters from a stream of entries(namespace, author, at, id, op, peer, ts); trust(author) is a bounded list of authors.

    The fan-out of a revoke goes to the peers that are in state at its time. Runs under `runs.keyed_state`.
    """
    known = entries.join(F.broadcast(trust.select("author").distinct().withColumn("trusted", F.lit(True))), "author", "left")
    known = known.withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    return known.groupBy("namespace").transformWithState(SharedKeys(), SharedKeys.puts, outputMode="Append", timeMode="EventTime")

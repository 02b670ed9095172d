"""Packing token pieces into sequences: bounded-space online best fit with a bitset of open bins."""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.tokens import ChunkIds, held
from lumora.session import settle, small_batches

PIECES = "id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """At most `many` open bins of one capacity. Bit f of the bitset is set where some bin has f free places.

    A piece goes to the bin with the least free space that still holds it; where none does, a new bin is opened, and if
    that is one too many the fullest open bin closes. Each step is a few operations on one integer.
    """

    def __init__(self, capacity: int, many: int):
        self.capacity, self.many = capacity, many
        self.bits, self.count = 0, 0
        self.by_free: dict[int, deque] = defaultdict(deque)

    def _take(self, free: int) -> list:
        held = self.by_free[free]
        out = held.popleft()
        if not held:
            self.bits ^= 1 << free
        self.count -= 1
        return out

    def _put(self, free: int, items: list) -> None:
        self.by_free[free].append(items)
        self.bits |= 1 << free
        self.count += 1

    def add(self, length: int, item) -> Iterator[tuple[int, list]]:
        """Place an item; yields (free, [(item, offset), ...]) of bins that close. rest() yields those still open."""
        fit = self.bits >> length
        if fit:
            free = (fit & -fit).bit_length() - 1 + length
            items = self._take(free)
        else:
            free, items = self.capacity, []
        items.append((item, self.capacity - free))
        if free == length:
            yield 0, items
            return
        self._put(free - length, items)
        if self.count > self.many:
            fullest = (self.bits & -self.bits).bit_length() - 1
            yield fullest, self._take(fullest)

    def rest(self) -> Iterator[tuple[int, list]]:
        while self.bits:
            free = (self.bits & -self.bits).bit_length() - 1
            yield free, self._take(free)


def token_pieces(
    df: DataFrame, path: str, limit: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", keep: int | None = None
) -> DataFrame:
    """id, piece, start, length, ids_crc32: every text's ids and end_id, cut only where longer than limit.

    keep bounds what a Python worker remembers of words (work and memory, not the result). Null texts count as empty (one piece that is end_id). Null ids stay null, repeated rows give repeated pieces.
    """
    end = end_id.to_bytes(4, "little")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = held(ChunkIds, path, keep)
        for frame in frames:
            rows, keys = [], iter(frame["id"].tolist())
            for batch in ids.batches(frame["text"].tolist()):
                for data in batch:
                    key, data = next(keys), data + end
                    for k in range(0, len(data), 4 * limit):
                        part = data[k : k + 4 * limit]
                        rows.append((key, k // (4 * limit), k // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"]).astype({"id": "Int64"})

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(cut, PIECES)


def _pack(pieces: DataFrame, capacity: int, many: int, lead: int) -> DataFrame:
    """One packing of every partition on its own; sequence ids are unique, free is what the sequence has left, open tells
    that its bin was still open when the partition ended."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, number, base, out = OpenBins(capacity, many), 0, None, []
        columns = ["id", "piece", "start", "length", "ids_crc32"]

        def closed(found, still_open=False):
            nonlocal number
            for free, items in found:
                out.extend((*item, base + number, at, free, still_open) for item, at in items)
                number += 1

        def frame_of(rows):
            return pd.DataFrame(rows, columns=[*columns, "sequence_id", "offset", "free", "open"]).astype({"id": "Int64"})

        for frame in frames:
            if base is None and len(frame):
                base = (lead << 56) + (int(frame["part"].iloc[0]) << 32)
            keys = [None if pd.isna(k) else int(k) for k in frame["id"]]
            for item in zip(keys, *(frame[c].tolist() for c in columns[1:])):
                closed(bins.add(item[3], item))
            if len(out) > 20_000:
                yield frame_of(out)
                out = []
        closed(bins.rest(), still_open=True)
        if out:
            yield frame_of(out)

    return pieces.withColumn("part", F.spark_partition_id().cast("long")).mapInPandas(
        run, f"{PIECES}, sequence_id long, offset long, free long, open boolean"
    )


def _shuffled(pieces: DataFrame, parts: int) -> DataFrame:
    """Pieces dealt and ordered by a hash of all they hold, so that every partition sees a fair mix of lengths.

    A random mix is what bounded space needs: with long pieces first, bins would close before short ones come.
    The deal is round-robin after a sort, so repeated rows don't gather.
    """
    order = F.xxhash64("id", "piece", "ids_crc32", "length")
    return pieces.repartition(parts).sortWithinPartitions(order, "id", "piece", "start")


def best_fit(
    df: DataFrame,
    path: str,
    capacity: int = 4096,
    end_id: int = 1,
    many: int = 512,
    parts: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: int | None = None,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, free.

    Partitions pack on their own with `many` open bins each. Bins still open when a partition ends are emptied and packed
    again in a sixteenth of the partitions, so the waste does not grow with their number, until one partition packs them all
    or a round saves less than a hundredth of its sequences (as where no two pieces fit together). A task of a later round gets the
    open bins of sixteen tasks, 16 * many at most, whatever the corpus. Only pieces move, never ids or texts.
    Null and empty texts are a piece of one token (end_id), null ids stay null, a very long text is cut into pieces of capacity,
    repeated rows are packed each, pieces that tie for a bin are told apart by their order alone; no rows in an empty table;
    other columns are not read.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with small_batches(df.sparkSession):
        now = settle(token_pieces(df, path, capacity, end_id, id_col, text_col, keep))
    lead, done, before = 0, None, None
    while True:
        packed = settle(_pack(_shuffled(now, parts), capacity, many, lead))
        used = packed.agg(F.count_distinct("sequence_id")).first()[0]
        if parts == 1 or (before is not None and used > 0.99 * before):
            return (packed if done is None else done.unionByName(packed)).drop("open")
        closed = packed.where("not open")
        done = closed if done is None else done.unionByName(closed)
        left = packed.where("open")
        before = left.agg(F.count_distinct("sequence_id")).first()[0]
        now = left.select("id", "piece", "start", "length", "ids_crc32")
        parts, lead = max(1, parts // 16), lead + 1

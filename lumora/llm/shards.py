"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.session import discard, settle

RANGE_BYTES = 1 << 30
MOST_RANGES = 16_384
COARSE = 3  # hex digits of a key that lead to its few candidate splitters: 4096 rows at most


def _key(text: Column) -> Column:
    return F.coalesce(F.md5(text), F.lit(""))


def _splitters(items: DataFrame, ranges: int, per_range: int) -> DataFrame:
    """Boundaries (key, id) of ranges of about equal bytes, from a sample in proportion to size.

    Each record draws -ln(u)/size from a hash of its key, and the smallest draws are the sample, so every sampled
    record stands for the same number of bytes and plain quantiles are the boundaries.
    """
    u = (F.shiftrightunsigned(F.xxhash64("key", "id"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    drawn = items.select("key", "id", (-F.log(u) / (F.col("size") * F.col("n"))).alias("draw"))
    drawn = drawn.orderBy("draw", "key", "id").limit(ranges * per_range)
    part = F.ntile(ranges).over(Window.orderBy("key", F.col("id").asc_nulls_first()))
    first = F.min(F.struct("key", F.col("id").isNotNull().alias("some"), "id")).alias("first")
    return drawn.withColumn("part", part).groupBy("part").agg(first).where("part > 1").select("first")


def _ranged(items: DataFrame, cuts: DataFrame) -> DataFrame:
    """items with a range number: how many of cuts(first) are not above (key, id)."""
    near = cuts.groupBy(F.substring("first.key", 1, COARSE).alias("coarse")).agg(
        F.collect_list("first").alias("firsts"), F.count("*").alias("here")
    )
    below = F.coalesce(F.sum("here").over(Window.orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = near.withColumn("below", below)
    # there are a bounded number of ranges, so both broadcast tables have at most that many rows and splitters
    coarse = F.substring("key", 1, COARSE)
    starts = near.agg(F.sort_array(F.collect_list(F.struct("coarse", (F.col("below") + F.col("here")).alias("upto")))).alias("all"))
    here = F.struct("key", F.col("id").isNotNull().alias("some"), "id")
    out = (
        items.withColumn("coarse", coarse)
        .join(F.broadcast(near), "coarse", "left")
        .join(F.broadcast(starts))
    )
    passed = F.coalesce(F.array_max(F.transform(F.filter("all", lambda s: s["coarse"] < F.col("coarse")), lambda s: s["upto"])), F.lit(0))
    inside = F.size(F.filter("firsts", lambda s: s <= here))
    number = F.when(F.col("firsts").isNull(), passed).otherwise(F.col("below") + inside)
    return out.select("key", "id", "size", "crc", "n", number.cast("int").alias("range"))


def _balanced(items: DataFrame, ranges: int, per_range: int, most: float = 2.0, tries: int = 4) -> tuple[DataFrame, DataFrame]:
    """(items with a range number, bytes and records of each range); ranges measured above `most` times the mean are subdivided.

    The splitters come from a sample, so a range can be larger than meant. Its records are sampled again for splitters of
    their own, until no range is overfull or one holds a single record. A key that holds many bytes is met by splitters
    with the same key and different ids, which subdivide it too.
    """
    cuts = settle(_splitters(items, ranges, per_range))
    for again in range(tries + 1):
        ranged = settle(_ranged(items, cuts))
        sums = settle(ranged.groupBy("range").agg(F.sum(F.col("size") * F.col("n")).alias("b"), F.sum("n").alias("c"), F.count("*").alias("k")))
        total = sums.agg(F.sum("b").alias("b")).first()["b"] or 0
        full = sums.where((F.col("b") > most * total / ranges) & (F.col("k") > 1))
        told = full.agg(F.sum("b").alias("b"), F.count("*").alias("n")).first()
        if not told["n"] or again == tries:
            return ranged, sums
        pieces = int(told["b"] * ranges // total) + 2 * told["n"]
        inside = ranged.join(F.broadcast(full.select("range")), "range", "left_semi").drop("range")
        was, cuts = cuts, settle(cuts.unionByName(_splitters(inside, pieces, per_range)).distinct())
        discard(was, ranged, sums)


def shard_by_bytes(
    df: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 8,
    ranges: int | None = None,
    per_range: int = 64,
    tolerance: float = 0.02,
) -> DataFrame:
    """One row per input row: id, size, crc, key (md5 of the text), shard, slot. Only DataFrame functions.

    Records are ordered by (key, id); splitters from a size-weighted sample deal them into ranges; ranges that turn out
    overfull are subdivided; and the ranges' exact sizes give every record its place in the total order of bytes, of which the
    shards are equal stretches. So shard sizes differ from the mean by one record and tolerance at most, whatever the
    sample was. A boundary that falls into a group of equal texts moves to the group's nearer end where that costs no more than
    tolerance of a shard's size; larger groups are cut. Slots count 0, 1, ... within a shard.

    Null texts are one group of size overhead, empty texts another; null ids come first in their group; records that tie in key and
    id are alike; repeated rows are counted together and spread again at the end; a very long text is one record, cut by no shard; an
    empty table gives no rows. Other columns are not read. Ranges hold about RANGE_BYTES, from 192 to MOST_RANGES of them
    unless given; with shards and per_range that bounds everything that is broadcast or gathered.
    """
    if shards < 1 or (ranges is not None and ranges < 2):
        raise ValueError("shards is 1 and ranges 2 at least")
    text = F.col(text_col)
    items = settle(
        df.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("crc"),
            _key(text).alias("key"),
        )
        .groupBy("id", "size", "crc", "key")
        .agg(F.count("*").alias("n"))
    )
    if ranges is None:
        total = items.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0
        ranges = min(MOST_RANGES, max(192, total // RANGE_BYTES))
    ranged, sums = _balanced(items, ranges, per_range)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        "range",
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("base_b"),
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base_c"),
    )
    inside = Window.partitionBy("range").orderBy("key", F.col("id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = settle(
        ranged.withColumn("run_b", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
        .withColumn("run_c", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(F.broadcast(bases), "range")
        .select(
            "id", "size", "crc", "key", "n",
            (F.col("base_b") + F.col("run_b")).alias("start"),
            (F.col("base_c") + F.col("run_c")).alias("rank"),
        )
    )
    bounds = _bounds(placed, shards, tolerance)
    # one chunk of up to 10000 repeats at a time, so that no array grows with the number of repeats
    chunk = 10_000
    spread = (
        placed.withColumn("c", F.explode(F.expr(f"sequence(0L, (n - 1) div {chunk})")))
        .withColumn("j", F.explode(F.expr(f"sequence(c * {chunk}, least(n, (c + 1) * {chunk}) - 1)")))
        .select(
            "id", "size", "crc", "key",
            (F.col("start") + F.col("j") * F.col("size")).alias("start"),
            (F.col("rank") + F.col("j")).alias("rank"),
        )
    )
    cuts = F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else F.array().cast("array<bigint>")
    spread = spread.withColumn("shard", F.size(F.filter(cuts, lambda c: c <= F.col("start"))))
    firsts = spread.groupBy("shard").agg(F.min("rank").alias("first"))  # one row a shard
    return spread.join(F.broadcast(firsts), "shard").select(
        "id", "size", "crc", "key", "shard", (F.col("rank") - F.col("first")).alias("slot")
    )


def _bounds(placed: DataFrame, shards: int, tolerance: float) -> list[int]:
    """The shards - 1 byte offsets at which a new shard starts."""
    total = placed.agg(F.sum(F.col("size") * F.col("n"))).first()[0]
    if not total or shards == 1:
        return []
    ideal = [total * k // shards for k in range(1, shards)]
    cuts = F.array(*(F.lit(x).cast("long") for x in ideal))
    end = F.col("start") + F.col("size") * F.col("n")
    met = placed.select("key", F.filter(cuts, lambda c: (c > F.col("start")) & (c < end)).alias("at")).where("size(at) > 0")
    cut_keys = met.select("key").distinct()  # at most shards - 1 keys
    ends = (
        placed.join(F.broadcast(cut_keys), "key", "left_semi")
        .groupBy("key")
        .agg(F.min("start").alias("low"), F.max(end).alias("high"))
    )
    out = dict.fromkeys(ideal)
    for row in ends.collect():
        for x in ideal:
            if row["low"] < x < row["high"]:
                side = min((row["low"], row["high"]), key=lambda y: abs(y - x))
                if abs(side - x) <= tolerance * total / shards:
                    out[x] = side
    return sorted(x if y is None else y for x, y in out.items())

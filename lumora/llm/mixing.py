"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.session import settle

PIECE = 500.0  # a larger mean is drawn as a sum of independent draws of at most this mean
FEW = 10_000
UNFOLD = 1_000


def poisson_count(rate: Column, seed: int, *key: Column) -> Column:
    """The Poisson quantile of a hash of (seed, key): the least k whose distribution function exceeds it.

    Null, negative and zero rates give 0. The same key gives the same count wherever and whenever it runs.
    """
    rate = F.coalesce(F.greatest(rate, F.lit(0.0)), F.lit(0.0)).cast("double")
    pieces = F.greatest(F.ceil(rate / PIECE), F.lit(1)).cast("int")

    def draw(i: Column) -> Column:
        mean = rate / pieces
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), i, *key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        far = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
        p = F.exp(-mean)
        start = F.struct(p.alias("p"), p.alias("below"), F.lit(0).alias("k"))

        def step(s: Column, k: Column) -> Column:
            p = s["p"] * mean / k
            return F.struct(p.alias("p"), (s["below"] + p).alias("below"), (s["k"] + (u >= s["below"]).cast("int")).alias("k"))

        return F.aggregate(F.sequence(F.lit(1), far), start, step, lambda s: s["k"])

    return F.aggregate(F.transform(F.sequence(F.lit(1), pieces), draw), F.lit(0), lambda a, b: a + b)


def source_rates(df: DataFrame, source_col: str, text_col: str, weights: dict[str | None, float] | None, power: float, volume: float) -> DataFrame:
    """(source, rate): mean repetitions that turn the sources' bytes into the target shares of volume * all bytes.

    weights: target share by source, other sources get none; without weights, a source's share goes with its
    bytes to the given power. Null is a source of its own; sources without bytes get rate 0.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    sums = df.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).cast("double").alias("b"))
    if weights is None:
        want = F.when(F.col("b") > 0, F.pow("b", F.lit(power))).otherwise(0.0)
    else:
        want = F.lit(0.0)
        for name, w in weights.items():
            want = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(want)
    sums = sums.withColumn("want", want)
    total = sums.agg(F.sum("b").alias("all_b"), F.sum("want").alias("all_want"))  # one row
    share = F.col("want") / F.col("all_want") * F.col("all_b") * volume / F.col("b")
    rate = F.when((F.col("b") > 0) & (F.col("all_want") > 0), share).otherwise(0.0)
    return sums.join(F.broadcast(total)).select("source", rate.alias("rate"))


def _told(rows: DataFrame, given: list[str]) -> DataFrame:
    """rows(id, source, text, *given) without text, and content, other, at: what, beside the id, a row's draw hangs on.

    A row whose id no other row has stays where it is (content and other null, at 0). Rows without an id and rows that repeat one
    are told apart by text and source, and where these are alike by all they hold (other; null for the first kind). Equal rows are one with a
    count, unfolded into at = 0, 1, ...: neither the layout of the files nor the order in which a task reads them changes a draw.
    The count is unfolded in pieces of UNFOLD, dealt anew in between, so a row that makes up much of the table is written by many tasks.
    """
    again = settle(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").select("id"))
    many = again.count()
    none = F.lit(None).cast("long")
    single = rows.select("id", "source", *given, none.alias("content"), none.alias("other"), F.lit(0).cast("long").alias("at"))
    if not many:
        return single
    found = F.broadcast(again) if many <= FEW else again
    text = F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("content")
    slim = rows.select("id", "source", *given, text)
    fold = lambda some: some.groupBy(*slim.columns).agg(F.count("*").alias("n"))
    # where the join deals rows by id, equal ones are folded first: one id may hold much of the table
    known = fold(slim.join(found, "id", "left_semi")) if many <= FEW else fold(slim).join(found, "id", "left_semi")
    every = F.xxhash64(F.to_json(F.struct(*given), {"ignoreNullFields": "false"}))  # with names and nulls, so unlike rows look unlike
    folded = settle(known.unionByName(fold(slim.where("id is null"))).withColumn("other", every))
    kinds = folded.groupBy("id", "content").agg(F.count("*").alias("kinds"), F.min("other").alias("least"))
    kinds = settle(kinds.where("kinds > 1").select(F.col("id").alias("id2"), F.col("content").alias("content2"), "least"))
    several = kinds.count()
    if several:
        same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("content") == F.col("content2"))
        folded = folded.join(F.broadcast(kinds) if several <= FEW else kinds, same, "left")
        folded = folded.withColumn("other", F.when(F.col("other") != F.col("least"), F.col("other")))
    else:
        folded = folded.withColumn("other", none)
    kept = ["id", "source", *given, "content", "other"]
    pieces = folded.select(*kept, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(UNFOLD).cast("long"))).alias("from"))
    last = F.least(F.col("from") + UNFOLD, F.col("n")) - 1
    whole = pieces.repartition("id", "content", "other", "from").select(*kept, F.explode(F.sequence(F.col("from"), last)).alias("at"))
    return single.where("id is not null").join(found, "id", "left_anti").select(whole.columns).unionByName(whole)


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: dict[str | None, float] | None = None,
    power: float = 0.5,
    volume: float = 1.0,
    seed: int = 17,
    copy_name: str = "copy",
    order_name: str = "mix_key",
) -> DataFrame:
    """Every row as often as its Poisson count says, in a global order by hash. Only DataFrame functions.

    Returns df's columns and copy (from 0) and mix_key (long, ascending over the whole result); columns of df with
    these two names give way, all other names are free. A row's count depends on its id and seed alone, with its source's rate as
    the mean. Rows without an id, or with one that repeats, draw by text and source, and each for itself where these are alike: the same rows
    give the same result in whatever files and order they come. Null and empty texts weigh
    no bytes but are repeated at their source's rate; a very long text weighs all its bytes; rows that tie in mix_key come in any order;
    an empty table gives no rows. The sort deals rows by a hash of all that tells them apart, so a source, an id or a text that holds
    most rows is spread like any other.
    """
    name = lambda c: F.col(f"`{c}`")
    kept = [c for c in df.columns if c not in (copy_name, order_name)]
    given = [f"given{k}" for k in range(len(kept))]  # so none of them can clash with the names below
    rows = df.select(
        *(name(c).alias(g) for c, g in zip(kept, given)), name(id_col).alias("id"), name(source_col).alias("source"), name(text_col).alias("text"),
    )
    rates = source_rates(rows, "source", "text", weights, power, volume).select(F.col("source").alias("source2"), "rate")
    if rates.count() <= FEW:
        rates = F.broadcast(rates)  # counted: few sources; more of them meet in a plain join
    met = _told(rows, given).join(rates, F.col("source").eqNullSafe(F.col("source2")))
    told = ["id", "content", "other", "at"]
    out = (
        met.withColumn("n", poisson_count(F.col("rate"), seed, *told))
        .where("n > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumn("order", F.xxhash64(F.lit(seed + 1), *told, "copy"))
        .orderBy("order")
    )
    return out.select(*(F.col(g).alias(c) for g, c in zip(given, kept)), F.col("copy").alias(copy_name), F.col("order").alias(order_name))


def exact_poisson(u: float, rate: float) -> int:
    """The same quantile by plain arithmetic, for tests."""
    p = below = math.exp(-rate)
    k = 0
    while u >= below and k < rate + 12 * math.sqrt(rate) + 40:
        k += 1
        p *= rate / k
        below += p
    return k

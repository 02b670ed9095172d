"""An inverted-list table of vectors: k-means in Spark, a stored partition for each list, searches that read a few of them or all."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lumora.operators.vectors import _lengths, _stacked
from lumora.session import discard, settle


#: Rows of a stored part of a list; rows of vectors or queries that are looked at together; visits of queries to parts that leave a task at once.
BLOCK = 2048
ROWS = 256
VISITS = 16_384


@dataclass(frozen=True)
class Lists:
    """A stored table below `path` (list, part, asset_id, vec), its centroids, the rows of each list, and how many lists a search reads."""

    path: str
    centroids: np.ndarray
    sizes: dict[int, int]
    probes: int


def _nearest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, some rows at a time."""
    return np.concatenate([np.zeros(0, np.int64), *(_lengths(m[a : a + ROWS], centres).argmin(1) for a in range(0, len(m), ROWS))])


def _visits(m: np.ndarray, centres: np.ndarray, parts: np.ndarray, probes: int, most: int = VISITS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, list, part) of the parts of the `probes` nearest lists of each row, at most `most` at once (or those of one row). parts: how many each list has."""
    step = max(1, min(ROWS, most // max(1, int(np.sort(parts)[::-1][:probes].sum()))))
    for a in range(0, len(m), step):
        near = np.argsort(_lengths(m[a : a + step], centres), axis=1, kind="stable")[:, :probes]
        each = parts[near].ravel()
        row = np.repeat(a + np.repeat(np.arange(len(near)), near.shape[1]), each)
        yield row, np.repeat(near.ravel(), each), np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)


def trained(vectors: DataFrame, many: int, rounds: int = 6) -> np.ndarray:
    """`many` centroids by k-means over all rows: rounds of assignment in tasks, sums by list in Spark, `many` means back. The first rows by hash are the start.

    Empty centroids stay where they are. The same rows give the same centroids, up to rounding, however they are laid out.
    """
    spark = vectors.sparkSession
    rows = settle(vectors.select("vec"))
    first = settle(vectors.orderBy(F.xxhash64("asset_id", F.lit(11)), "asset_id").limit(many).select("vec"))  # chosen in tasks, not by the driver
    start = first.collect()
    centres = np.array([r["vec"] for r in start], float) if start else np.zeros((0, 0))
    for _ in range(rounds if len(centres) else 0):
        held = spark.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(held.value), np.zeros(len(held.value), np.int64)
            for b in batches:
                m = _stacked(b.column(0))
                if len(m):
                    at = _nearest(m, held.value)
                    np.add.at(total, at, m)
                    n += np.bincount(at, minlength=len(n))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.float64()))], ["list", "n", "sums"])

        parts = rows.mapInArrow(sums, "list long, n long, sums array<double>").select("list", "n", F.posexplode("sums").alias("i", "s"))
        means = parts.groupBy("list", "i").agg((F.sum("s") / F.sum("n")).alias("m")).collect()
        centres = centres.copy()
        for r in means:
            centres[r["list"], r["i"]] = r["m"]
    discard(rows, first)
    return centres


def build(vectors: DataFrame, path: str, many: int | None = None, k: int = 20, recall: float = 0.95, tries: int = 64) -> Lists:
    """Write vectors(asset_id, vec) as lists below path and choose how many of them a search reads.

    There are as many lists as the root of the row count (4096 at most), and all rows train them. The number of lists read is measured: for `tries` stored vectors, drawn
    by hash, the k nearest are searched exactly, and as many lists are read as hold `recall` of these; without tries, all are read. Null ids and vectors are left out.
    """
    spark = vectors.sparkSession
    vectors = vectors.where("asset_id is not null and vec is not null").select("asset_id", F.col("vec").cast("array<double>").alias("vec"))
    n = vectors.count()
    centres = trained(vectors, many or min(4096, max(1, int(np.ceil(n**0.5)))))
    held = spark.sparkContext.broadcast(centres)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = _nearest(_stacked(b.column(1)), held.value)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.astype(np.int32))], ["asset_id", "vec", "list"])

    rows = settle(vectors.mapInArrow(placed, "asset_id long, vec array<double>, list int"))
    sizes = {r["list"]: r["n"] for r in rows.groupBy("list").agg(F.count("*").alias("n")).collect()}
    parts = F.broadcast(spark.createDataFrame([(a, -(-b // BLOCK)) for a, b in sizes.items()], "list int, parts int"))
    dealt = rows.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("asset_id"), "parts").cast("int")).drop("parts")
    dealt.repartition("list", "part").write.partitionBy("list").mode("overwrite").parquet(path)
    whole = Lists(path, centres, sizes, max(1, len(centres)))
    if not tries:
        return whole
    asked = vectors.orderBy(F.xxhash64("asset_id", F.lit(13)), "asset_id").limit(tries).select(F.col("asset_id").alias("query_id"), "vec")
    true = search(spark, whole, asked, k).join(rows.select("asset_id", "list"), "asset_id").select("query_id", "list").collect()
    ranks = []
    if true:
        at = {r["query_id"]: np.argsort(np.argsort(_lengths(np.array([r["vec"]], float), centres)[0], kind="stable")) for r in asked.collect()}
        ranks = sorted(int(at[r["query_id"]][r["list"]]) + 1 for r in true)
    return Lists(path, centres, sizes, ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)] if ranks else 1)


def search(spark: SparkSession, lists: Lists, queries: DataFrame, k: int = 20, exact: bool = False) -> DataFrame:
    """(query_id, rank, asset_id, score): the k largest dot products for each of queries(query_id, vec), ties by id; exact reads all lists.

    Only the partitions of lists that some query asks for are read. A list meets its queries in blocks of its stored parts, each block returns k rows a query.
    """
    schema = "query_id long, rank int, asset_id long, score double"
    if not lists.sizes:
        return spark.createDataFrame([], schema)
    probes = len(lists.centroids) if exact else min(lists.probes, len(lists.centroids))
    held = spark.sparkContext.broadcast(lists.centroids)
    parts = np.zeros(len(lists.centroids), np.int64)
    for at, n in lists.sizes.items():
        parts[at] = -(-n // BLOCK)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            for row, at, part in _visits(_stacked(b.column(1)), held.value, parts, probes):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(part.astype(np.int32))], ["query_id", "vec", "list", "part"])

    asked = queries.where("vec is not null").select("query_id", F.col("vec").cast("array<double>").alias("vec"))
    visits = settle(asked.mapInArrow(visit, "query_id long, vec array<double>, list int, part int"))
    wanted = [r[0] for r in visits.select("list").distinct().collect()]
    stored = spark.read.schema("asset_id long, vec array<double>, part int, list int").parquet(lists.path).where(F.col("list").isin(wanted))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, ids = _stacked(left.column("vec")), _stacked(right.column("vec")), right.column("asset_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, b = ids[order], b[order]
        asking, many = left.column("query_id").to_numpy(), min(k, len(b))
        best_ids, best_scores = np.zeros((len(asking), many), np.int64), np.zeros((len(asking), many))
        for at in range(0, len(asking) if many else 0, ROWS):
            q = a[at : at + ROWS]
            score = np.zeros((len(q), len(b)))
            for c in range(b.shape[1]):  # in the order of a plain sum
                score += q[:, c, None] * b[None, :, c]
            top = np.argsort(-score, axis=1, kind="stable")[:, :many]
            best_ids[at : at + ROWS], best_scores[at : at + ROWS] = ids[top], np.take_along_axis(score, top, 1)
        return pa.table({"query_id": pa.array(np.repeat(asking, many), pa.int64()), "asset_id": pa.array(best_ids.ravel(), pa.int64()), "score": pa.array(best_scores.ravel(), pa.float64())})

    met = visits.groupBy("list", "part").cogroup(stored.groupBy("list", "part")).applyInArrow(best, "query_id long, asset_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "asset_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "asset_id", "score")


def recall_at(found: DataFrame, true: DataFrame) -> float:
    """The share of true(query_id, asset_id) rows that found has too."""
    both = true.select("query_id", "asset_id").join(found.select("query_id", "asset_id", F.lit(1).alias("hit")), ["query_id", "asset_id"], "left")
    row: Row = both.agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return row["hits"] / row["n"] if row["n"] else 1.0

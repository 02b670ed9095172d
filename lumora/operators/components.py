"""Connected components of an edge table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.session import discard, settle


def _toward_minimum(edges: DataFrame, below_only: bool) -> DataFrame:
    """Hang the neighbours of every node on the smallest of them (the node itself included).

    below_only: a node looks at its smaller neighbours only; else it moves its larger ones.
    """
    ways = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if not below_only:
        ways = ways.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = ways.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = ways.join(least, "u")
    if below_only:
        own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(own)
    else:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the component's smallest node.

    Large-star and small-star rounds alternate until the edges no longer change; each round is a few
    shuffles of the edges, rounds grow with the logarithm of the component sizes, and every round ends in a
    written table. Self edges and repeated edges are allowed, null ends are ignored. No edges: no rows.
    """
    now = settle(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = None
    for _ in range(max_rounds):
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if row == mark or not row[0]:
            break
        mark = row
        was, now = now, settle(_toward_minimum(_toward_minimum(now, below_only=False), below_only=True))
        discard(was)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return out.unionByName(out.select(F.col("root").alias("node"), "root").distinct())

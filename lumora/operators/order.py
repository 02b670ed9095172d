"""Places and running sums in a global order, without a window over all rows: ranges are sorted apart, what came before each is added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.session import settle


def _ranged(rows: DataFrame, order: list, value: Column) -> tuple[DataFrame, DataFrame]:
    """rows as a written table with their range and place in it, and for each range the sum of value over the ranges before it."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    kept = settle(dealt.withColumn("__part", F.shiftright("__at", 33)))
    sums = kept.groupBy("__part").agg(F.sum(value).alias("__n"))  # a row a range
    return kept, sums.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their place from 0 in the order given, as a written table."""
    kept, before = _ranged(rows, order, F.lit(1).cast("long"))
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    return kept.join(F.broadcast(before), "__part").select(*rows.columns, place.alias(name))


def running(rows: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """rows with the sum of value over all rows up to and with their own in the order given."""
    kept, before = _ranged(rows, order, F.col(value))
    inside = F.sum(value).over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("__inside", inside).join(F.broadcast(before), "__part").select(*rows.columns, (F.col("__before") + F.col("__inside")).alias(name))

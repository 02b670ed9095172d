"""Table functions for SQL: rows out of arrays."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


@udtf(returnType=StructType([StructField("anchor", IntegerType()), *(StructField(c, DoubleType()) for c in ("score", "x1", "y1", "x2", "y2"))]))
class ExpandDetections:
    """A row for each anchor of a grid whose score reaches the threshold: its place, score and box.

    offsets hold left, top, right and bottom distances in strides for each anchor, row by row, four numbers each. Null scores and anchors without four
    distances give no row; nor do null arrays.
    """

    def eval(self, scores: list, offsets: list, stride: int, columns: int, threshold: float) -> Iterator[tuple]:
        for i, score in enumerate(scores or ()):
            sides = (offsets or [])[4 * i : 4 * i + 4]
            if score is None or score < threshold or len(sides) < 4 or None in sides:
                continue
            x, y = i % columns, i // columns
            left, top, right, bottom = sides
            yield i, float(score), float((x - left) * stride), float((y - top) * stride), float((x + right) * stride), float((y + bottom) * stride)


def register(spark: SparkSession) -> None:
    """expand_detections(scores, offsets, stride, columns, threshold) for queries written as text, with LATERAL."""
    spark.udtf.register("expand_detections", ExpandDetections)

"""Codes, keys, geometry and raster functions as columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from lumora.functions.scalars import each

BASE32 = "abcdefghijklmnopqrstuvwxyz234567"


def _bits(data: Column) -> Column:
    def of(digits: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.lpad(F.conv(F.substring(digits, i, F.lit(2)), 16, 2), 8, "0"))
        return F.when(F.length(digits) > 0, F.array_join(pairs, "")).when(digits.isNotNull(), "")

    return each(F.hex(data), of)


def base32(data: Column) -> Column:
    """Lower-case base 32 without padding."""

    def letters(bits: Column) -> Column:
        count = F.ceil(F.length(bits) / 5).cast("int")

        def of(padded: Column) -> Column:
            one = lambda i: F.substring(F.lit(BASE32), F.conv(F.substring(padded, (i - 1) * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))
            return F.array_join(F.transform(F.sequence(F.lit(1), count), one), "")

        return F.when(count > 0, each(F.rpad(bits, count * 5, F.lit("0")), of)).otherwise("")

    return each(_bits(data), letters)


def from_base32(text: Column, size: int = 16) -> Column:
    """The bytes of a base-32 text if it has no foreign sign and holds exactly `size` of them; else null."""
    place = lambda c: F.position(c, F.lit(BASE32)) - 1
    hexa = lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2 * size - 1)), lambda i: F.conv(F.substring(b, i * 4 + 1, F.lit(4)), 2, 16)), "")

    def of(known: Column) -> Column:
        bits = F.array_join(F.transform(F.split(F.lower(known), ""), lambda c: F.lpad(F.conv(place(c).cast("string"), 10, 2), 5, "0")), "")
        ok = known.rlike("^[A-Za-z2-7]+$") & (F.floor(F.length(known) * 5 / 8) == size)
        return F.when(ok, F.unhex(each(bits, hexa)))

    return each(text, of)


def text_key(kind: str) -> Column:
    return F.hex(F.encode(F.lit(f"c/{kind}"), "UTF-8"))


def member_key(asset_id: Column) -> Column:
    """`c/mem/` and the id in eight bytes, high ones first."""
    return F.concat(F.encode(F.lit("c/mem/"), "UTF-8"), F.unhex(F.lpad(F.hex(asset_id), 16, "0")))


def member_of(key: Column) -> Column:
    """The id in a member key; null for other keys."""
    tail = F.conv(F.hex(F.substring(key, 7, 8)), 16, -10).cast("long")
    return F.when((F.hex(F.substring(key, 1, 6)) == F.hex(F.encode(F.lit("c/mem/"), "UTF-8"))) & (F.octet_length(key) == 14), tail)


def padded_ids(ids: Column, size: int = 77, begin: int = 49406, end: int = 49407) -> Column:
    """Token ids between begin and end, cut or filled with end to exactly `size`."""
    body = F.concat(F.array(F.lit(begin)), F.slice(ids, 1, size - 2), F.array(F.lit(end)))
    return F.concat(body, F.array_repeat(F.lit(end), F.greatest(F.lit(size) - F.size(body), F.lit(0))))


def feature(lon: Column, lat: Column, **properties: Column) -> Column:
    """A point as a GeoJSON feature."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), F.struct(*(v.alias(k) for k, v in properties.items())).alias("properties")))


def on_canvas(lat: Column, lon: Column, width: int, height: int) -> Column:
    """struct(x, y): equirectangular pixels."""
    return F.struct(((lon + 180) / 360 * width).alias("x"), ((90 - lat) / 180 * height).alias("y"))


def merged_circles(circles: Column) -> Column:
    """Greedy merge of array<struct<x, y, r, n>> in order: a circle joins the first earlier one that it overlaps.

    The joined circle has their count, their weighted middle and the larger radius.
    """

    def step(done: Column, c: Column) -> Column:
        touch = lambda k: (k["x"] - c["x"]) * (k["x"] - c["x"]) + (k["y"] - c["y"]) * (k["y"] - c["y"]) < (k["r"] + c["r"]) * (k["r"] + c["r"])
        at = F.array_position(F.transform(done, lambda k: touch(k)), F.lit(True))

        def joined(k: Column) -> Column:
            n = k["n"] + c["n"]
            return F.struct(((k["x"] * k["n"] + c["x"] * c["n"]) / n).alias("x"), ((k["y"] * k["n"] + c["y"] * c["n"]) / n).alias("y"), F.greatest(k["r"], c["r"]).alias("r"), n.alias("n"))

        return each(at, lambda at: F.when(at == 0, F.concat(done, F.array(c))).otherwise(F.transform(done, lambda k, i: F.when(i + 1 == at, joined(k)).otherwise(k))))

    return F.aggregate(circles, F.slice(circles, 1, 0), step)


def fitted_similarity(source: Column, target: Column) -> Column:
    """struct(a, b, tx, ty) of the least-squares rotation, scale and shift of array<struct<x, y>> onto another.

    x' = a x - b y + tx, y' = b x + a y + ty; points in a heap give the shift alone.
    """

    def mean(points: Column, c: str) -> Column:
        return F.aggregate(points, F.lit(0.0), lambda s, p: s + p[c]) / F.size(points)

    def fit(m: Column) -> Column:
        pairs = F.arrays_zip(source.alias("s"), target.alias("t"))

        def terms(p: Column) -> Column:
            sx, sy, tx, ty = p["s"]["x"] - m["sx"], p["s"]["y"] - m["sy"], p["t"]["x"] - m["tx"], p["t"]["y"] - m["ty"]
            return F.struct((sx * tx + sy * ty).alias("c"), (sx * ty - sy * tx).alias("d"), (sx * sx + sy * sy).alias("n"))

        def total(name: str) -> Column:
            return F.aggregate(F.transform(pairs, terms), F.lit(0.0), lambda s, t: s + t[name])

        one = F.struct(total("c").alias("c"), total("d").alias("d"), total("n").alias("n"))

        def solve(t: Column) -> Column:
            a, b = F.when(t["n"] > 0, t["c"] / t["n"]).otherwise(1.0), F.when(t["n"] > 0, t["d"] / t["n"]).otherwise(0.0)
            return F.struct(a.alias("a"), b.alias("b"), (m["tx"] - a * m["sx"] + b * m["sy"]).alias("tx"), (m["ty"] - b * m["sx"] - a * m["sy"]).alias("ty"))

        return each(one, solve)

    means = F.struct(mean(source, "x").alias("sx"), mean(source, "y").alias("sy"), mean(target, "x").alias("tx"), mean(target, "y").alias("ty"))
    return each(means, fit)


def inverted_similarity(m: Column) -> Column:
    """The inverse of such a transform; null where it has none."""
    n = m["a"] * m["a"] + m["b"] * m["b"]
    a, b = m["a"] / n, -m["b"] / n
    return F.when(n > 1e-12, F.struct(a.alias("a"), b.alias("b"), (-(a * m["tx"] - b * m["ty"])).alias("tx"), (-(b * m["tx"] + a * m["ty"])).alias("ty")))


def moved(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m["a"] * x - m["b"] * y + m["tx"]).alias("x"), (m["b"] * x + m["a"] * y + m["ty"]).alias("y"))


def detections(scores: Column, offsets: Column, stride: int, columns: int, threshold: float) -> Column:
    """Boxes of a grid of anchors: array<struct<score, x1, y1, x2, y2>> where the score reaches the threshold.

    offsets holds left, top, right, bottom distances in strides for each anchor, row by row.
    """
    all_ = F.transform(
        F.sequence(F.lit(0), F.size(scores) - 1),
        lambda i: F.struct(
            F.get(scores, i).alias("score"),
            ((i % columns - F.get(offsets, i)["l"]) * stride).alias("x1"),
            ((F.floor(i / columns) - F.get(offsets, i)["t"]) * stride).alias("y1"),
            ((i % columns + F.get(offsets, i)["r"]) * stride).alias("x2"),
            ((F.floor(i / columns) + F.get(offsets, i)["b"]) * stride).alias("y2"),
        ),
    )
    return F.filter(all_, lambda b: b["score"] >= threshold)


@F.pandas_udf(ArrayType(FloatType()))
def floats(blob: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats of a blob; what is left over after whole numbers is dropped."""
    return blob.map(lambda b: None if b is None else np.frombuffer(bytes(b)[: len(b) // 4 * 4], "<f4"))


@F.pandas_udf(DoubleType())
def sharpness(gray: pd.Series, width: pd.Series) -> pd.Series:
    """Variance of the Laplacian of a grey raster in rows; 0 for rasters below three by three. Rasters of one size are stacked and done together."""
    out = np.zeros(len(gray))
    shapes = pd.DataFrame({"n": [len(g) for g in gray], "w": width.to_numpy(int)})
    for (n, w), at in shapes.groupby(["n", "w"]).indices.items():
        a = np.stack([np.asarray(gray.iloc[k], float) for k in at]).reshape(len(at), n // w, w)
        if min(a.shape[1:]) >= 3:
            out[at] = (a[:, :-2, 1:-1] + a[:, 2:, 1:-1] + a[:, 1:-1, :-2] + a[:, 1:-1, 2:] - 4 * a[:, 1:-1, 1:-1]).var(axis=(1, 2))
    return pd.Series(out)

"""Whitening of embeddings: distributed covariance, float32 eigenvectors refined by matrix multiplications in higher precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.session import discard, settle

HIGH = np.longdouble


def usable(vector: Column) -> Column:
    """True for vectors without null, NaN or infinite entries."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, odd), F.lit(False))


def whole_numbers(vector: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """floor(scale * c) + shift of every entry c, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + shift)


# eigenvectors --------------------------------------------------------------------------------------------------------


def _runs(values: np.ndarray, width: HIGH) -> list[np.ndarray]:
    """Places of values that are within width of the next one in order, in groups of two or more."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > width) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def refined(a: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, to double precision.

    float32 vectors X start. A round takes R = I - X'X and S = X'AX, from which eigenvalues s_ii / (1 - r_ii) and a correction X + XE follow, with
    e_ij = (s_ij + l_j r_ij) / (l_j - l_i) for eigenvalues further apart than the present error and r_ij / 2 for closer ones; the error squares in each
    round. Closer ones span a subspace that is already right but have no directions of their own yet: the matrix is seen through that subspace, less
    its mean eigenvalue, and solved there, so the differences have all their digits. Equal eigenvalues keep any basis of their subspace.
    """
    size = float(np.abs(a).max(initial=0))
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    a = np.asarray(a, HIGH) / HIGH(size)
    one = np.eye(len(a), dtype=HIGH)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(HIGH)
    before = np.inf
    for _ in range(rounds):
        r, s = one - x.T @ x, x.T @ a @ x
        r, s = (r + r.T) / 2, (s + s.T) / 2  # else close eigenvalues blow up what rounding made of them
        values = np.diag(s) / (1 - np.diag(r))
        error = 2 * (np.linalg.norm((s - np.diag(values)).astype(float)) + np.linalg.norm(a.astype(float)) * np.linalg.norm(r.astype(float)))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= error
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
        x = x + x @ e
        for group in _runs(values, HIGH(error)):
            y = x[:, group]
            mean = values[group].mean()
            inner = y.T @ (a @ y - mean * y)
            inner = (inner + inner.T) / 2
            high = np.abs(inner).max()
            if high > 0:
                x[:, group] = y @ np.linalg.eigh((inner / high).astype(float))[1].astype(HIGH)
        change = float(np.abs(e).max())
        if change < 1e-18 or (change < 1e-15 and change >= before / 2):
            break
        before = change
    for _ in range(2):  # what the last solves of close eigenvalues left of a right angle
        x = x + x @ ((one - x.T @ x) / 2)
    values = np.diag(x.T @ a @ x) * HIGH(size)
    order = np.argsort(-values, kind="stable")
    return values[order].astype(float), x[:, order].astype(float)


# sums over rows ------------------------------------------------------------------------------------------------------


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _exact_gram(y: np.ndarray) -> np.ndarray:
    """Sum over rows of the outer products of whole numbers, as exact Python integers: doubles in blocks whose sums stay below 2 ** 53."""
    out = np.zeros((y.shape[1], y.shape[1]), object)
    high = int(np.abs(y).max(initial=0))
    if high * high >= 1 << 53:
        wide = y.astype(object)
        return wide.T @ wide
    step = max(1, (1 << 53) // max(1, high * high))
    for k in range(0, len(y), step):
        block = y[k : k + step].astype(float)
        out = out + (block.T @ block).astype(np.int64).astype(object)
    return out


def _summed(rows: DataFrame, name: str, width: int, of: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """of(matrix of a batch), summed over all rows: each task sends one sum a place, Spark adds them up; as many rows as `of` has places come back."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                now = of(_matrix(b, name, width)).ravel()
                total = now if total is None else total + now
        if total is not None:
            values = [Decimal(int(v)) for v in total] if kind != "double" else total.astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(values, pa.float64() if kind == "double" else pa.decimal128(38, 0))], ["place", "value"])

    by = rows.select(name).mapInArrow(part, f"place long, value {kind}").groupBy("place").agg(F.sum("value").cast(kind).alias("value"))
    return np.array([r["value"] if kind == "double" else int(r["value"]) for r in by.orderBy("place").collect()], float if kind == "double" else object)


@dataclass(frozen=True)
class Whitening:
    """What rows are projected with: n and sums S of the fit list, components as columns, their eigenvalues and the trace."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        if int(np.abs(x).max(initial=0)) * self.n >= 1 << 62:
            raise OverflowError("n * x does not fit a long")
        return x * np.int64(self.n) - self.sums.astype(np.int64)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x).astype(float) / self.n) @ (self.vectors / np.sqrt(self.values))


def fitted(fit: DataFrame, width: int, most: int = 16, name: str = "x") -> Whitening:
    """The whitening of a list of distinct vectors of whole numbers, `width` of them each, from two passes over it.

    The first pass sums; the second centres at the mean rounded to whole numbers and sums products, both in exact integers, so the covariance is that of
    the list whatever the order of rows, and what rounding the mean left out is taken off exactly. Only width * width sums reach the driver.
    Components whose eigenvalue is zero within rounding (constant or dependent dimensions, or fewer vectors than dimensions) cannot be whitened and are left out.
    """
    head = _summed(fit, name, width, lambda m: np.append(m.sum(axis=0, dtype=object), len(m)), "decimal(38,0)")
    if not len(head):
        return Whitening(0, np.zeros(width, object), np.zeros((width, 0)), np.zeros(0), 0.0)
    n, sums = int(head[-1]), head[:-1]
    middle = np.array([(2 * int(s) + n) // (2 * n) for s in sums], np.int64)
    gram = _summed(fit, name, width, lambda m: _exact_gram(m - middle), "decimal(38,0)").reshape(width, width)
    left = sums - middle.astype(object) * n  # |left| <= n / 2
    whole = gram * n - np.outer(left, left)  # n * n * covariance, exact
    v = np.array([[HIGH(int(c)) for c in row] for row in whole], HIGH).reshape(width, width) / (HIGH(n) * HIGH(n))
    values, vectors = refined(v)
    kept = np.flatnonzero(values > width * 2.0**-50 * max(values.max(initial=0), 0))[:most]
    return Whitening(n, sums, vectors[:, kept], values[kept], float(np.trace(v)))


def identity_error(fit: DataFrame, by: Whitening, width: int, name: str = "x") -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, from a pass over the list."""
    k = len(by.values)
    if not k:
        return 0.0

    def of(m: np.ndarray) -> np.ndarray:
        w = by.project(m)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    got = _summed(fit, name, width, of, "double")
    mean = got[:k] / by.n
    return float(np.abs(got[k:].reshape(k, k) / by.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 16) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): each usable row's coordinate on each of the first `most` components.

    The covariance is fitted on every distinct vector once. Rows whose vector is null, or holds null, NaN or infinite entries, are dropped, as are vectors of another
    length than the most frequent one (the longer at a tie). Repeated rows and null ids come out as often as they came in. Components without variance are left
    out, so one distinct vector, like an empty table, gives no rows. deviation is exact; one that doesn't fit a long is an error. Only two columns are read.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).where(usable(F.col("v")) & (F.size("v") > 0))
    lengths = rows.groupBy(F.size("v").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("k")).first()
    width = lengths[0] if lengths else 1
    rows = rows.where(F.size("v") == width).select("id", whole_numbers(F.col("v")).alias("x"))
    fit = settle(rows.select("x").distinct())
    by = fitted(fit, width, most)
    off = identity_error(fit, by, width)
    discard(fit)
    kind = df.schema[id_col].dataType
    share = by.values / by.trace if by.trace else by.values

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(by.values)
        for b in batches:
            if not b.num_rows or not k:
                continue
            m = _matrix(b, "x", width)
            d = by.centred(m)
            if int(np.abs(d).max()) ** 2 * width >= 1 << 63:
                squares = np.array([sum(int(v) ** 2 for v in row) for row in d], object)
                if max(squares) >= 1 << 63:
                    raise OverflowError("deviation does not fit a long")
                squares = squares.astype(np.int64)
            else:
                squares = (d * d).sum(axis=1)
            w, at = by.project(m), np.repeat(np.arange(b.num_rows), k)
            ids = b.column(b.schema.get_field_index("id")).take(pa.array(at))
            size = len(at)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(size, by.n)), pa.array(squares[at]), pa.array(w.ravel()), pa.array(np.tile(share, b.num_rows)), pa.array(np.full(size, off))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(place, f"id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")

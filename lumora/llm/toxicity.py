"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams; its few weights are broadcast."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ASCII letters are made small, every other ASCII sign but digits parts words
_SIGNS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(128 + 128))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
SLICE = 1 << 20
# words of one stem share these first bytes
BEGINNINGS = (4, 5, 6, 7)


def _slices(text: str) -> Iterator[str]:
    """A long text in slices of about a million characters, cut at spaces or line ends only."""
    at = 0
    while len(text) - at > SLICE:
        cut = max(text.rfind(" ", at, at + SLICE), text.rfind("\n", at, at + SLICE))
        if cut <= at:  # one word longer than a slice
            ends = [x for x in (text.find(" ", at + SLICE), text.find("\n", at + SLICE)) if x >= 0]
            cut = min(ends, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(text: str, beginnings: tuple[int, ...] = BEGINNINGS) -> list[np.ndarray]:
    """Hashes of the small-letter words in order, then those of the beginnings (in bytes) of longer words.

    All words of a slice are hashed side by side, a byte of each at a time; what stands beyond the sixteenth byte goes in by CRC-32.
    """
    found: list[list[np.ndarray]] = [[] for _ in range(1 + len(beginnings))]
    for piece in _slices(text):
        data = piece.lower().encode("utf-8", "surrogatepass").translate(_SIGNS)
        signs = np.frombuffer(data, np.uint8)
        inside = np.zeros(len(signs) + 2, np.int8)
        inside[1:-1] = signs != 32
        edges = np.diff(inside)
        start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        size, h = end - start, np.full(len(start), 0x27220A95, np.uint64)
        for k in range(16):
            live = np.flatnonzero(size > k)
            if k in beginnings:
                found[1 + beginnings.index(k)].append(h[live] + np.uint64(k))
            if not len(live):
                break
            h[live] = (h[live] ^ signs[start[live] + k]) * _MIX[2]
            h[live] ^= h[live] >> np.uint64(32)
        for j in np.flatnonzero(size > 16):
            h[j] ^= np.uint64(zlib.crc32(data[start[j] + 16 : end[j]]) << 16)
        found[0].append(h)
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in found]


def features(text: str | None, bits: int = 32) -> np.ndarray:
    """The hashed features of a whole text: words, pairs of neighbours, pairs that skip a word, and beginnings of words; none for null or empty texts."""
    h, *starts = word_hashes(text or "")
    parts = [h * _MIX[0], *(x * _MIX[3] for x in starts)]
    if len(h) > 1:
        parts.append(h[:-1] * _MIX[1] + (h[1:] ^ np.uint64(0x5BD1E995)) * _MIX[2])
    if len(h) > 2:
        parts.append(h[:-2] * _MIX[3] + (h[2:] ^ np.uint64(0x1B873593)) * _MIX[4])
    mixed = np.concatenate(parts)
    return ((mixed ^ (mixed >> np.uint64(29))) * _MIX[0]) >> np.uint64(64 - bits)


@dataclass(frozen=True)
class Learner:
    """FTRL-proximal settings: step alpha, beta, L1 and L2 strength, passes over the rows, and the fewest rows that a feature must be in."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1
    passes: int = 8
    least_rows: int = 2
    bits: int = 32


def weight(z: np.ndarray, n: np.ndarray, by: Learner) -> np.ndarray:
    """Each coordinate's weight from its sums: zero while |z| is within L1, else a step at the coordinate's own rate."""
    return np.where(np.abs(z) <= by.l1, 0.0, (np.sign(z) * by.l1 - z) / ((by.beta + np.sqrt(n)) / by.alpha + by.l2))


def _chance(total: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(max(total, -35.0), 35.0)))


def train(rows: Iterable[tuple[int, str | None]], by: Learner) -> pd.DataFrame:
    """(feature, weight) of the features that keep a weight, and the intercept as feature -1; rows (label, text) are learnt in their order."""
    labels, sets = [], []
    for label, text in rows:
        labels.append(int(label))
        sets.append(np.unique(features(text, by.bits)).astype(np.uint32 if by.bits <= 32 else np.uint64))
    names, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint32), np.zeros(0, int))
    names = names[counts >= by.least_rows]
    own = []
    for k, s in enumerate(sets):
        at = np.minimum(np.searchsorted(names, s), max(len(names) - 1, 0))
        own.append(at[names[at] == s].astype(np.int32) if len(names) else np.zeros(0, np.int32))
        sets[k] = None
    z, n, base_z, base_n = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    for _ in range(by.passes):
        for label, at in zip(labels, own):
            w, zz, nn = weight(z[at], n[at], by), z[at], n[at]
            base = -base_z / ((by.beta + base_n**0.5) / by.alpha)
            slope = _chance(base + w.sum()) - label
            grown = nn + slope * slope
            z[at] = zz + slope - (np.sqrt(grown) - np.sqrt(nn)) / by.alpha * w
            n[at] = grown
            base_z += slope - ((base_n + slope * slope) ** 0.5 - base_n**0.5) / by.alpha * base
            base_n += slope * slope
    w = weight(z, n, by)
    kept = np.flatnonzero(w)
    base = -base_z / ((by.beta + base_n**0.5) / by.alpha)
    return pd.DataFrame({"feature": [-1, *map(int, names[kept])], "weight": [float(base), *map(float, w[kept])]})


def learnt(docs: DataFrame, labels: DataFrame, by: Learner = Learner(), sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: Column | None = None) -> pd.DataFrame:
    """The model's few weights, from at most `sample` labelled ids, drawn by hash.

    Ids with several labels take the more frequent one (toxic at a tie), ids with several texts the last in order; so the rows that are learnt from are
    bounded by `sample`, whatever the tables hold. They are learnt in the order of their hash by one task: the result doesn't depend on files or cores.
    Rows without id, label or text teach nothing.
    """
    key = F.col(f"`{id_col}`")
    voted = labels.where(F.col(f"`{label_col}`").isNotNull() & key.isNotNull())
    voted = (voted if usable is None else voted.where(usable)).groupBy(key.alias("id")).agg(F.avg(F.col(f"`{label_col}`").cast("double")).alias("share"))
    voted = voted.select("id", (F.col("share") >= 0.5).cast("int").alias("label"), F.xxhash64("id").alias("drawn"))
    chosen = F.broadcast(voted.orderBy("drawn", "id").limit(sample))
    rows = docs.select(key.alias("id"), F.col(f"`{text_col}`").alias("text")).join(chosen, "id").where("text is not null")
    rows = rows.groupBy("id", "label", "drawn").agg(F.max("text").alias("text"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield train((pair for b in batches for pair in zip(b["label"], b["text"])), by)

    one = rows.repartition(1).sortWithinPartitions("drawn", "id").select("label", "text")
    return one.mapInPandas(fit, "feature long, weight double").toPandas()


def scorer(model: pd.DataFrame, bits: int = 32):
    """A function text -> score from 0 to 1; texts without known features, null and empty ones included, have the intercept's."""
    base = float(model.loc[model["feature"] == -1, "weight"].sum())
    rest = model[model["feature"] >= 0].sort_values("feature")
    names, weights = rest["feature"].to_numpy().astype(np.uint64), rest["weight"].to_numpy()
    low = np.uint64(max(bits - 18, 0))
    door = np.zeros(1 << min(bits, 18), bool)  # most features are turned away by their first bits
    door[names >> low] = True

    def score(text: str | None) -> float:
        found = features(text, bits)
        found = found[door[found >> low]] if len(names) else found[:0]
        if len(found):
            at = np.minimum(np.searchsorted(names, found), len(names) - 1)
            at = np.unique(at[names[at] == found])
            return float(_chance(base + weights[at].sum()))
        return float(_chance(base))

    return score


def scored(docs: DataFrame, model: pd.DataFrame, bits: int = 32, text_col: str = "text") -> DataFrame:
    """docs with `score`, over whole texts of any length; the weights are broadcast: L1 leaves a few of the sample's features. A column score gives way."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = scorer(held.value, bits)
        for texts in batches:
            yield pd.Series([score(t) for t in texts], dtype="float64")

    return docs.withColumn("score", of(F.col(f"`{text_col}`")))


def remainder(id_col: str = "doc_id", of: int = 5) -> Column:
    """CRC-32 of the id as text, modulo `of`; null ids have none."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % of


def toxic_documents(docs: DataFrame, labels: DataFrame, by: Learner = Learner(), sample: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; labels of ids with remainder 0 are never learnt. An empty label table scores all rows 0.5.

    Null ids are scored and not held out; repeated rows are scored alike; columns other than id and text are never read.
    """
    model = learnt(docs, labels, by, sample, usable=remainder() != 0)
    out = scored(docs.select("doc_id", "text"), model, by.bits)
    return out.select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Texts as PNG media columns, read back with checksum tests, and low-frequency cosine hashes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(data: bytes, multiple: int) -> bytes:
    """data followed by bytes 255 up to a positive multiple."""
    short = -len(data) % multiple if data else multiple
    return data + b"\xff" * short


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int, level: int = 6) -> bytes:
    """An 8-bit greyscale PNG; of the filters none, sub and up, each row takes the one of least absolute sum."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left = np.zeros_like(rows)
    left[:, 1:] = rows[:, :-1]
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    ways = np.stack([rows, rows - left, rows - above])
    cost = np.abs(ways.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = ways[best, np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    packed = zlib.compress(lines.tobytes(), level)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", packed) + _chunk(b"IEND", b"")


def decode_png(blob: bytes) -> np.ndarray:
    """Samples (height, width) of an 8-bit greyscale PNG; ValueError on a broken signature, chunk or checksum."""
    if blob[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, packed, ended = 8, b"", [], False
    while at + 12 <= len(blob) and not ended:
        (size,) = struct.unpack(">I", blob[at : at + 4])
        kind, body = blob[at + 4 : at + 8], blob[at + 8 : at + 8 + size]
        told = blob[at + 8 + size : at + 12 + size]
        if len(told) < 4 or struct.pack(">I", zlib.crc32(kind + body)) != told:
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not ended or len(head) != 13:
        raise ValueError("a chunk is missing")
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", head)
    if (depth, colour, interlace) != (8, 0, 0):
        raise ValueError("only plain 8-bit greyscale")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if lines.size != height * (width + 1):
        raise ValueError("wrong amount of samples")
    lines = lines.reshape(height, width + 1)
    return _unfilter(lines[:, 0], lines[:, 1:])


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = rows.copy()
    plain = kinds == 1
    out[plain] = np.cumsum(rows[plain], axis=1, dtype=np.uint8)
    start, height = 0, len(rows)
    rest = np.flatnonzero(kinds >= 2)
    at = 0
    while at < len(rest):  # runs of "up" rows are one cumulative sum
        start = rest[at]
        end = start
        while end < height and kinds[end] == 2:
            end += 1
        if end > start:
            base = out[start - 1] if start else np.zeros(rows.shape[1], np.uint8)
            out[start:end] = np.cumsum(rows[start:end], axis=0, dtype=np.uint8) + base
            at = np.searchsorted(rest, end)
            continue
        above = out[start - 1].astype(int) if start else np.zeros(rows.shape[1], int)
        line, now, left, corner = rows[start].astype(int), out[start], 0, 0
        for i in range(rows.shape[1]):
            b = int(above[i])
            if kinds[start] == 3:
                guess = (left + b) // 2
            elif kinds[start] == 4:
                p = left + b - corner
                near = [abs(p - left), abs(p - b), abs(p - corner)]
                guess = (left, b, corner)[near.index(min(near))]
            else:
                raise ValueError(f"no filter {kinds[start]}")
            left, corner = (line[i] + guess) & 255, b
            now[i] = left
        at += 1
    return out


def _cosines(n: int, k: int) -> np.ndarray:
    at = np.arange(n)
    out = np.cos(np.pi * (2 * at[None, :] + 1) * np.arange(k)[:, None] / (2 * n)) * np.sqrt(2 / n)
    out[0] /= np.sqrt(2)
    return out


def _averages(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.linspace(0, size, parts + 1)
    low = np.minimum(edge[:-1].astype(int), size - 1)
    return low, np.maximum(edge[1:].astype(int), low + 1)


def cosine_hash(samples: np.ndarray, side: int = 32, keep: int = 8) -> bytes:
    """keep*keep bits: the signs of the lowest cosine-transform coefficients against their median.

    The image is averaged to side x side cells first; the constant term takes no part in the median.
    """
    total = np.zeros((samples.shape[0] + 1, samples.shape[1] + 1), np.int64)
    total[1:, 1:] = samples.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    top, bottom = _averages(samples.shape[0], side)
    left, right = _averages(samples.shape[1], side)
    area = (bottom - top)[:, None] * (right - left)[None, :]
    box = total[bottom][:, right] - total[top][:, right] - total[bottom][:, left] + total[top][:, left]
    low = _cosines(side, keep) @ (box / area) @ _cosines(side, keep).T
    flat = np.round(low.ravel(), 6)
    bits = flat > np.median(flat[1:])
    bits[0] = flat[0] > 127.5 * side
    return np.packbits(bits).tobytes()


def to_media(text: Column, unit: int = 576, width: int = 192) -> Column:
    """Binary PNG of each whole text's UTF-8 bytes, padded to a positive multiple of unit. Null text: empty."""

    @F.pandas_udf("binary")
    def stored(texts: pd.Series) -> pd.Series:
        return pd.Series([encode_png(pad((t or "").encode("utf-8", "surrogatepass"), unit), width) for t in texts], dtype=object)

    return stored(text)


def read_media(media: Column) -> Column:
    """struct(payload binary, feature binary) from stored PNG bytes; a null or broken medium gives null."""

    @F.pandas_udf("payload binary, feature binary")
    def read(blobs: pd.Series) -> pd.DataFrame:
        out = []
        for b in blobs:
            try:
                samples = decode_png(bytes(b))
                out.append((samples.tobytes(), cosine_hash(samples)))
            except (TypeError, ValueError, zlib.error):
                out.append((None, None))
        return pd.DataFrame(out, columns=["payload", "feature"], dtype=object)

    return read(media)


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 576, width: int = 192) -> DataFrame:
    """id, n_bytes, media (PNG), payload (read back from media), feature (binary cosine hash), one row per row.

    Null texts count as empty; equal texts give equal media and features; a very long text is one tall picture; coefficients of the
    feature that tie with their median count as below it; ids may be null or repeated; an
    empty table gives no rows and other columns are not read. Rows never move: there is no shuffle.
    """
    stored = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        to_media(F.col(text_col), unit, width).alias("media"),
    )
    return stored.withColumn("back", read_media(F.col("media"))).select(
        "id", "n_bytes", "media", F.col("back.payload").alias("payload"), F.col("back.feature").alias("feature")
    )

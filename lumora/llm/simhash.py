"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.operators.components import components
from lumora.session import settle

BYTES = 8
PIECES = 4  # neighbouring byte positions are posted two by two
BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of one text's word shingles, repeats included. No word (or null): 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [digest(b" ".join(words), 42)]
    else:
        hashes = [digest(b" ".join(g), 42) for g in zip(*(words[k:] for k in range(width)))]
    return majority(hashes)


def majority(hashes: list[int] | np.ndarray) -> int:
    """The fingerprint of hashes: as a signed long, the bits that are set in over half of them. No hash: 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = np.asarray(hashes[at : at + BLOCK], dtype=np.uint64).astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes))
    return int(bits.view(">i8")[0])


def fingerprint_column(text: Column, width: int = 3) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return of(text)


def _byte(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255).cast("long"))


def shared_bytes(a: Column, b: Column) -> Column:
    """The tally: at how many of the eight positions both fingerprints have the same byte."""
    x = a.bitwiseXOR(b)
    return sum(((_byte(x, k) == 0).cast("int") for k in range(BYTES)), F.lit(0))


def _first_shared(a: Column, b: Column, kept: list[tuple[int, ...]]) -> Column:
    """The first posting list that holds both, so that a pair is met once."""
    x = a.bitwiseXOR(b)
    same = [(_byte(x, 2 * k) == 0) & (_byte(x, 2 * k + 1) == 0) for k in range(PIECES)]
    out = F.lit(-1)
    for n, at in reversed(list(enumerate(kept))):
        whole = same[at[0]]
        for k in at[1:]:
            whole = whole & same[k]
        out = F.when(whole, F.lit(n)).otherwise(out)
    return out


def links(nodes: DataFrame, max_bits: int = 2, long_list: int = 128) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints at max_bits or fewer.

    nodes: one column fp, distinct. Differing bits touch at most max_bits bytes, so a pair shares at least
    8 - max_bits positional bytes and 4 - max_bits of the four positional pairs of bytes. The inverted index has a list for each
    choice of so many pairs and their bytes: at 2 bits six postings a fingerprint, of four bytes each (lists of single
    bytes would hold a 256th of all fingerprints). Two members of a list share four bytes by chance; the tally of all their
    shared positional bytes keeps those that reach the guaranteed minimum, and the Hamming distance verifies them.
    Lists longer than long_list emit no pairs: their members (distinct fingerprints) are linked exactly through keys that
    only fingerprints within max_bits can share.
    """
    if not 1 <= max_bits <= 2:
        raise ValueError("max_bits is 1 or 2")
    kept = list(combinations(range(PIECES), PIECES - max_bits))
    fp = F.col("fp")
    keys = []
    for n, at in enumerate(kept):
        mask = sum(65535 << (16 * k) for k in at)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(n).alias("list"), fp.bitwiseAND(F.lit(mask).cast("long")).alias("bytes")))
    posts = nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.list", "k.bytes")
    sizes = posts.groupBy("list", "bytes").agg(F.count("*").alias("n"))
    posts = settle(posts.join(sizes.where("n > 1"), ["list", "bytes"]))
    short = posts.where(F.col("n") <= long_list)
    a, b = short.alias("x"), short.alias("y")
    fa, fb = F.col("x.fp"), F.col("y.fp")
    pairs = a.join(
        b,
        (F.col("x.list") == F.col("y.list"))
        & (F.col("x.bytes") == F.col("y.bytes"))
        & (fa < fb)
        & (shared_bytes(fa, fb) >= BYTES - max_bits)
        & (F.bit_count(fa.bitwiseXOR(fb)) <= max_bits)
        & (_first_shared(fa, fb, kept) == F.col("x.list")),
    ).select(fa.alias("a"), fb.alias("b"))
    # two fingerprints within 2 bits are one bit or none away from a common point, and all that are so from
    # one point lie within 2 bits of each other: a star over each point's visitors loses no link
    crowd = posts.where(F.col("n") > long_list).select("fp").distinct()
    flips = [fp] + [fp.bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")) for k in range(64)]
    if max_bits == 1:
        # within 1 bit: the same point is shared with that bit cleared
        flips = [fp.bitwiseAND(F.lit(~(1 << k) if k < 63 else (1 << 63) - 1).cast("long")) for k in range(64)]
        visits = crowd.select("fp", F.posexplode(F.array(*flips)).alias("bit", "point"))
        by = ["bit", "point"]
    else:
        visits = crowd.select("fp", F.explode(F.array(*flips)).alias("point"))
        by = ["point"]
    centre = visits.groupBy(*by).agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = visits.join(centre, by).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars)


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2, long_list: int = 128
) -> DataFrame:
    """One row per input row: id, fp (signed long), component_id (smallest id reachable over links).

    Equal fingerprints are one node, so groups of copies cost one row after the first aggregation. Null and
    empty texts have fingerprint 0 and link like any other. Rows with a null id keep their fingerprint and
    get the smallest non-null id of their component (null if there is none). An empty table gives no rows;
    other columns of df are not read.
    """
    prints = settle(df.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), width).alias("fp")))
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(nodes.select("fp"), max_bits, long_list))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

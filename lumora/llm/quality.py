"""Quality rules: every rule is measured once into a bitmask ledger; policies are masks over it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, "
    "n_repeat_words long, n_caps long, n_letters long, n_same_next long, n_marked long"
)
# name, failing condition over the measures; a rule's bit is its place here and never changes meaning
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("long_words", "word_chars > 12 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("capitals", "2 * n_caps > n_letters and n_letters > 0"),
    ("marked_words", "10 * n_marked > 3 * n_words"),
    ("stutter", "2 * n_same_next > n_words"),
    ("no_words", "n_words < 1"),
)
BASE = ("few_words", "repeated_windows")
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "long_words", "short_words", "stutter"),
    "v3": tuple(name for name, _ in RULES),
    # short texts stay if nothing else is wrong with them
    "v4": ("repeated_windows", "symbols", "long_words", "short_words", "stutter", "no_words"),
}


def _repeats(words: list[bytes], width: int) -> int:
    """Words inside windows that occur twice or more, the first included. Windows are compared exactly."""
    if len(words) <= width:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    span, left = 1, width
    have, at = None, 0
    while left:  # windows are joined from pieces of 1, 2, 4, ... words, renumbered at each step
        if left & 1:
            piece = ids if have is None else None
            if have is None:
                have = piece
            else:
                n = min(len(have), len(ids) - at)
                _, have = np.unique(have[:n] * (int(ids.max()) + 1) + ids[at : at + n], return_inverse=True)
            at += span
        left >>= 1
        if left:
            n = len(ids) - span
            _, ids = np.unique(ids[:n] * (int(ids.max()) + 1) + ids[span:], return_inverse=True)
            span *= 2
    twice = np.bincount(have)[have] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    start = np.flatnonzero(twice)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TRAIL = np.zeros(256, bool)
_TRAIL[128:192] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_CAP = np.zeros(256, bool)
_CAP[65:91] = True
_LETTER = _CAP.copy()
_LETTER[97:123] = True


def measure(text: str | None, width: int = 8) -> tuple[int, ...]:
    """The measures of one whole text; null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = [x for x in data.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:]))
    marked = sum(w.endswith((b"!!", b"??", b"###", b"***", b"$$$", b"%%%", b"&&&")) for w in words)
    return (
        len(words),
        int(counts.sum() - counts[_SPACE].sum() - counts[_TRAIL].sum()),
        int(counts[_SYMBOL].sum()),
        len(lines),
        len(lines) - len(set(lines)),
        _repeats(words, width),
        int(counts[_CAP].sum()),
        int(counts[_LETTER].sum()),
        same,
        marked,
    )


def measures(text: Column, width: int = 8) -> Column:
    @F.pandas_udf(MEASURES)
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t, width) for t in texts], columns=[x.split()[0] for x in MEASURES.split(", ")], dtype="int64")

    return of(text)


def mask(names: tuple[str, ...]) -> int:
    at = {name: k for k, (name, _) in enumerate(RULES)}
    return sum(1 << at[n] for n in names)


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """id, measures and `failed` (long, bit k: rule k failed), one row per row; with keep, df's columns too.

    Each rule is evaluated once per text over the whole text, however long. Null texts have no words and fail few_words and no_words.
    Null ids and repeated rows are measured like any other, ties at a rule's limit pass it, an empty table gives no rows; columns of df
    that share a measure's name, or are named failed, give way, all other names are free. Rows never move: there is no shuffle.
    """
    names = [x.split()[0] for x in MEASURES.split(", ")]
    own = [c for c in df.columns if c not in {*names, "failed"}] if keep else []
    free = max(df.columns, key=len) + "_"  # longer than any given name
    first = [F.col(f"`{c}`") for c in own] if keep else [F.col(id_col).alias("id")]
    out = df.select(*first, measures(F.col(f"`{text_col}`")).alias(free)).select(*([f"`{c}`" for c in own] or ["id"]), f"`{free}`.*")
    bits = sum((F.when(F.expr(test), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, test) in enumerate(RULES)), F.lit(0))
    return out.withColumn("failed", bits.cast("long"))


def verdict(failed: Column, policy: str) -> Column:
    """True where no rule of the policy failed."""
    return failed.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """rule, n_failed, n_only (rows that this rule alone rejects), n_kept_without, from the ledger's masks.

    Rows are first counted by mask (2 ** rules masks at most), so nothing but those counts moves.
    """
    whole = mask(POLICIES[policy])
    masks = book.groupBy(F.col("failed").bitwiseAND(F.lit(whole).cast("long")).alias("m")).agg(F.count("*").alias("n"))
    at = {name: k for k, (name, _) in enumerate(RULES)}
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(1 << at[n]).cast("long").alias("bit")) for n in POLICIES[policy])))
    each = masks.withColumn("r", rows)
    hit = F.col("m").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("m") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("m").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )

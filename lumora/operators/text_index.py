"""Exact-word search over a keyed token index: an inverted table of blinded tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.functions import scalars as S
from lumora.session import small_batches


def token_index(texts: DataFrame, key: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(token, id): one row for each distinct token of a text, without a shuffle; texts without tokens have none."""
    rows = texts.select(F.col(id_col).alias("id"), F.explode(S.words(F.col(text_col))).alias("word"))
    return rows.select(S.blind(key, F.col("word")).alias("token"), "id")


def reindexed(index: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """The index after texts changed: their old tokens go, the new ones come."""
    return without(index, changed).unionByName(token_index(changed, key))


def without(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the tokens of gone(id). Tokens travel as bytes, half as long as their digits."""
    packed = index.select("id", F.unhex("token").alias("token"))
    return packed.join(gone.select("id"), "id", "left_anti").select(F.lower(F.hex("token")).alias("token"), "id")


def token_counts(index: DataFrame) -> DataFrame:
    """(id, n): the different tokens of each id; what meets is the tokens' bytes."""
    return index.select("id", F.unhex("token").alias("token")).groupBy("id").agg(F.count_distinct("token").alias("n"))


def and_search(index: DataFrame, query: str, key: str, limit: int | None = 100) -> DataFrame:
    """Ids whose texts hold every token of the query, ascending, at most limit (clamped to 1..500; None: all).

    The query's tokens come from the same column function as the index's. A query without tokens finds nothing.
    """
    spark = index.sparkSession
    asked = spark.range(1).select(F.explode(S.tokenize(F.lit(query))).alias("word")).select(S.blind(key, F.col("word")).alias("token"))
    need = asked.count()  # as many rows as query words
    if not need:
        return index.select("id").limit(0)
    hits = index.join(F.broadcast(asked), "token").distinct().groupBy("id").agg(F.count("*").alias("n"))
    out = hits.where(F.col("n") == need).select("id").orderBy("id")
    return out if limit is None else out.limit(max(1, min(limit, 500)))


def _inverted(ids: list[pa.Array], words: list[pa.Array]) -> pa.RecordBatch:
    """(word, ids): the rows of these (ids, lists of words), one for each word."""
    lists = pa.concat_arrays(words)
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    ends = np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))
    found = pa.concat_arrays(ids).take(pa.array(row[np.argsort(code, kind="stable")]))
    return pa.RecordBatch.from_arrays([coded.dictionary, pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), found)], ["word", "ids"])


def postings(texts: DataFrame, key: str, id_col: str = "id", text_col: str = "text", most: int = 1_000_000) -> DataFrame:
    """(token, ids): token_index with the ids of a token together, as far as they meet in one task among about `most` words.

    A word is blinded once for these ids, not once for each; a frequent word has a row for each such part, so no row grows with the table.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, n = [], [], 0
        for batch in batches:
            ids.append(batch.column(0))
            words.append(batch.column(1))
            n += len(words[-1].flatten())
            if n >= most:
                yield _inverted(ids, words)
                ids, words, n = [], [], 0
        if n:
            yield _inverted(ids, words)

    rows = texts.select(F.col(id_col).alias("id"), S.words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    met = rows.mapInArrow(gather, f"word string, ids array<{rows.schema['id'].dataType.simpleString()}>")
    return met.select(S.blind(key, F.col("word")).alias("token"), "ids")


def store(texts: DataFrame, key: str, path: str, batch: int = 0, id_col: str = "id", text_col: str = "text") -> None:
    """Add texts to the stored index below path: tokens(prefix, token, ids, batch) in a folder for each first hex digit pair, and ids(id, batch).

    A later batch that has an id again stands for all of that id (a text without tokens clears it): nothing that is stored is rewritten. Token rows of one frequent
    word are dealt out over several files; within a file rows are sorted, so a search skips what can't hold its tokens. A batch that is written again replaces itself.
    """
    with small_batches(texts.sparkSession):
        rows = postings(texts, key, id_col, text_col).withColumn("prefix", F.substring("token", 1, 2))
        rows.hint("rebalance", "prefix").sortWithinPartitions("prefix", "token").write.partitionBy("prefix").mode("overwrite").parquet(f"{path}/tokens/batch={batch}")
    texts.select(F.col(id_col).alias("id")).where("id is not null").distinct().write.mode("overwrite").parquet(f"{path}/ids/batch={batch}")


def stored(spark: SparkSession, path: str, tokens: list[str] | None = None) -> DataFrame:
    """(token, id, batch) rows of the stored index, those of tokens only if given: their prefixes' folders, and in these their rows."""
    out = spark.read.schema("token string, ids array<long>, prefix string, batch int").parquet(f"{path}/tokens")
    if tokens is not None:
        out = out.where(F.col("prefix").isin(sorted({t[:2] for t in tokens})) & F.col("token").isin(tokens))
    return out.select("token", F.explode("ids").alias("id"), "batch")


def search_stored(spark: SparkSession, path: str, query: str, key: str, limit: int | None = 100) -> DataFrame:
    """What and_search finds, from the stored index alone: no text is read, and only the parts that may hold the query's tokens."""
    words = spark.range(1).select(F.explode(S.tokenize(F.lit(query))).alias("word")).select(S.blind(key, F.col("word")).alias("token"))
    tokens = [r["token"] for r in words.collect()]  # a query's words
    if not tokens:
        return spark.createDataFrame([], "id long")
    hits = stored(spark, path, tokens).groupBy("id", "batch").agg(F.count_distinct("token").alias("n")).where(F.col("n") == len(tokens))
    ids = spark.read.schema("id long, batch int").parquet(f"{path}/ids")
    latest = ids.join(hits.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.max("batch").alias("batch"))
    out = hits.join(latest, ["id", "batch"]).select("id").orderBy("id")
    return out if limit is None else out.limit(max(1, min(limit, 500)))


def store_lines(lines: DataFrame, key: str, path: str, batch: int, id_col: str = "id", lines_col: str = "lines") -> None:
    """Index assets by the text of their recognised lines (JSON): the tokens of all lines of an asset together."""
    store(lines.select(F.col(id_col).alias("id"), lines_text(F.col(lines_col)).alias("text")), key, path, batch)


LINES = "array<struct<text:string,bbox:array<int>,conf:float>>"


def lines_text(lines_json: Column) -> Column:
    """The joined text of recognised lines stored as JSON; broken JSON gives an empty text."""
    lines = F.from_json(lines_json, LINES)
    return F.coalesce(F.array_join(F.transform(lines, lambda x: x["text"]), " "), F.lit(""))

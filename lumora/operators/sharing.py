"""Shares as record changes: published entries, recipients, revocation, links, bundles, stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions import codes
from lumora.operators.order import running


def published(album: DataFrame, members: DataFrame) -> DataFrame:
    """(namespace, key, value, ts) entries that share albums(id, name, at): one meta entry each and one for each member.

    The same album gives the same keys, so publishing again changes nothing under last-write-wins.
    """
    meta = album.select(F.col("id").alias("namespace"), codes.text_key("meta").alias("key"), F.to_json(F.struct("name")).alias("value"), F.col("at").alias("ts"))
    per = members.join(album.select(F.col("id").alias("collection_id"), "at"), "collection_id")
    each = per.select(F.col("collection_id").alias("namespace"), F.hex(codes.member_key(F.col("asset_id"))).alias("key"), F.to_json(F.struct("asset_id")).alias("value"), F.col("at").alias("ts"))
    return meta.unionByName(each)


def recipients(keys: DataFrame, peers: DataFrame) -> DataFrame:
    """Key rows(collection_id, peer_identity) with the peer's node, blank where unknown; of several nodes the smallest."""
    node = peers.groupBy("peer_identity").agg(F.min("peer_node").alias("peer_node"))
    return keys.join(node, "peer_identity", "left").select("collection_id", "peer_identity", F.coalesce("peer_node", F.lit("")).alias("peer_node"))


def revoked(keys: DataFrame, ledger: DataFrame, collection_id: int, peer: str, at: int) -> tuple[DataFrame, DataFrame]:
    """(keys, ledger) after a peer lost a collection: its key goes, the ledger gains `revoked` and `rotated` for each that stays."""
    gone = (F.col("collection_id") == collection_id) & (F.col("peer_identity") == peer)
    stay = keys.where(~gone)
    spark = keys.sparkSession
    one = spark.createDataFrame([(collection_id, peer, "revoked", at)], "collection_id long, peer_identity string, status string, changed_at long")
    rest = stay.where(F.col("collection_id") == collection_id).select("collection_id", "peer_identity", F.lit("rotated").alias("status"), F.lit(at).cast("long").alias("changed_at"))
    return stay, ledger.unionByName(one).unionByName(rest)


def live(links: DataFrame, now: int) -> DataFrame:
    """Links without an expiry or before it."""
    return links.where(F.col("expires").isNull() | (F.lit(now) < F.col("expires")))


def bundle(members: DataFrame, most: int = 200, max_bytes: int = 1_000_000) -> DataFrame:
    """(collection_id, n, manifest): JSON of each collection's first `most` members by id that are not too large.

    A manifest is a bounded file by contract; ranks are cut before anything is collected.
    """
    r = F.row_number().over(Window.partitionBy("collection_id").orderBy("asset_id"))
    first = members.withColumn("r", r).where(F.col("r") <= most).where(F.col("bytes") <= max_bytes)
    rows = F.array_sort(F.collect_list(F.struct("asset_id", "bytes")))
    return first.groupBy("collection_id").agg(F.count("*").alias("n"), F.to_json(F.struct(rows.alias("items"))).alias("manifest"))


def survey(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """expected(name, hash) with present and valid against actual(name, hash)."""
    there = actual.select("name", F.col("hash").alias("__found"))
    out = expected.join(there, "name", "left")
    return out.withColumn("present", F.col("__found").isNotNull()).withColumn("valid", F.coalesce(F.col("__found") == F.col("hash"), F.lit(False))).drop("__found")


def blob_path(hash_col):
    """Place of a blob in a content-addressed folder: two digits, then the whole key."""
    return F.concat_ws("/", F.lit("cas"), F.substring(hash_col, 1, 2), hash_col)


def evicted(files: DataFrame, max_bytes: int) -> DataFrame:
    """Files(path, bytes, mtime) to drop, oldest first, until the rest fits: newest files stay while their running sum fits, ties by path."""
    ranked = running(files, [F.col("mtime").desc(), F.col("path")], "bytes", "upto")
    return ranked.where(F.col("upto") > max_bytes).select(*files.columns)

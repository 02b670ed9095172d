"""Inserts, upserts and appends under each of the catalogue's keys, lookups, and small functions over whole tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lumora.functions import codes
from lumora.functions import scalars as S
from lumora.operators import ingest as I
from lumora.operators import library as L
from lumora.operators import records as R
from lumora.plans.book import QUERIES, query
from lumora.session import load
from lumora.sources import catalogue as C
from lumora.sources.catalogue import with_tables

#: query: what it writes, and the columns of its key as expressions over lineitem (both dialects read them alike)
INSERTS = {
    "locations_deduped": ("a file's place, by asset, source and path", {"asset_id": "l_orderkey", "source_id": "l_suppkey", "path_hash": "concat('p', l_linenumber % 3)"}),
    "locations_inserted": ("a file's place, by asset and source", {"asset_id": "l_orderkey", "source_id": "l_suppkey"}),
    "members_added": ("a member of a collection", {"collection_id": "l_suppkey % 25", "asset_id": "l_orderkey"}),
}
#: the same over events
UPSERTS = {
    "wrapped_keys_upserted": ("a peer's wrapped key of a collection", {"collection_id": "user_id % 25", "peer": "concat('u', event_id % 40)"}),
    "peer_accepts_upserted": ("a peer that was accepted, by its node", {"node": "concat('n', user_id)"}),
    "edits_upserted": ("the edit of an asset", {"asset_id": "user_id"}),
    "derivatives_replaced": ("a derived picture of an asset, by kind", {"asset_id": "user_id", "kind": "event_type"}),
    "hashes_upserted": ("the hash of an asset", {"asset_id": "event_id % 1000"}),
}
#: query: (table, id, name) of the rows there are, and (table, name) of the new ones
APPENDS = {
    "links_appended": (("supplier", "s_suppkey", "s_name"), ("nation", "n_name")),
    "collections_appended": (("nation", "n_nationkey", "n_name"), ("region", "r_name")),
    "persons_appended": (("supplier", "s_suppkey", "s_name"), ("customer", "c_name")),
    "faces_appended": (("orders", "o_orderkey", "o_orderpriority"), ("customer", "c_name")),
}


def _keyed(table, keys: dict[str, str], *more):
    return table.select(*(F.expr(e).alias(c) for c, e in keys.items()), *more)


def _insert(name: str, what: str, keys: dict[str, str]) -> None:
    columns = ", ".join(f"{e} AS {c}" for c, e in keys.items())

    def run(spark, d):
        t = load(spark, d, "lineitem")
        old = _keyed(t.where("l_partkey % 3 = 0"), keys, F.col("l_partkey").alias("value")).groupBy(*keys).agg(F.min("value").alias("value"))
        return old.unionByName(L.insert_new(old, _keyed(t.where("l_partkey % 3 <> 0"), keys, F.col("l_partkey").alias("value")), list(keys), ["value"]).select(*old.columns))

    run.__name__, run.__doc__ = name, f"Insert or ignore: {what}; what is there stays, of several new rows the first comes in."
    query(f"SELECT {columns}, coalesce(min(l_partkey) FILTER (l_partkey % 3 = 0), min(l_partkey)) AS value FROM lineitem GROUP BY {', '.join(str(k + 1) for k in range(len(keys)))}")(run)


def _upsert(name: str, what: str, keys: dict[str, str]) -> None:
    columns = ", ".join(f"{e} AS {c}" for c, e in keys.items())

    def run(spark, d):
        t, k = load(spark, d, "events"), F.col("event_id")
        old = _keyed(t.where("event_id % 3 = 0"), keys, k.alias("value")).groupBy(*keys).agg(F.min("value").alias("value")).withColumn("at", F.lit(-1).cast("long"))
        new = _keyed(t.where("event_id % 3 <> 0"), keys, k.alias("value"), k.alias("at"), F.lit("upsert").alias("op"))
        return L.merge_latest(old, new, list(keys), "at").select(*keys, "value")

    run.__name__, run.__doc__ = name, f"Insert or replace: {what}; of all rows of a key the latest stays."
    query(f"SELECT {columns}, coalesce(max(event_id) FILTER (event_id % 3 <> 0), min(event_id)) AS value FROM events GROUP BY {', '.join(str(k + 1) for k in range(len(keys)))}")(run)


def _append(name: str, have: tuple[str, str, str], come: tuple[str, str]) -> None:
    def run(spark, d):
        rows = load(spark, d, have[0]).select(F.col(have[1]).cast("long").alias("id"), F.col(have[2]).alias("name"))
        return R.appended(rows, load(spark, d, come[0]).select(F.col(come[1]).alias("name")), "name")

    run.__name__, run.__doc__ = name, "New rows with keys after the largest one there is."
    query(f"SELECT CAST({have[1]} AS BIGINT) AS id, {have[2]} AS name FROM {have[0]} UNION ALL SELECT (SELECT max({have[1]}) FROM {have[0]}) + row_number() OVER (ORDER BY {come[1]}), {come[1]} FROM {come[0]}")(run)


for _name, (_what, _keys) in INSERTS.items():
    _insert(_name, _what, _keys)
for _name, (_what, _keys) in UPSERTS.items():
    _upsert(_name, _what, _keys)
for _name, (_have, _come) in APPENDS.items():
    _append(_name, _have, _come)


@query(with_tables("face", "SELECT asset_id, n, part, price, row_number() OVER (PARTITION BY asset_id ORDER BY quality DESC NULLS LAST, n, part, price) AS place FROM face"))
def faces_in_order(spark, d):
    """Each asset's faces, the best first, those without quality last."""
    from pyspark.sql import Window

    w = Window.partitionBy("asset_id").orderBy(F.col("quality").desc_nulls_last(), "n", "part", "price")  # an asset has few faces
    return C.face(spark, d).select("asset_id", "n", "part", "price", F.row_number().over(w).alias("place"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_nationkey = 6 AND n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 6) AND n_nationkey % 5 = 1")
def collection_of_owner(spark, d):
    """A collection by id, owner and kind."""
    regions = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("owner_id"))
    owner = regions.where("id = 6").select(F.col("owner_id"))
    return R.one(C.collection(spark, d).join(regions, "id"), id=6, kind="smart_album").join(F.broadcast(owner), "owner_id", "left_semi").select("id", "name")


@query("SELECT doc_id, sha256('text-search' || source) AS search_key FROM documents")
def search_keys(spark, d):
    """Search keys derived from a master key under a context of their own."""
    return load(spark, d, "documents").select("doc_id", S.search_key(F.col("source")).alias("search_key"))


@query("SELECT doc_id, doc_id % 4 = 0 AND doc_id % 8 <> 0 AS motion FROM documents")
def motion_trailers(spark, d):
    """Whether a file's last 128 KiB hold the mark of a clip; marks before them don't count."""
    k = F.col("doc_id")
    tail = F.when(k % 8 == 0, F.concat(F.lit("MicroVideo"), F.repeat(F.lit("x"), 131_072))).when(k % 4 == 0, F.lit("..MotionPhoto..")).otherwise(F.lit("Motion Photo"))
    return load(spark, d, "documents").select("doc_id", I.has_motion_trailer(F.concat(F.coalesce("text", F.lit("")), tail).cast("binary")).alias("motion"))


@query("SELECT source AS tree, bool_or(doc_id % 7 = 0 AND lang = 'fr') AS phone FROM documents GROUP BY 1")
def phone_trees(spark, d):
    """Folder trees of a phone: one first-level folder named like its camera's is enough."""
    folder = F.when((F.col("doc_id") % 7 == 0) & (F.col("lang") == "fr"), F.concat((F.col("doc_id") % 900 + 100).cast("string"), F.lit("APPLE"))).otherwise(F.lit("APPLE"))
    files = load(spark, d, "documents").select(F.col("source").alias("tree"), F.concat(F.lit("/"), "source", F.lit("/"), folder, F.lit("/IMG.JPG")).alias("path"))
    return files.groupBy("tree").agg(F.bool_or(I.is_phone_folder(F.col("path"))).alias("phone"))


@query(
    """WITH b AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS part, l_quantity * 4 AS x, l_discount * 500 AS y, 20 + l_linenumber * 8.0::DOUBLE AS w, 30 + l_tax * 100 AS h FROM lineitem),
s AS (SELECT *, least(greatest(w, h) * 1.5, 240.0, 180.0) AS side FROM b)
SELECT id, n, part, round(least(greatest(x + w / 2 - side / 2, 0), 240 - side)) AS left_, round(least(greatest(y + h / 2 - side / 2, 0), 180 - side)) AS top, round(side) AS side FROM s"""
)
def face_crops(spark, d):
    """Padded squares around faces, inside a picture of 240 by 180."""
    x, y, w, h = F.col("l_quantity") * 4, F.col("l_discount") * 500, 20 + F.col("l_linenumber") * 8.0, 30 + F.col("l_tax") * 100
    crop = S.crop_square(x, y, w, h, F.lit(240.0), F.lit(180.0))
    t = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), crop.alias("c"))
    return t.select("id", "n", "part", F.col("c.x").alias("left_"), F.col("c.y").alias("top"), F.col("c.side").alias("side"))


@F.pandas_udf(BinaryType())
def _blobs(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes() + b"\x01\x02")


@query("SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings")
def vectors_decoded(spark, d):
    """Vectors out of blobs of little-endian floats; bytes left over are dropped."""
    v = codes.floats(_blobs(F.col("embedding")))
    got = load(spark, d, "embeddings").select("vec_id", v.alias("v"))
    return got.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'plain ' WHEN doc_id % 3 = 1 THEN 'more ' END || source AS title FROM documents WHERE doc_id % 5 <> 0")
def takeout_beside(spark, d):
    """Titles from an export's JSON files, the plain name before the longer one, for pictures without a sidecar of their own."""
    docs = load(spark, d, "documents")
    path = F.concat(F.lit("/t/"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    media = docs.select("doc_id", path.alias("path"))
    body = lambda t: F.to_json(F.struct(F.concat(F.lit(t), "source").alias("title")))
    plain = docs.where("doc_id % 3 = 0").select(F.concat(path, F.lit(".json")).alias("path"), body("plain ").alias("json"))
    longer = docs.where("doc_id % 3 < 2").select(F.concat(path, F.lit(".supplemental-metadata.json")).alias("path"), body("more ").alias("json"))
    sidecars = docs.where("doc_id % 5 = 0").select(I.sidecar_path(path).alias("path"))
    open_ = I.without_sidecars(media, sidecars)
    return I.with_takeout(open_, plain.unionByName(longer)).select("doc_id", I.takeout(F.col("json"))["title"].alias("title"))


__all__ = ["QUERIES"]

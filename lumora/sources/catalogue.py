"""Logical catalogue tables over the given tables, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.session import load


def source(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("owner_id"))


def asset(spark: SparkSession, d: str) -> DataFrame:
    o, k = load(spark, d, "orders"), F.col("o_orderkey")
    day = F.when(k % 97 != 0, F.unix_date(F.to_date("o_orderdate")))
    return o.select(
        k.alias("id"),
        F.col("o_custkey").alias("source_id"),
        day.cast("long").alias("day"),
        F.floor("o_totalprice").cast("long").alias("bytes"),
        (F.col("o_orderstatus") == "F").alias("is_video"),
        F.col("o_orderpriority").startswith("1-").alias("is_raw"),
        (k % 12 == 0).alias("is_screenshot"),
        (k % 25 == 0).alias("is_live"),
        (k % 19 == 0).alias("is_pet"),
        F.col("o_orderpriority").alias("device"),
        F.when(k % 11 != 0, F.concat(F.lit("Lens "), "o_orderstatus")).alias("lens"),
    )


def face(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("asset_id"),
        F.when(F.col("l_partkey") % 7 != 0, F.col("l_suppkey")).alias("person_id"),
        F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("quality"),
        F.col("l_linenumber").alias("n"),
        F.col("l_partkey").alias("part"),
        F.col("l_extendedprice").alias("price"),
    )


FACE_ORDER = ("asset_id", "n", "part", "price")


def person(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return load(spark, d, "supplier").select(
        k.alias("id"), F.col("s_nationkey").alias("owner_id"), F.col("s_name").alias("name"), (k % 10 == 0).alias("hidden")
    )


def collection(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    kind = F.when(k % 12 == 5, "hidden_vault").when(k % 5 == 1, "smart_album").when(k % 5 == 2, "trip").otherwise("album")
    return load(spark, d, "nation").select(k.cast("long").alias("id"), F.col("n_name").alias("name"), kind.alias("kind"))


def collection_member(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("collection_id"))
    return load(spark, d, "orders").join(c, "o_custkey").select("collection_id", F.col("o_orderkey").alias("asset_id"))


def asset_vec(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("asset_id"), F.col("embedding").alias("vec"), "label")


PLACES = 60


def geo(spark: SparkSession, d: str) -> DataFrame:
    """Each source has a home place on a ring of spots; a few rows lie in the open sea, a few have no position."""
    k, p = F.col("o_orderkey"), F.col("o_custkey") % PLACES
    shift = ((k % 7) - 3) * 0.01
    lat = F.when(k % 53 != 0, -35.0 + p * 1.5 + shift)
    lon = F.when(k % 53 != 0, -120.0 + p * 4.5 + shift)
    day = F.when(k % 97 != 0, F.unix_date(F.to_date("o_orderdate"))).cast("long")
    return load(spark, d, "orders").select(k.alias("asset_id"), F.col("o_custkey").alias("source_id"), lat.alias("lat"), lon.alias("lon"), day.alias("day"))


SQL = {
    "source": "source AS (SELECT c_custkey AS id, c_nationkey AS owner_id FROM customer)",
    "asset": """asset AS (SELECT o_orderkey AS id, o_custkey AS source_id,
  CASE WHEN o_orderkey % 97 <> 0 THEN date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) END AS day,
  CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_orderstatus = 'F' AS is_video, o_orderpriority LIKE '1-%' AS is_raw,
  o_orderkey % 12 = 0 AS is_screenshot, o_orderkey % 25 = 0 AS is_live, o_orderkey % 19 = 0 AS is_pet, o_orderpriority AS device,
  CASE WHEN o_orderkey % 11 <> 0 THEN 'Lens ' || o_orderstatus END AS lens FROM orders)""",
    "face": """face AS (SELECT l_orderkey AS asset_id, CASE WHEN l_partkey % 7 <> 0 THEN l_suppkey END AS person_id,
  CASE WHEN l_linenumber <> 3 THEN l_discount END AS quality, l_linenumber AS n, l_partkey AS part, l_extendedprice AS price FROM lineitem)""",
    "person": "person AS (SELECT s_suppkey AS id, s_nationkey AS owner_id, s_name AS name, s_suppkey % 10 = 0 AS hidden FROM supplier)",
    "collection": """collection AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CASE WHEN n_nationkey % 12 = 5 THEN 'hidden_vault'
  WHEN n_nationkey % 5 = 1 THEN 'smart_album' WHEN n_nationkey % 5 = 2 THEN 'trip' ELSE 'album' END AS kind FROM nation)""",
    "member": """member AS (SELECT CAST(c_nationkey AS BIGINT) AS collection_id, o_orderkey AS asset_id
  FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "hidden": """hidden AS (SELECT DISTINCT m.asset_id FROM member m JOIN collection c ON c.id = m.collection_id WHERE c.kind = 'hidden_vault')""",
    "vec": "vec AS (SELECT vec_id AS asset_id, embedding AS vec, label FROM embeddings)",
    "geo": f"""geo AS (SELECT o_orderkey AS asset_id, o_custkey AS source_id,
  CASE WHEN o_orderkey % 53 <> 0 THEN -35.0 + (o_custkey % {PLACES}) * 1.5::DOUBLE + ((o_orderkey % 7) - 3) * 0.01::DOUBLE END AS lat,
  CASE WHEN o_orderkey % 53 <> 0 THEN -120.0 + (o_custkey % {PLACES}) * 4.5::DOUBLE + ((o_orderkey % 7) - 3) * 0.01::DOUBLE END AS lon,
  CASE WHEN o_orderkey % 97 <> 0 THEN date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) END AS day FROM orders)""",
}


def with_tables(names: str, body: str) -> str:
    """SQL text: the named logical tables as common table expressions, then the body."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + body

"""Queries of shares, keys, codes, geometry and stored files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.functions import codes, tables
from lumora.functions import scalars as S
from lumora.operators import sharing
from lumora.plans.book import query
from lumora.session import load
from lumora.sources import catalogue as C
from lumora.sources.catalogue import with_tables


@query(
    with_tables(
        "collection member",
        """, a AS (SELECT id, name, id * 10 AS t FROM collection WHERE kind = 'album') SELECT id AS namespace, hex('c/meta') AS key, '{"name":"' || name || '"}' AS value, a.t AS ts FROM a
UNION ALL SELECT m.collection_id, hex('c/mem/') || lpad(hex(m.asset_id), 16, '0'), '{"asset_id":' || m.asset_id || '}', a.t FROM member m JOIN a ON a.id = m.collection_id""",
    ).replace("\n,", ",")
)
def share_publish(spark, d):
    albums = C.collection(spark, d).where("kind = 'album'").select("id", "name", (F.col("id") * 10).alias("at"))
    return sharing.published(albums, C.collection_member(spark, d))


@query("SELECT c_nationkey AS collection_id, 'u' || c_custkey % 50 AS peer_identity, coalesce(n, '') AS peer_node FROM customer LEFT JOIN (SELECT 'u' || s_suppkey % 40 AS p, min(s_name) AS n FROM supplier GROUP BY 1) ON p = 'u' || c_custkey % 50")
def album_share_recipients(spark, d):
    keys = load(spark, d, "customer").select(F.col("c_nationkey").alias("collection_id"), F.concat(F.lit("u"), (F.col("c_custkey") % 50).cast("string")).alias("peer_identity"))
    peers = load(spark, d, "supplier").select(F.concat(F.lit("u"), (F.col("s_suppkey") % 40).cast("string")).alias("peer_identity"), F.col("s_name").alias("peer_node"))
    return sharing.recipients(keys, peers)


@query(
    """WITH k AS (SELECT DISTINCT c_nationkey AS collection_id, c_mktsegment AS peer FROM customer), l AS (SELECT collection_id, peer, 'active' AS status FROM k
UNION ALL SELECT 3, 'BUILDING', 'revoked' UNION ALL SELECT collection_id, peer, 'rotated' FROM k WHERE collection_id = 3 AND peer <> 'BUILDING') SELECT status, count(*) AS n FROM l GROUP BY 1"""
)
def share_revocation(spark, d):
    keys = load(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("collection_id"), F.col("c_mktsegment").alias("peer_identity")).distinct()
    ledger = keys.select("*", F.lit("active").alias("status"), F.lit(1).cast("long").alias("changed_at"))
    return sharing.revoked(keys, ledger, 3, "BUILDING", 2)[1].groupBy("status").agg(F.count("*").alias("n"))


@query(
    with_tables(
        "asset member",
        """SELECT collection_id, count(*) AS n, '{"items":[' || string_agg('{"asset_id":' || asset_id || ',"bytes":' || bytes || '}', ',' ORDER BY asset_id) || ']}' AS manifest
FROM (SELECT m.collection_id, m.asset_id, a.bytes, row_number() OVER (PARTITION BY m.collection_id ORDER BY m.asset_id) AS r FROM member m JOIN asset a ON a.id = m.asset_id) WHERE r <= 20 AND bytes <= 200000 GROUP BY 1""",
    )
)
def link_bundles(spark, d):
    a = C.asset(spark, d).select(F.col("id").alias("asset_id"), "bytes")
    return sharing.bundle(C.collection_member(spark, d).join(a, "asset_id"), 20, 200_000)


@query("SELECT doc_id AS name, doc_id % 7 <> 0 AS present, doc_id % 7 <> 0 AND doc_id % 5 <> 0 AS valid FROM documents")
def file_survey(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("name"), F.sha2("text", 256).alias("hash"))
    actual = docs.where("name % 7 <> 0").select("name", F.when(F.col("name") % 5 == 0, "broken").otherwise(F.col("hash")).alias("hash"))
    return sharing.survey(docs, actual).select("name", "present", "valid")


@query(
    """SELECT path FROM (SELECT o_orderkey AS path, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS upto FROM orders)
WHERE upto > (SELECT sum(CAST(floor(o_totalprice) AS BIGINT)) // 2 FROM orders)"""
)
def cache_eviction(spark, d):
    files = load(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.floor("o_totalprice").cast("long").alias("bytes"), F.col("o_orderdate").alias("mtime"))
    half = files.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    return sharing.evicted(files, half // 2).select("path")


@query("SELECT o_orderkey AS id, hex('c/mem/') || lpad(hex(o_orderkey), 16, '0') AS key, o_orderkey AS back FROM orders")
def member_keys(spark, d):
    k = codes.member_key(F.col("o_orderkey"))
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.hex(k).alias("key"), codes.member_of(k).alias("back"))


@query("SELECT doc_id, lower(substr(md5(text), 1, 32)) AS back FROM documents")
def base32_round_trip(spark, d):
    raw = F.unhex(F.md5("text"))
    return load(spark, d, "documents").select("doc_id", F.lower(F.hex(codes.from_base32(codes.base32(raw)))).alias("back"))


@query("SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS k, 49406 + 49407 * (77 - 1 - least(len(ids), 75)) + coalesce(list_sum(ids[1:75]), 0) AS total FROM (SELECT *, range(l_quantity::BIGINT * 3) AS ids FROM lineitem)")
def padded_token_ids(spark, d):
    q = (F.col("l_quantity") * 3).cast("int")
    ids = F.when(q > 0, F.sequence(F.lit(0), q - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(codes.padded_ids(ids), F.lit(0).cast("long"), lambda s, x: s + x)
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"), total.alias("total"))


@query(with_tables("geo", "SELECT asset_id, round((lon + 180) / 360 * 1024, 6) AS x, round((90 - lat) / 180 * 512, 6) AS y FROM geo WHERE lat IS NOT NULL"))
def canvas_points(spark, d):
    at = codes.on_canvas(F.col("lat"), F.col("lon"), 1024, 512)
    return C.geo(spark, d).where("lat is not null").select("asset_id", F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y"))


@query()
def map_features(spark, d):
    """Map buckets as GeoJSON features."""
    from lumora.operators import analytics as A

    return A.map_grid(C.geo(spark, d), 4.0).select("gx", "gy", codes.feature(F.round("lon", 4), F.round("lat", 4), n=F.col("n")).alias("feature"))


@query()
def map_merged_markers(spark, d):
    """Markers of each source on a canvas after overlapping ones merged."""
    at = codes.on_canvas(F.col("lat"), F.col("lon"), 1024, 512)
    n = C.geo(spark, d).where("lat is not null").groupBy("source_id", F.round("lat", 1).alias("lat"), F.round("lon", 1).alias("lon")).agg(F.count("*").alias("n"))
    c = F.struct((-F.col("n")).alias("o"), at["x"].alias("x"), at["y"].alias("y"), (S.marker_size(F.col("n")) / 2).alias("r"), F.col("n").cast("double").alias("n"))
    per = n.groupBy("source_id").agg(F.array_sort(F.collect_list(c)).alias("c"), F.sum("n").alias("total"))
    plain = F.transform("c", lambda k: F.struct(k["x"].alias("x"), k["y"].alias("y"), k["r"].alias("r"), k["n"].alias("n")))
    return per.withColumn("m", codes.merged_circles(plain)).select("source_id", F.size("c").alias("n_before"), F.size("m").alias("n_after"), "total", F.aggregate("m", F.lit(0.0), lambda s, k: s + k["n"]).cast("long").alias("merged_total"))


@query("SELECT o_orderkey AS id, true AS same FROM orders")
def similarity_round_trip(spark, d):
    """A transform fitted to five moved points brings them there, and its inverse brings them back."""
    k = F.col("o_orderkey")
    src = F.array(*(F.struct((k % p).cast("double").alias("x"), (k % q).cast("double").alias("y")) for p, q in ((7, 11), (13, 5), (3, 17), (19, 23), (29, 2))))
    true = F.struct(((k % 9 + 1) / 5.0).alias("a"), ((k % 4) / 3.0).alias("b"), F.lit(12.5).alias("tx"), F.lit(-3.0).alias("ty"))
    rows = load(spark, d, "orders").select(k.alias("id"), src.alias("src"), true.alias("true"))
    rows = rows.withColumn("dst", F.transform("src", lambda p: codes.moved(F.col("true"), p["x"], p["y"])))
    rows = rows.withColumn("m", codes.fitted_similarity(F.col("src"), F.col("dst"))).withColumn("i", codes.inverted_similarity(F.col("m")))
    back = F.transform("dst", lambda p: codes.moved(F.col("i"), p["x"], p["y"]))
    off = F.aggregate(F.zip_with(back, "src", lambda a, b: F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"])), F.lit(0.0), lambda s, x: s + x)
    flat = F.size(F.array_distinct("src")) == 1
    return rows.select("id", (flat | (off < 1e-6)).alias("same"))


@query(
    """SELECT id, count(*) FILTER (s >= 50) AS n, coalesce(round(sum((i % 4 - 1) * 8) FILTER (s >= 50), 4), 0) AS x1 FROM (SELECT o_orderkey AS id, unnest(range(16)) AS i, (o_orderkey * (unnest(range(16)) + 1)) % 97 AS s FROM orders) GROUP BY 1"""
)
def grid_detections(spark, d):
    scores = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.col("o_orderkey") * (i + 1)) % 97)
    one = F.struct(F.lit(1.0).alias("l"), F.lit(1.0).alias("t"), F.lit(2.0).alias("r"), F.lit(2.0).alias("b"))
    boxes = codes.detections(scores, F.array_repeat(one, 16), 8, 4, 50)
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.size(boxes).alias("n"), F.aggregate(boxes, F.lit(0.0), lambda s, b: s + b["x1"]).alias("x1"))


@query(
    """WITH p AS (SELECT o_orderkey AS k, len(list_distinct([[o_orderkey % 7, o_orderkey % 11], [o_orderkey % 13, o_orderkey % 5], [o_orderkey % 3, o_orderkey % 17], [o_orderkey % 19, o_orderkey % 23], [o_orderkey % 29, o_orderkey % 2]])) AS n FROM orders)
SELECT k AS id, CASE WHEN n > 1 THEN round((k % 9 + 1) / 5.0, 6) END AS a, CASE WHEN n > 1 THEN round((k % 4) / 3.0, 6) END AS b, CASE WHEN n > 1 THEN 12.5::DOUBLE END AS tx, CASE WHEN n > 1 THEN -3.0::DOUBLE END AS ty FROM p"""
)
def similarity_fitted(spark, d):
    """The transform fitted to five moved points is the one that moved them; five equal points fix none."""
    k = F.col("o_orderkey")
    src = F.array(*(F.struct((k % p).cast("double").alias("x"), (k % q).cast("double").alias("y")) for p, q in ((7, 11), (13, 5), (3, 17), (19, 23), (29, 2))))
    true = F.struct(((k % 9 + 1) / 5.0).alias("a"), ((k % 4) / 3.0).alias("b"), F.lit(12.5).alias("tx"), F.lit(-3.0).alias("ty"))
    rows = load(spark, d, "orders").select(k.alias("id"), src.alias("src"), true.alias("true"))
    rows = rows.withColumn("dst", F.transform("src", lambda p: codes.moved(F.col("true"), p["x"], p["y"])))
    m = F.when(F.size(F.array_distinct("src")) > 1, codes.fitted_similarity(F.col("src"), F.col("dst")))
    return rows.withColumn("m", m).select("id", *(F.round(F.col(f"m.{c}"), 6).alias(c) for c in ("a", "b", "tx", "ty")))


@query(
    """SELECT o_orderkey AS id, CAST(i AS INT) AS anchor, CAST((o_orderkey * (i + 1)) % 97 AS DOUBLE) AS score, (i % 4 - (o_orderkey + 4 * i) % 5 / 2.0) * 8 AS x1, (i // 4 - (o_orderkey + 4 * i + 1) % 5 / 2.0) * 8 AS y1,
(i % 4 + (o_orderkey + 4 * i + 2) % 5 / 2.0) * 8 AS x2, (i // 4 + (o_orderkey + 4 * i + 3) % 5 / 2.0) * 8 AS y2 FROM orders, range(16) t(i) WHERE (o_orderkey * (i + 1)) % 97 >= 50"""
)
def detections_expanded(spark, d):
    """Detected boxes as rows, by a table function in SQL; all fields of each box."""
    tables.register(spark)
    grids = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: ((F.col("o_orderkey") * (i + 1)) % 97).cast("double")).alias("scores"),
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((F.col("o_orderkey") + i) % 5) / 2.0).alias("offsets"),
    )
    return spark.sql("SELECT g.id, b.* FROM {grids} g, LATERAL expand_detections(g.scores, g.offsets, 8, 4, 50.0D) b", grids=grids)


@query(
    """WITH g AS (SELECT o_orderkey AS id, i // 9 AS y, i % 9 AS x, CAST((o_orderkey * (i + 3) * 7919) % 251 AS DOUBLE) AS v FROM orders, range(72) t(i) WHERE o_orderkey <= 400)
SELECT c.id, round(var_pop(u.v + dn.v + l.v + r.v - 4 * c.v), 4) AS sharpness FROM g c JOIN g u ON u.id = c.id AND u.x = c.x AND u.y = c.y - 1 JOIN g dn ON dn.id = c.id AND dn.x = c.x AND dn.y = c.y + 1
JOIN g l ON l.id = c.id AND l.x = c.x - 1 AND l.y = c.y JOIN g r ON r.id = c.id AND r.x = c.x + 1 AND r.y = c.y GROUP BY 1""".replace(" WHERE o_orderkey <= 400", "")
)
def sharpness(spark, d):
    gray = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: ((F.col("o_orderkey") * (i + 3) * 7919) % 251).cast("double"))
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(codes.sharpness(gray, F.lit(9)), 4).alias("sharpness"))

"""Queries of point reads, writes as transforms, background work and records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumora.operators import library as L
from lumora.operators import records as R
from lumora.plans.book import query
from lumora.session import load, settle, shared_dir
from lumora.sources import catalogue as C
from lumora.sources.catalogue import with_tables
from lumora.sources.versions import current

FEED = "ORDER BY coalesce(day, 0) DESC, id DESC"
LINK = """link AS (SELECT event_id AS id, user_id % 25 AS owner_id, substr(sha256('pub' || event_id), 1, 16) AS pub_id, user_id AS collection_id, CAST(floor(epoch(ts)) AS BIGINT) AS created FROM events)"""
PEER = "peer AS (SELECT s_suppkey AS id, s_nationkey AS owner_id, 'peer' || s_suppkey AS identity, s_suppkey * 37 % 1000 AS added FROM supplier)"
USERS = "users AS (SELECT n_nationkey AS id, n_name AS name FROM nation)"
SPEC = """smart AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CASE n_nationkey % 3 WHEN 1 THEN '{"is_raw": true, "device": "urgent"}' WHEN 2 THEN '{broken' END AS spec FROM nation WHERE n_nationkey % 5 = 1 AND n_nationkey % 12 <> 5),
snap AS (SELECT collection_id, asset_id, 20000 + asset_id % 3 AS snapshot_at FROM member WHERE collection_id % 5 = 1 AND collection_id <> 16)"""


def _links(spark, d):
    k = F.col("event_id")
    pub = F.substring(F.sha2(F.concat(F.lit("pub"), k.cast("string")), 256), 1, 16)
    created = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return load(spark, d, "events").select(k.alias("id"), (F.col("user_id") % 25).alias("owner_id"), pub.alias("pub_id"), F.col("user_id").alias("collection_id"), created.alias("created"))


def _peers(spark, d):
    k = F.col("s_suppkey")
    return load(spark, d, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("owner_id"), F.concat(F.lit("peer"), k.cast("string")).alias("identity"), (k * 37 % 1000).alias("added"))


def _users(spark, d):
    return load(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


def _smart(spark, d):
    k = F.col("id") % 3
    spec = F.when(k == 1, R.rule_json(is_raw=True, device="urgent")).when(k == 2, "{broken")
    return C.collection(spark, d).withColumn("spec", spec)


def _snapshot(spark, d):
    return C.collection_member(spark, d).where("collection_id % 5 = 1 and collection_id <> 16").withColumn("snapshot_at", 20000 + F.col("asset_id") % 3)


# reads --------------------------------------------------------------------------------------------------------------


@query(with_tables("asset", "SELECT id, source_id, day, bytes, is_video, is_raw, is_live, device, lens FROM asset WHERE id = 7"))
def asset_by_id(spark, d):
    return R.one(C.asset(spark, d), id=7).select("id", "source_id", "day", "bytes", "is_video", "is_raw", "is_live", "device", "lens")


@query(
    with_tables(
        "asset geo",
        "SELECT a.id, true AS unlocked, a.device, g.lat, g.lon FROM asset a JOIN geo g ON g.asset_id = a.id WHERE a.id = 7 UNION ALL SELECT id, false, NULL, NULL, NULL FROM asset WHERE id = 7",
    )
)
def asset_details(spark, d):
    """One asset's details, unlocked and locked."""
    g = C.geo(spark, d).select(F.col("asset_id").alias("id"), F.to_json(F.struct("lat", "lon")).alias("gps"))
    a = C.asset(spark, d).join(g, "id")
    views = [R.asset_detail(a, 7, unlocked).select("id", F.lit(unlocked).alias("unlocked"), "device", "lat", "lon") for unlocked in (True, False)]
    return views[0].unionByName(views[1])


@query(with_tables("asset source geo", "SELECT a.id, a.day, g.lat, g.lon FROM asset a JOIN geo g ON g.asset_id = a.id WHERE g.lat IS NOT NULL AND a.source_id IN (SELECT id FROM source WHERE owner_id = 7)"))
def owner_geo_assets(spark, d):
    g = C.geo(spark, d).where("lat is not null").select(F.col("asset_id").alias("id"), "lat", "lon")
    return L.owned(C.asset(spark, d), C.source(spark, d), 7).join(g, "id").select("id", "day", "lat", "lon")


@query(f"WITH {PEER} SELECT id, identity FROM peer WHERE owner_id = 3")
def peer_accepts(spark, d):
    return R.one(_peers(spark, d), owner_id=3).orderBy(F.col("added").desc(), "id").select("id", "identity")


@query(f"WITH {LINK} SELECT id, pub_id, created FROM link WHERE owner_id = 7")
def public_links_of_owner(spark, d):
    return R.one(_links(spark, d), owner_id=7).orderBy(F.col("created").desc(), F.col("id").desc()).select("id", "pub_id", "created")


@query(f"WITH {LINK} SELECT id, owner_id, collection_id FROM link WHERE pub_id = substr(sha256('pub7'), 1, 16)")
def public_link_by_pub_id(spark, d):
    import hashlib

    return R.one(_links(spark, d), pub_id=hashlib.sha256(b"pub7").hexdigest()[:16]).select("id", "owner_id", "collection_id")


@query(f"WITH {USERS} SELECT id, name FROM users WHERE id <> 3")
def local_peers(spark, d):
    return _users(spark, d).where("id <> 3").select("id", "name")


@query(f"WITH {USERS} SELECT (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FROM users) AS ids, (SELECT count(*) > 0 FROM users) AS some, (SELECT count(*) > 0 FROM users WHERE id = 99) AS has_99")
def user_ids(spark, d):
    """All ids in order, and whether users, and user 99, exist."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",")
    return _users(spark, d).agg(ids.alias("ids"), (F.count("*") > 0).alias("some"), (F.count_if(F.col("id") == 99) > 0).alias("has_99"))


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE sha256(text) = (SELECT sha256(text) FROM documents WHERE doc_id = 11)")
def asset_of_stored_key(spark, d):
    """The asset of a stored key: looked up from the key, which a row's text gives here."""
    docs = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return docs.join(F.broadcast(docs.where("doc_id = 11").select("key").limit(1)), "key", "left_semi").agg(F.min("doc_id").alias("doc_id"))


@query(with_tables("face", "SELECT asset_id, n, part, price, quality FROM face WHERE person_id = 3"))
def faces_of_person(spark, d):
    """A person's faces, best first, those without quality last."""
    f = R.one(C.face(spark, d), person_id=3)
    return f.orderBy(F.col("quality").desc_nulls_last(), *C.FACE_ORDER).select("asset_id", "n", "part", "price", "quality")


@query(with_tables("collection", "SELECT id, name FROM collection WHERE kind = 'smart_album' AND id % 3 <> 0"))
def smart_album_specs(spark, d):
    return _smart(spark, d).where("kind = 'smart_album' and spec is not null").orderBy(F.col("id").desc()).select("id", "name")


@query(with_tables("member", "SELECT s.id, s.name, true AS is_raw, 'urgent' AS device, count(p.asset_id) AS n, max(p.snapshot_at) AS snapshot_at FROM smart s LEFT JOIN snap p ON p.collection_id = s.id WHERE s.spec IS NOT NULL AND s.spec <> '{broken' GROUP BY 1, 2").replace("\nSELECT s.id", f",\n{SPEC}\nSELECT s.id"))
def smart_album_list(spark, d):
    """Smart albums with their rule, members and last refresh; one was never refreshed, and those without a readable spec are left out."""
    out = R.smart_albums(_smart(spark, d), _snapshot(spark, d))
    return out.select("id", "name", "rule.is_raw", "rule.device", "n", "snapshot_at")


@query("SELECT doc_id, quality AS species, round(toxic * 0.5 + quality * 0.3, 2) AS confidence, quality = 1 AND toxic * 0.5 + quality * 0.3 >= 0.6 AS pet FROM labels")
def pet_decisions(spark, d):
    conf = F.round(F.col("toxic") * 0.5 + F.col("quality") * 0.3, 2)
    x = load(spark, d, "labels").select("doc_id", F.col("quality").alias("species"), conf.alias("confidence"))
    return x.withColumn("pet", R.pet(F.when(F.col("species") == 1, "cat"), F.col("confidence")))


@query(with_tables("face person", "SELECT p.id, p.name, count(*) AS n FROM person p JOIN face f ON f.person_id = p.id WHERE NOT p.hidden GROUP BY 1, 2 ORDER BY n DESC, id LIMIT 8"))
def featured_people(spark, d):
    return L.people(C.person(spark, d), C.face(spark, d), C.FACE_ORDER).orderBy(F.col("n_faces").desc(), "id").limit(8).select("id", "name", F.col("n_faces").alias("n"))


# writes -------------------------------------------------------------------------------------------------------------


@query(with_tables("collection member", "SELECT id, name, kind, (SELECT count(*) FROM member m WHERE m.collection_id = c.id) AS n FROM collection c WHERE kind <> 'trip'"))
def trips_deleted(spark, d):
    """All trips go, and their members with them."""
    c, m = C.collection(spark, d), C.collection_member(spark, d)
    c, m = R.without_collections(c, m, c.where("kind = 'trip'"))
    return L.counted(c, m).select("id", "name", "kind", "n")


@query(with_tables("collection member", "SELECT (SELECT count(*) FROM collection WHERE id <> 11) AS n_collections, (SELECT count(*) FROM member WHERE collection_id % 5 = 1 AND collection_id NOT IN (11, 16)) AS n_snapshot"))
def smart_album_deleted(spark, d):
    c, m = R.without_collections(C.collection(spark, d), _snapshot(spark, d), C.collection(spark, d).where("id = 11 and kind = 'smart_album'"))
    return c.agg(F.count("*").alias("n_collections")).join(F.broadcast(m.agg(F.count("*").alias("n_snapshot"))))


@query(f"WITH {LINK} SELECT id, owner_id, pub_id FROM link WHERE NOT (owner_id = 7 AND id % 2 = 0)")
def public_links_deleted(spark, d):
    """Deletion names every second link; only those of owner 7 go."""
    links = _links(spark, d)
    return R.without(links, links.where("id % 2 = 0"), ["id"], owner=7).select("id", "owner_id", "pub_id")


@query(f"WITH {PEER} SELECT id, owner_id, identity FROM peer WHERE NOT (owner_id = 3 AND id % 3 = 0)")
def peer_accepts_deleted(spark, d):
    peers = _peers(spark, d)
    return R.without(peers, peers.where("id % 3 = 0"), ["id"], owner=3).select("id", "owner_id", "identity")


@query("SELECT doc_id, source AS cluster FROM documents WHERE source <> 'src3'")
def near_dup_cluster_deleted(spark, d):
    rows = load(spark, d, "documents").select("doc_id", F.col("source").alias("cluster"))
    return R.without(rows, spark.createDataFrame([("src3",)], "cluster string"), ["cluster"]).select("doc_id", "cluster")


@query("SELECT source AS cluster, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1")
def near_dup_clusters_replaced(spark, d):
    """Clusters are written over an older set at the same place."""
    path = f"{shared_dir(spark)}/lumora-clusters-{uuid.uuid4().hex}"
    docs = load(spark, d, "documents").groupBy(F.col("source").alias("cluster")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    R.replaced(docs.where("cluster like '%1%'"), path)
    return R.replaced(docs, path)


@query("SELECT source AS cluster, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1")
def near_dup_clusters_versions(spark, d):
    """A set of clusters while a newer one is being written: who reads in between has the older one whole, then the newer one."""
    path = f"{shared_dir(spark)}/lumora-clusters-{uuid.uuid4().hex}"
    docs = load(spark, d, "documents").groupBy(F.col("source").alias("cluster")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    for part in ("cluster like '%1%'", "cluster like '%2%'", "true"):
        R.replaced(docs.where(part), path)
    return current(spark, path)


@query(with_tables("face", "SELECT person_id, count(*) AS n FROM (SELECT CASE WHEN asset_id % 10 = 0 AND person_id = 3 THEN 100000 ELSE person_id END AS person_id FROM face) GROUP BY 1"))
def person_split(spark, d):
    """Every tenth asset's faces of person 3 become a new person."""
    f = C.face(spark, d).withColumn("face_id", F.concat_ws("/", "asset_id", "n", "part", "price"))
    ids = f.where("asset_id % 10 = 0 and person_id = 3").select("face_id")
    return R.split_person(f, ids, 100_000).groupBy("person_id").agg(F.count("*").alias("n"))


@query(with_tables("person", "SELECT id, CASE WHEN id % 4 = 0 THEN 'Named ' || id ELSE name END AS name, CASE WHEN id % 6 = 0 THEN true ELSE hidden END AS hidden FROM person"))
def persons_renamed_and_hidden(spark, d):
    p = C.person(spark, d)
    named = R.updated(p, p.where("id % 4 = 0").select("id", F.concat(F.lit("Named "), F.col("id").cast("string")).alias("name")), "id")
    return R.updated(named, p.where("id % 6 = 0").select("id", F.lit(True).alias("hidden")), "id").select("id", "name", "hidden")


@query(with_tables("asset", "SELECT id, CASE WHEN id % 5 = 0 THEN true WHEN id % 5 = 1 THEN false ELSE is_pet END AS is_pet, CASE WHEN id % 5 = 0 THEN 'dog' WHEN id % 5 = 1 THEN NULL WHEN is_pet THEN 'cat' END AS species FROM asset"))
def pets_set_and_cleared(spark, d):
    a = C.asset(spark, d).select("id", "is_pet", F.when(F.col("is_pet"), "cat").alias("species"))
    dogs = a.where("id % 5 = 0").select("id", F.lit(True).alias("is_pet"), F.lit("dog").alias("species"))
    none = a.where("id % 5 = 1").select("id", F.lit(False).alias("is_pet"), F.lit(None).cast("string").alias("species"))
    return R.updated(a, dogs.unionByName(none), "id")


@query(with_tables("collection", "SELECT id, kind, CASE WHEN kind = 'smart_album' THEN 'new' WHEN id % 3 = 1 THEN '{\"is_raw\": true, \"device\": \"urgent\"}' WHEN id % 3 = 2 THEN '{broken' END AS spec FROM collection"))
def smart_album_spec_set(spark, d):
    """A new spec is offered to every collection; only smart albums take it."""
    c = _smart(spark, d)
    return R.updated(c, c.select("id", F.lit("new").alias("spec")), "id", guard=F.col("kind") == "smart_album").select("id", "kind", "spec")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN sha256(text) END AS stored_key FROM documents")
def stored_keys_set(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("stored_key"))
    found = docs.where("id % 2 = 0").select("id", F.sha2("text", 256).alias("stored_key"))
    return R.updated(docs, found, "id").select("id", "stored_key")


@query(
    f"""WITH {USERS}, {PEER}, top AS (SELECT max(id) AS t FROM users) SELECT id, name FROM users UNION ALL SELECT t + row_number() OVER (ORDER BY identity), identity FROM peer, top WHERE owner_id = 5"""
)
def users_appended(spark, d):
    """New rows go on from the largest key; so do persons, sources, collections, faces and links."""
    new = R.one(_peers(spark, d), owner_id=5).select(F.col("identity").alias("name"))
    return R.appended(_users(spark, d), new, "name")


@query(with_tables("source", "SELECT id, owner_id, CAST(NULL AS VARCHAR) AS name FROM source UNION ALL SELECT max(id) + 1, 7, '__incoming_shares__' FROM source"))
def incoming_source_once(spark, d):
    """The source for received shares: asked for twice, added once."""
    s = C.source(spark, d).withColumn("name", F.lit(None).cast("string"))
    return R.incoming_source(settle(R.incoming_source(s, 7)), 7)


# background work ----------------------------------------------------------------------------------------------------


@query(
    with_tables(
        "asset vec face",
        """, e AS (SELECT id FROM asset WHERE id NOT IN (SELECT asset_id FROM vec)), f AS (SELECT id FROM asset WHERE NOT is_video AND id NOT IN (SELECT asset_id FROM face WHERE quality > 0.05))
SELECT (SELECT count(*) FROM e WHERE id % 3 <> 0) AS embed_queued, (SELECT count(*) FROM f) AS detect_queued, (SELECT count(*) FROM (FROM e UNION FROM f)) AS assets_touched""",
    ).replace("\n, e AS", ",\ne AS")
)
def reindex_report(spark, d):
    """Work that assets without vectors or faces still need; a third of the first kind is queued already."""
    a = C.asset(spark, d)
    vectors = a.join(C.asset_vec(spark, d).select(F.col("asset_id").alias("id")), "id", "left_anti").select("id")
    good = C.face(spark, d).where("quality > 0.05").select(F.col("asset_id").alias("id"))
    faces = a.where("not is_video").join(good, "id", "left_anti").select("id")
    jobs = a.where("id % 3 = 0").select(F.lit("embed_asset").alias("kind"), F.col("id").alias("asset_id"))
    return R.reindex(vectors, faces, jobs)[1]


@query(with_tables("asset", "SELECT unnest(['embed_asset', 'detect_faces']) AS kind, id AS asset_id FROM asset WHERE is_raw"))
def jobs_after_ingest(spark, d):
    return R.jobs_after_ingest(C.asset(spark, d).where("is_raw"))


JOB_SQL = "['embed_asset', 'detect_faces', 'phash', 'rebuild_person_clusters', 'rebuild_near_dup', 'ocr', 'classify_pet', 'other'][1 + event_id % 8]"


@query(
    f"""SELECT event_id AS id, kind, CASE WHEN NOT running THEN 'pending' WHEN kind IN ('phash', 'rebuild_near_dup') THEN 'done' ELSE 'failed' END AS state,
CASE WHEN running THEN CASE WHEN kind = 'other' THEN 'unknown kind' WHEN kind NOT IN ('phash', 'rebuild_near_dup') THEN 'models unavailable' END END AS error
FROM (SELECT event_id, {JOB_SQL} AS kind, event_type = 'view' AS running FROM events)"""
)
def jobs_drained(spark, d):
    """A worker without models: kinds that need one fail, the others are done."""
    kind = F.get(F.array(*map(F.lit, [*R.KINDS, "other"])), (F.col("event_id") % 8).cast("int"))
    state = F.when(F.col("event_type") == "view", "running").otherwise("pending")
    return R.drained(load(spark, d, "events").select(F.col("event_id").alias("id"), kind.alias("kind"), state.alias("state")), models=False).select("id", "kind", "state", "error")


# records and small functions ----------------------------------------------------------------------------------------


@query(with_tables("collection", "SELECT id, '{\"kind\":\"' || kind || '\",\"name\":\"' || name || '\",\"cover_key\":' || CASE WHEN id % 2 = 0 THEN 'null' ELSE '\"k' || id || '\"' END || '}' AS record FROM collection"))
def collection_records(spark, d):
    cover = F.when(F.col("id") % 2 == 1, F.concat(F.lit("k"), F.col("id").cast("string")))
    return C.collection(spark, d).select("id", R.as_record(R.COLLECTION_META, {"kind": F.col("kind"), "name": F.col("name"), "cover_key": cover}).alias("record"))


@query(with_tables("asset", "SELECT id, bytes, is_video, is_raw, lens, 21 AS n_fields FROM asset"))
def member_records(spark, d):
    """Member entries as JSON of 21 fields, read back."""
    a = C.asset(spark, d)
    have = {"cas_ref": F.col("id").cast("string"), "bytes": F.col("bytes"), "taken_at_utc_day": F.col("day"), **{c: F.col(c) for c in ("is_video", "is_raw", "is_screenshot", "is_live", "device", "lens")}}
    read = a.select("id", R.as_record(R.MEMBER_ENTRY, have).alias("json")).withColumn("r", F.from_json("json", R.MEMBER_ENTRY))
    return read.select("id", "r.bytes", "r.is_video", "r.is_raw", "r.lens", F.size(F.json_object_keys("json")).alias("n_fields"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS safe FROM pages")
def html_escaped(spark, d):
    return load(spark, d, "pages").select("page_id", R.html_escaped(F.col("html")).alias("safe"))


@query("SELECT conv_id, turn, '[{\"text\":\"' || role || '\",\"score\":0.5}]' AS lines FROM conversations")
def text_lines(spark, d):
    line = F.struct(F.col("role").alias("text"), F.lit(0.5).alias("score"))
    return load(spark, d, "conversations").select("conv_id", "turn", R.text_lines_json(F.array(line)).alias("lines"))


@query(
    """SELECT id, line, round((x1 - px) / s, 4) AS x, round((y1 - py) / s, 4) AS y, round(greatest(w / s, 0), 4) AS w, round(greatest(h / s, 0), 4) AS h FROM (
SELECT l_orderkey AS id, l_linenumber AS line, l_suppkey % 300 + 0.0::DOUBLE AS x1, l_partkey % 300 + 0.0::DOUBLE AS y1, l_quantity::DOUBLE - 10 AS w, l_quantity::DOUBLE AS h, 0.5::DOUBLE AS s, 8.0::DOUBLE AS px, 4.0::DOUBLE AS py FROM lineitem)"""
)
def unletterbox(spark, d):
    x1, y1 = (F.col("l_suppkey") % 300).cast("double"), (F.col("l_partkey") % 300).cast("double")
    box = F.struct(x1.alias("x1"), y1.alias("y1"), (x1 + F.col("l_quantity").cast("double") - 10).alias("x2"), (y1 + F.col("l_quantity").cast("double")).alias("y2"))
    b = R.unletterboxed(box, F.lit(0.5), F.lit(8.0), F.lit(4.0))
    x = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), b.alias("b"))
    return x.select("id", "line", *(F.round(f"b.{c}", 4).alias(c) for c in "xywh"))


@query(with_tables("asset", "SELECT id, day * 86400 AS instant, least(greatest(id / 10.0::DOUBLE, 1), 128) AS zoom FROM asset WHERE day IS NOT NULL"))
def days_and_zoom(spark, d):
    a = C.asset(spark, d).where("day is not null")
    return a.select("id", F.unix_timestamp(R.day_instant(F.col("day"))).alias("instant"), R.zoom(F.col("id") / 10.0).alias("zoom"))


@query(
    with_tables(
        "geo",
        """SELECT source_id, '{"type":"FeatureCollection","features":[' || string_agg('{"id":' || asset_id || ',"day":' || day || '}', ',' ORDER BY asset_id) || ']}' AS geojson
FROM geo WHERE lat IS NOT NULL AND day IS NOT NULL GROUP BY 1""",
    )
)
def feature_collections(spark, d):
    g = C.geo(spark, d).where("lat is not null and day is not null")
    f = F.to_json(F.struct(F.col("asset_id").alias("id"), "day"))
    return R.feature_collection(g.select("source_id", "asset_id", f.alias("feature")), "asset_id", "source_id")


@query("SELECT doc_id || '.jpg' AS file, source || ', ' || lang AS label FROM documents WHERE doc_id % 10 <> 0")
def label_lines(spark, d):
    """Lines `file,label` with comments among them, written and read back."""
    docs = load(spark, d, "documents")
    line = F.concat(F.col("doc_id").cast("string"), F.lit(".jpg, "), "source", F.lit(", "), "lang")
    path = f"{shared_dir(spark)}/lumora-labels-{uuid.uuid4().hex}"
    docs.select(F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("#"), line)).otherwise(line).alias("value")).write.text(path)
    return R.labels(spark, path)


@query(with_tables("geo", "SELECT count(*) AS n_assets FROM geo WHERE lat IS NOT NULL"))
def place_asset_count(spark, d):
    """Assets over all places of the map, each counted where it lies."""
    on = C.geo(spark, d).where("lat is not null")
    return on.groupBy(F.floor("lat").alias("gy"), F.floor("lon").alias("gx")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_assets"))

"""Queries over the catalogue: paging, search, saved rules, albums, people, upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumora.operators import library as L
from lumora.plans.book import ORACLES, QUERIES, query
from lumora.session import load, shared_dir
from lumora.sources import catalogue as C
from lumora.sources.catalogue import with_tables
from lumora.sources.versions import current, publish

FEED = "ORDER BY coalesce(day, 0) DESC, id DESC"


def _hidden(spark, d):
    return L.hidden_assets(C.collection_member(spark, d), C.collection(spark, d))


def _visible(spark, d):
    return L.visible(C.asset(spark, d), _hidden(spark, d))


NOT_HIDDEN = "id NOT IN (SELECT asset_id FROM hidden)"


@query(with_tables("asset collection member hidden", f"SELECT id, day, is_video, is_live, is_raw FROM asset WHERE {NOT_HIDDEN} {FEED} LIMIT 120"))
def timeline_page(spark, d):
    return L.page(_visible(spark, d)).select("id", "day", "is_video", "is_live", "is_raw")


@query(
    with_tables(
        "asset collection member hidden",
        f"SELECT id, day, is_video FROM asset WHERE {NOT_HIDDEN} AND (coalesce(day, 0) < 10000 OR (coalesce(day, 0) = 10000 AND id < 5000)) {FEED} LIMIT 500",
    )
)
def timeline_page_next(spark, d):
    return L.page(_visible(spark, d), (10000, 5000), 900).select("id", "day", "is_video")


@query(
    with_tables(
        "asset member",
        f"SELECT id, day FROM asset JOIN member ON asset_id = id WHERE collection_id = 3 AND coalesce(day, 0) < 11000 {FEED} LIMIT 120",
    )
)
def album_page(spark, d):
    own = C.collection_member(spark, d).where("collection_id = 3").select(F.col("asset_id").alias("id"))
    return L.page(C.asset(spark, d).join(own, "id"), (11000, 0)).select("id", "day")


@query(
    with_tables(
        "asset member",
        f"""SELECT * FROM (SELECT 4 AS album, asset.id, day FROM asset JOIN member ON asset_id = asset.id WHERE collection_id = 4 AND 1 = 0 {FEED.replace(" id ", " asset.id ")} LIMIT 120)
UNION ALL SELECT * FROM (SELECT 8 AS album, asset.id, day FROM asset JOIN member ON asset_id = asset.id WHERE collection_id = 8 {FEED.replace(" id ", " asset.id ")} LIMIT 120)""",
    )
)
def album_page_locked(spark, d):
    """Two albums with a password, of which one is unlocked: the other shows an empty page, not an error."""
    albums = C.collection(spark, d).where("id in (4, 8)").select(F.col("id").alias("album"), F.lit(True).alias("has_password"))
    out = None
    for album in (4, 8):
        page = L.album_page(C.asset(spark, d), C.collection_member(spark, d), albums, album, unlocked={8}).select(F.lit(album).alias("album"), "id", "day")
        out = page if out is None else out.unionByName(page)
    return out


@query(with_tables("asset collection member hidden", f"SELECT count(*) AS n FROM asset WHERE {NOT_HIDDEN}"))
def hidden_exclusion(spark, d):
    return _visible(spark, d).agg(F.count("*").alias("n"))


@query(
    with_tables(
        "asset collection member hidden",
        f"SELECT id, day, bytes FROM asset WHERE {NOT_HIDDEN} AND day >= 9500 AND day <= 10500 AND is_raw AND NOT is_screenshot {FEED} LIMIT 50",
    )
)
def search_flags(spark, d):
    want = L.Filter(day_from=9500, day_to=10500, is_raw=True, is_screenshot=False)
    return L.search(C.asset(spark, d), want, hidden=_hidden(spark, d)).select("id", "day", "bytes")


@query(
    with_tables(
        "asset collection member hidden face",
        f"SELECT id, day, is_raw FROM asset WHERE {NOT_HIDDEN} AND is_video AND id IN (SELECT asset_id FROM face) {FEED} LIMIT 50",
    )
)
def search_faces(spark, d):
    want = L.Filter(is_video=True, has_faces=True)
    return L.search(C.asset(spark, d), want, C.face(spark, d), _hidden(spark, d)).select("id", "day", "is_raw")


@query(with_tables("asset face", f"SELECT id, day FROM asset WHERE id NOT IN (SELECT asset_id FROM face) {FEED} LIMIT 500"))
def search_without_faces(spark, d):
    return L.search(C.asset(spark, d), L.Filter(has_faces=False), C.face(spark, d), limit=900).select("id", "day")


@query(with_tables("asset face", f"SELECT id, day FROM asset WHERE id IN (SELECT asset_id FROM face WHERE person_id IN (1, 2, 3)) {FEED} LIMIT 100"))
def search_person_any(spark, d):
    return L.search(C.asset(spark, d), L.Filter(persons=(1, 2, 3)), C.face(spark, d), limit=100).select("id", "day")


@query(
    with_tables(
        "asset face",
        f"""SELECT id, day FROM (SELECT * FROM asset WHERE is_video {FEED} LIMIT 400)
WHERE id IN (SELECT asset_id FROM face WHERE person_id IN (1, 2)) {FEED} LIMIT 100""",
    )
)
def search_newest_candidates(spark, d):
    """The client's latency bound: only the 400 newest rows reach the people step."""
    return L.search(C.asset(spark, d), L.Filter(is_video=True, persons=(1, 2)), C.face(spark, d), limit=100, candidate_cap=400).select("id", "day")


@query(
    with_tables(
        "asset",
        f"SELECT id, device, lens FROM asset WHERE lower(device) LIKE '%urgent%' AND lens IS NOT NULL AND lower(lens) LIKE '%lens o%' {FEED} LIMIT 80",
    )
)
def search_camera_contains(spark, d):
    return L.search(C.asset(spark, d), L.Filter(device="URGENT", lens="lens O"), limit=80).select("id", "device", "lens")


@query(with_tables("asset", f"SELECT id, day FROM asset WHERE day <= 9300 {FEED} LIMIT 60"))
def search_half_open_range(spark, d):
    return L.search(C.asset(spark, d), L.compile_rule({"date_to": "1995-06-19"}), limit=60).select("id", "day")


RULE = {"is_raw": True, "device": "urgent", "date_from": "1996-01-01"}


@query(with_tables("asset", "SELECT CAST(1 AS BIGINT) AS collection_id, id AS asset_id, CAST(20000 AS BIGINT) AS snapshot_at FROM asset WHERE is_raw AND lower(device) LIKE '%urgent%' AND day >= 9496"))
def smart_album_snapshot(spark, d):
    return L.snapshot(1, L.filtered(C.asset(spark, d), L.compile_rule(RULE)), 20000)


@query(with_tables("asset", "SELECT CAST(1 AS BIGINT) AS collection_id, id AS asset_id, CAST(20001 AS BIGINT) AS snapshot_at FROM asset WHERE is_raw AND lower(device) LIKE '%urgent%' AND day >= 9496"))
def smart_album_refreshed(spark, d):
    """The stored members of a saved rule after a refresh took the place of those of a wider rule."""
    path = f"{shared_dir(spark)}/lumora-snapshot-{uuid.uuid4().hex}"
    for at, rule in ((20000, {"is_raw": True}), (20001, RULE)):
        publish(L.snapshot(1, L.filtered(C.asset(spark, d), L.compile_rule(rule)), at), path)
    return current(spark, path)


@query(with_tables("asset", f"SELECT id, day FROM asset WHERE is_raw AND lower(device) LIKE '%urgent%' AND day >= 9496 {FEED} LIMIT 120"))
def smart_album_page(spark, d):
    members = smart_album_snapshot(spark, d).select(F.col("asset_id").alias("id"))
    return L.page(C.asset(spark, d).join(members, "id", "left_semi")).select("id", "day")


@query(with_tables("asset source", "SELECT count(*) AS n, sum(bytes) AS bytes FROM asset WHERE source_id IN (SELECT id FROM source WHERE owner_id = 7)"))
def owner_totals(spark, d):
    return L.owned(C.asset(spark, d), C.source(spark, d), 7).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query(with_tables("asset source", "SELECT source_id, count(*) AS n, sum(bytes) AS bytes FROM asset GROUP BY 1"))
def source_stats(spark, d):
    return C.asset(spark, d).groupBy("source_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query(with_tables("asset source", f"SELECT id, day FROM asset WHERE is_pet AND source_id IN (SELECT id FROM source WHERE owner_id = 7) {FEED}"))
def pets_list(spark, d):
    return L.owned(C.asset(spark, d), C.source(spark, d), 7).where("is_pet").select("id", "day").orderBy(*L.newest_first())


@query(with_tables("collection member", "SELECT c.id, c.kind, count(m.asset_id) AS n FROM collection c LEFT JOIN member m ON m.collection_id = c.id WHERE c.kind IN ('album', 'hidden_vault') GROUP BY 1, 2"))
def album_counts(spark, d):
    return L.counted(C.collection(spark, d).where(F.col("kind").isin("album", "hidden_vault")), C.collection_member(spark, d)).select("id", "kind", "n")


@query(with_tables("collection member", "SELECT c.id, c.name, count(m.asset_id) AS n FROM collection c LEFT JOIN (SELECT * FROM member WHERE collection_id <> 7) m ON m.collection_id = c.id WHERE c.kind = 'trip' GROUP BY 1, 2"))
def trip_collections(spark, d):
    """Trips and their numbers of members; one has lost all of them."""
    return L.counted(C.collection(spark, d).where("kind = 'trip'"), C.collection_member(spark, d).where("collection_id <> 7")).select("id", "name", "n")


@query(with_tables("face", "SELECT person_id, count(*) AS n FROM face GROUP BY 1"))
def face_counts_by_person(spark, d):
    return C.face(spark, d).groupBy("person_id").agg(F.count("*").alias("n"))


BEST = "row_number() OVER (PARTITION BY person_id ORDER BY quality DESC NULLS LAST, asset_id, n, part, price)"


@query(
    with_tables(
        "face person",
        f"""SELECT p.id, p.name, p.hidden, f.n_faces, f.cover FROM person p JOIN (SELECT person_id, max(k) AS n_faces, max(CASE WHEN r = 1 THEN asset_id END) AS cover
FROM (SELECT *, {BEST} AS r, count(*) OVER (PARTITION BY person_id) AS k FROM face WHERE person_id IS NOT NULL) GROUP BY 1) f ON f.person_id = p.id WHERE NOT p.hidden""",
    )
)
def people_cover(spark, d):
    return L.people(C.person(spark, d), C.face(spark, d), C.FACE_ORDER)


@query(with_tables("face", f"SELECT person_id, asset_id, quality FROM (SELECT *, {BEST} AS r FROM face WHERE person_id IS NOT NULL) WHERE r = 1"))
def person_best_face(spark, d):
    return L.best_face(C.face(spark, d), C.FACE_ORDER).select("person_id", "asset_id", "quality")


@query(with_tables("face person", "SELECT f.asset_id, f.n, f.part, f.price, p.name FROM face f LEFT JOIN person p ON p.id = f.person_id"))
def asset_faces(spark, d):
    """The faces of every asset, with the names of their persons."""
    p = C.person(spark, d).select(F.col("id").alias("person_id"), "name")
    return C.face(spark, d).join(p, "person_id", "left").select("asset_id", "n", "part", "price", "name")


asset_faces_all = asset_faces
QUERIES["asset_faces_all"], ORACLES["asset_faces_all"] = asset_faces, ORACLES["asset_faces"]


@query(with_tables("face", "SELECT person_id, count(*) AS n FROM (SELECT CASE WHEN person_id = 2 THEN 1 WHEN person_id = 5 THEN NULL ELSE person_id END AS person_id FROM face) GROUP BY 1"))
def merge_persons(spark, d):
    """Person 2 becomes person 1, person 5 is dissolved."""
    mapping = spark.createDataFrame([(2, 1), (5, None)], "old long, new long")
    return L.merge_persons(C.face(spark, d), mapping).groupBy("person_id").agg(F.count("*").alias("n"))


@query(with_tables("asset vec", "SELECT count(*) AS n, min(id) AS first_id FROM asset WHERE id NOT IN (SELECT asset_id FROM vec)"))
def missing_embeddings(spark, d):
    v = C.asset_vec(spark, d).select(F.col("asset_id").alias("id"))
    return C.asset(spark, d).join(v, "id", "left_anti").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(with_tables("asset face", "SELECT id FROM asset WHERE NOT is_video AND id NOT IN (SELECT asset_id FROM face)"))
def assets_needing_faces(spark, d):
    found = C.face(spark, d).select(F.col("asset_id").alias("id"))
    return C.asset(spark, d).where("not is_video").join(found, "id", "left_anti").select("id")


@query(with_tables("asset", "SELECT id, day, pos FROM asset JOIN (SELECT unnest([5, 3, 96, 1, 7, 34]) AS want, unnest([0, 1, 2, 3, 4, 5]) AS pos) ON want = id"))
def hydrate_in_order(spark, d):
    return L.hydrated([5, 3, 5, 96, 1, 7, 34, 3], C.asset(spark, d)).select("id", "day", F.col("pos").cast("int").alias("pos"))


@query(
    with_tables(
        "person collection",
        """SELECT * FROM (SELECT 'person' AS entity, id, name FROM person WHERE lower(name) LIKE '%1%' ORDER BY id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'album' AS entity, id, name FROM collection WHERE lower(name) LIKE '%1%' AND kind = 'album' ORDER BY id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'trip' AS entity, id, name FROM collection WHERE lower(name) LIKE '%1%' AND kind = 'trip' ORDER BY id LIMIT 5)""",
    )
)
def entity_search(spark, d):
    c = C.collection(spark, d)
    tables = {"person": C.person(spark, d), "album": c.where("kind = 'album'"), "trip": c.where("kind = 'trip'")}
    out = None
    for name, t in tables.items():
        hit = t.where(F.lower("name").contains("1")).orderBy("id").limit(5).select(F.lit(name).alias("entity"), "id", "name")
        out = hit if out is None else out.unionByName(hit)
    return out


# changes, queues, ledgers over events -------------------------------------------------------------------------------

CHANGES = "changes AS (SELECT user_id, ts, event_type, event_id, value FROM events)"


@query(
    f"""WITH {CHANGES}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM changes)
SELECT user_id, event_id, event_type FROM r WHERE r = 1 AND event_type <> 'error'"""
)
def upsert_latest(spark, d):
    """The newest change of each user over an old and a new half; an error event removes the user."""
    e = load(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_id", "event_type")
    old = L.merge_latest(e.limit(0).drop("op"), e.where("event_id % 2 = 0").withColumn("op", F.lit("upsert")), ["user_id"], "at")
    new = e.where("event_id % 2 = 1").withColumn("op", F.lit("upsert"))
    out = L.merge_latest(old, new, ["user_id"], "at")
    return out.where("event_type <> 'error'").select("user_id", "event_id", "event_type")


@query(f"WITH {CHANGES} SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n FROM changes GROUP BY 1")
def ledger_latest_status(spark, d):
    e = load(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("n"))


STATES = {"click": "pending", "view": "running", "purchase": "done"}
STATE_SQL = "CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'failed' END"


def _jobs(spark, d):
    state = F.lit("failed")
    for k, v in STATES.items():
        state = F.when(F.col("event_type") == k, v).otherwise(state)
    e = load(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 7).alias("kind"), F.col("user_id").alias("asset_id"), state.alias("state"), F.lit(0).alias("attempts"))


@query(f"SELECT {STATE_SQL} AS state, count(*) AS n FROM events GROUP BY 1")
def job_state_counts(spark, d):
    return _jobs(spark, d).groupBy("state").agg(F.count("*").alias("n"))


@query(
    f"""SELECT count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'running') AS running, count(*) FILTER (s = 'done') AS done,
count(*) FILTER (s = 'failed') AS failed FROM (SELECT {STATE_SQL} AS s FROM events)"""
)
def job_state_pivot(spark, d):
    s = F.col("state")
    return _jobs(spark, d).agg(*(F.count_if(s == k).alias(k) for k in ("pending", "running", "done", "failed")))


@query(
    f"""WITH j AS (SELECT event_id AS id, {STATE_SQL} AS state FROM events), head AS (SELECT id FROM j WHERE state = 'pending' ORDER BY id LIMIT 25)
SELECT id, CASE WHEN id IN (SELECT id FROM head) THEN 'running' ELSE state END AS state, CASE WHEN id IN (SELECT id FROM head) THEN 1 ELSE 0 END AS attempts FROM j"""
)
def queue_claim(spark, d):
    from lumora.streaming.feeds import claimed

    return claimed(_jobs(spark, d), 25).select("id", "state", "attempts")


@query(
    f"""WITH j AS (SELECT user_id % 7 AS kind, user_id AS asset_id, {STATE_SQL} AS state FROM events)
SELECT DISTINCT kind, asset_id, 'pending' AS state FROM (SELECT (o_custkey % 7) AS kind, o_custkey AS asset_id FROM orders)
WHERE (kind, asset_id) NOT IN (SELECT (kind, asset_id) FROM j WHERE state IN ('pending', 'running'))"""
)
def queue_enqueue(spark, d):
    from lumora.streaming.feeds import enqueued

    wanted = load(spark, d, "orders").select((F.col("o_custkey") % 7).alias("kind"), F.col("o_custkey").alias("asset_id"))
    return enqueued(_jobs(spark, d), wanted).select("kind", "asset_id", "state")


NOW = 1_705_708_800


@query(f"SELECT event_id, user_id FROM events WHERE value <= 50 OR epoch(ts) + 432000 > {NOW}")
def live_links(spark, d):
    """Links that have no expiry or are before it at a pinned now."""
    from lumora.operators import sharing

    expires = F.when(F.col("value") > 50, F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + 432000)
    return sharing.live(load(spark, d, "events").where("value is not null").select("event_id", "user_id", expires.alias("expires")), NOW).select("event_id", "user_id")


@query(
    """WITH k AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('click', 'view'))
SELECT s_suppkey AS peer, coalesce(k.event_type, '') AS share, CASE WHEN k.user_id IS NULL THEN 'pending' ELSE 'accepted' END AS state
FROM supplier LEFT JOIN k ON k.user_id = s_suppkey"""
)
def incoming_share_state(spark, d):
    keys = load(spark, d, "events").where(F.col("event_type").isin("click", "view")).select("user_id", "event_type").distinct()
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("peer"))
    out = s.join(keys, s["peer"] == keys["user_id"], "left")
    return out.select("peer", F.coalesce("event_type", F.lit("")).alias("share"), F.when(F.col("user_id").isNull(), "pending").otherwise("accepted").alias("state"))


@query(with_tables("asset", "SELECT id, day, 1 + (row_number() OVER (" + FEED + ") - 1) // 5 AS row_no FROM asset"))
def timeline_rows_packed(spark, d):
    """Five items a display row: rows are numbered in range partitions, with the counts of those before as offsets."""
    from pyspark.sql import Window

    from lumora.session import settle

    order = L.newest_first()
    dealt = C.asset(spark, d).repartitionByRange(*order).sortWithinPartitions(*order).select("id", "day", F.monotonically_increasing_id().alias("place"))
    dealt = settle(dealt.withColumn("part", F.shiftright("place", 33)).withColumn("at", F.col("place").bitwiseAND(F.lit((1 << 33) - 1))))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return dealt.join(F.broadcast(sizes), "part").select("id", "day", (F.floor((F.col("offset") + F.col("at")) / 5) + 1).alias("row_no"))


timeline_rows_packed_all = timeline_rows_packed
QUERIES["timeline_rows_packed_all"], ORACLES["timeline_rows_packed_all"] = timeline_rows_packed, ORACLES["timeline_rows_packed"]


@query(
    with_tables(
        "asset",
        f"""SELECT source_id, id, label, sum(CAST(label IS DISTINCT FROM before AS INT)) OVER (PARTITION BY source_id {FEED} ROWS UNBOUNDED PRECEDING) AS header_no FROM (
SELECT *, lag(label) OVER (PARTITION BY source_id {FEED}) AS before FROM (SELECT *, CASE WHEN day IS NULL THEN 'Undated' ELSE strftime(DATE '1970-01-01' + CAST(day AS INT), '%Y') END AS label FROM asset))""",
    )
)
def timeline_headers(spark, d):
    from pyspark.sql import Window

    from lumora.functions.scalars import zoom_label

    w = Window.partitionBy("source_id").orderBy(*L.newest_first())
    a = C.asset(spark, d).withColumn("label", zoom_label(F.col("day"), "year"))
    new = (~F.col("label").eqNullSafe(F.lag("label").over(w))).cast("int")
    return a.withColumn("new", new).select("source_id", "id", "label", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("header_no"))


@query(
    with_tables(
        "asset",
        """SELECT id, CASE WHEN day IS NULL THEN 'Undated' ELSE strftime(DATE '1970-01-01' + CAST(day AS INT), '%B %Y') END AS month, CASE WHEN day IS NULL THEN 'Undated' ELSE strftime(DATE '1970-01-01' + CAST(day AS INT), '%b %-d, %Y') END AS day_label FROM asset""",
    )
)
def timeline_labels(spark, d):
    """Headers of the month and day zooms."""
    from lumora.functions.scalars import zoom_label

    return C.asset(spark, d).select("id", zoom_label(F.col("day"), "month").alias("month"), zoom_label(F.col("day"), "day").alias("day_label"))

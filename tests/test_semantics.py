"""Operators on small literals whose results are known by hand."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.functions import codes
from lumora.functions import scalars as S
from lumora.operators import analytics as A
from lumora.operators.density import Grid, density_grid
from lumora.operators import ingest as I
from lumora.operators import library as L
from lumora.operators import sharing
from lumora.operators import text_index as T
from lumora.operators import vectors as V
from lumora.operators.components import components
from lumora.streaming import feeds


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_timeline_pages_cover_everything_once(spark):
    rows = [(i, None if i % 7 == 0 else i * 37 % 50) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, day long")
    cursor, seen = L.FIRST_CURSOR, []
    while cursor:
        page = L.page(df, cursor, 60)
        seen += [(r["id"], r["day"]) for r in page.collect()]
        cursor = L.next_cursor(page)
    assert seen == sorted(rows, key=lambda r: (r[1] or 0, r[0]), reverse=True)


def test_timeline_order(spark):
    df = spark.createDataFrame([(1, 100), (2, 200), (3, 150), (4, 50)], "id long, day long")
    assert [r["day"] for r in L.page(df).collect()] == [200, 150, 100, 50]


def test_hidden_on_any_membership(spark):
    members = spark.createDataFrame([(1, 10), (2, 10), (1, 11)], "collection_id long, asset_id long")
    collections = spark.createDataFrame([(1, "album"), (2, "hidden_vault")], "id long, kind string")
    assets = spark.createDataFrame([(10,), (11,), (12,)], "id long")
    out = L.visible(assets, L.hidden_assets(members, collections))
    assert sorted(r["id"] for r in out.collect()) == [11, 12]


def test_rules(spark):
    with pytest.raises(ValueError):
        L.compile_rule({})
    got = L.compile_rule({"date_to": "1970-01-11", "is_raw": True})
    assert (got.day_from, got.day_to, got.is_raw) == (None, 10, True)
    df = spark.createDataFrame([(1, 100, "Canon EOS"), (2, 200, None), (3, 300, "sony")], "id long, day long, device string")
    assert [r["id"] for r in L.search(df, L.Filter(day_from=150, day_to=250)).collect()] == [2]
    assert [r["id"] for r in L.search(df, L.Filter(device="canon")).collect()] == [1]


def test_memories(spark):
    day = lambda y, m, d: (date(y, m, d) - date(1970, 1, 1)).days
    rows = [(1, day(2023, 6, 1)), (2, day(2022, 6, 4)), (3, day(2022, 6, 5)), (4, day(2024, 6, 1)), (5, day(2020, 2, 29)), (6, day(2025, 6, 1))]
    df = spark.createDataFrame(rows, "id long, day long")
    got = {r["year"]: (r["years_ago"], r["ids"]) for r in A.on_this_day(df, date(2024, 6, 1)).collect()}
    assert got == {2023: (1, "1"), 2022: (2, "2"), 2025: (-1, "6")}
    wrap = spark.createDataFrame([(1, day(2020, 12, 30)), (2, day(2021, 1, 3))], "id long, day long")
    assert {r["year"] for r in A.on_this_day(wrap, date(2023, 1, 1)).collect()} == {2020, 2021}
    months = spark.createDataFrame([(m, day(2023, m, 5)) for m in range(1, 13)], "id long, day long")
    assert sorted(r["highlight"] for r in A.year_highlights(months, date(2024, 1, 1)).collect()) == [2, 4, 6, 8, 10, 12]


def test_person_years(spark):
    day = lambda y: (date(y, 5, 5) - date(1970, 1, 1)).days
    faces = spark.createDataFrame([(1, 11), (1, 12), (1, 13), (1, 11), (2, 11), (None, 12)], "person_id long, asset_id long")
    assets = spark.createDataFrame([(11, day(2023)), (12, day(2023)), (13, day(2023))], "id long, day long")
    got = A.person_years(faces, assets, date(2024, 1, 1), 2).collect()
    assert [(r["person_id"], r["year"], r["n"]) for r in got] == [(1, 2023, 3)]


def test_reverse_geocode(spark):
    spots = {"Tokyo": (35.68, 139.69), "Paris": (48.85, 2.35), "New York": (40.71, -74.0), "Sydney": (-33.87, 151.2), None: (30.0, -40.0)}
    for city, (lat, lon) in spots.items():
        got = one(spark, S.nearest_city(F.lit(lat), F.lit(lon)).alias("p"))["p"]
        assert (got and got["city"].replace(" City", "")) == city
    assert one(spark, S.nearest_city(F.lit(-85.0), F.lit(0.0)).alias("p"))["p"] is None


def dbscan(points, eps, least):
    near = [[j for j, q in enumerate(points) if sum((a - b) ** 2 for a, b in zip(p, q)) <= eps * eps] for p in points]
    core = [len(n) >= least for n in near]
    label = [None] * len(points)
    for i in range(len(points)):
        if core[i] and label[i] is None:
            todo = [i]
            while todo:
                k = todo.pop()
                if label[k] is None:
                    label[k] = i
                    todo += [j for j in near[k] if core[j] and label[j] is None]
    return [label[i] if core[i] else min((label[j] for j in near[i] if core[j]), default=None) for i in range(len(points))]


def test_density_clusters_equal_a_plain_run(spark):
    rng = np.random.default_rng(4)
    points = [tuple(x) for x in np.concatenate([rng.normal(c, 0.5, (25, 3)) for c in (0, 4, 9)] + [rng.uniform(-5, 15, (40, 3))])]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, x double, y double, z double")
    pairs = df.alias("p").join(df.alias("q"), F.expr("p.id < q.id and pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2) <= 1.0"))
    got = {r["id"]: r["cluster"] for r in A.density_clusters(pairs.select(F.col("p.id").alias("a"), F.col("q.id").alias("b")), df, 4).collect()}
    assert [got[i] for i in range(len(points))] == dbscan(points, 1.0, 4)
    assert got == {r["id"]: r["cluster"] for r in density_grid(df, Grid(1.0, 4)).collect()}


@pytest.mark.parametrize("rows, want", [("three", 3), ("apart", 2), ("next", 1), ("few", 0)])
def test_trips(spark, rows, want):
    cities = [(48.85, 2.35), (35.68, 139.69), (40.71, -74.0)]
    made = {
        "three": [(c * 5 + i, *cities[c], 100 + i % 2) for c in range(3) for i in range(5)],
        "apart": [(k * 5 + i, *cities[0], 100 + 60 * k) for k in range(2) for i in range(5)],
        "next": [(k * 5 + i, *cities[0], 100 + k) for k in range(2) for i in range(5)],
        "few": [(i, *cities[0], 100) for i in range(4)],
    }[rows]
    out = A.trips(spark.createDataFrame([*made, (99, 0.0, 0.0, 500)], "asset_id long, lat double, lon double, day long"))
    assert out.count() == want


def test_near_hash_clusters(spark):
    base = 0x0123456789ABCDEF
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(1, base), (2, base ^ 0b10), (3, base ^ 0b110), (4, base ^ 0xFFFFFFFFFFFFFFFF), (5, base)]
    df = spark.createDataFrame([(i, signed(h)) for i, h in rows], "id long, hash long")
    got = A.near_clusters(df, 6).collect()
    assert sorted((r["cluster"], r["id"], r["is_best"]) for r in got) == [(1, 1, True), (1, 2, False), (1, 3, False), (1, 5, False)]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1002, 1001), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000, 1002: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 5, 6):
        m = rng.integers(0, 1000, (n, n))
        got = V.assigned(m)
        assert sorted(got) == list(range(n))
        assert sum(m[i, j] for i, j in enumerate(got)) == max(sum(m[i, j] for i, j in enumerate(p)) for p in permutations(range(n)))


def test_vector_clusters_and_centroids(spark):
    unit = lambda *x: [v / sum(a * a for a in x) ** 0.5 for v in x]
    rows = [(1, unit(1, 0, 0)), (2, unit(1, 0.1, 0)), (3, unit(1, 0, 0.1)), (4, unit(0, 1, 0)), (5, unit(0, 1, 0.1)), (6, unit(0.1, 1, 0)), (7, unit(-1, -1, 3))]
    df = spark.createDataFrame(rows, "asset_id long, vec array<double>")
    got = {r["id"]: r["cluster"] for r in A.vector_clusters(df, 0.3, 3).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: None}
    labelled = df.withColumn("k", F.when(F.col("asset_id") <= 3, 1).when(F.col("asset_id") <= 6, 2).otherwise(-1))
    cents = A.centroids(labelled, "k")
    found = {r["k"]: (r["n"], r["centroid"]) for r in cents.collect()}
    assert set(found) == {1, 2} and found[1][0] == 3
    assert sum(v * v for v in found[1][1]) == pytest.approx(1)
    assert {r["merged"] for r in A.merged_clusters(cents, "k", 1.2).collect()} == {1}
    assert {r["merged"] for r in A.merged_clusters(cents, "k", 0.35).collect()} == {1, 2}


def test_text_index(spark):
    docs = spark.createDataFrame([(1, "The Quick, brown fox"), (2, "quick fox!"), (3, "")], "id long, text string")
    index = T.token_index(docs, "k")
    ids = lambda q, k="k": [r["id"] for r in T.and_search(index, q, k).collect()]
    assert (ids("fox"), ids("QUICK fox"), ids("brown fox"), ids("wolf"), ids(""), ids("fox", "other")) == ([1, 2], [1, 2], [1], [], [], [])
    changed = T.reindexed(index, spark.createDataFrame([(1, "wolf")], "id long, text string"), "k")
    assert [r["id"] for r in T.and_search(changed, "fox", "k").collect()] == [2]


def test_boxes(spark):
    box = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("x1", "y1", "x2", "y2"))))
    r = one(spark, S.iou(box(0, 0, 2, 2), box(0, 0, 2, 2)).alias("a"), S.iou(box(0, 0, 1, 1), box(2, 2, 3, 3)).alias("b"), S.iou(box(0, 0, 2, 1), box(1, 0, 3, 1)).alias("c"))
    assert (r["a"], r["b"]) == (1.0, 0.0) and r["c"] == pytest.approx(1 / 3)
    kept = S.suppressed(F.array(box(0, 0, 2, 2), box(0, 0, 2, 1.9), box(5, 5, 6, 6), box(5, 5, 6, 6.1)), 0.4)
    assert one(spark, F.size(kept).alias("n"))["n"] == 2


def test_ingest_names_pairs_and_sidecars(spark):
    p = spark.createDataFrame([("/a/x.jpg",), ("/a/y.HEIC",), ("/a/z.CR2",), ("/a/t.txt",), ("/a/.h.jpg",)], "path string")
    assert [r[0] for r in p.select(I.is_candidate(F.col("path"))).collect()] == [True, True, True, False, False]
    s = spark.createDataFrame([("/d/IMG_1.HEIC",), ("/d/IMG_1.MOV",), ("/d/IMG_2.CR2",), ("/d/IMG_2.JPG",), ("/d/IMG_1234.jpg",), ("/d/IMG_E1234.jpg",)], "path string")
    pairs = {r["stem"]: (bool(r["motion"]), bool(r["raw"])) for r in I.sibling_pairs(s).collect()}
    assert pairs == {"IMG_1": (True, False), "IMG_2": (False, True)}
    assert [(r["number"], r["n"]) for r in I.bursts(s).collect()] == [("1234", 2)]
    body = I.render_sidecar(F.lit("A & B"), F.lit("<d>"), F.array(F.lit("t1"), F.lit("x>y")))
    got = one(spark, I.sidecar(body).alias("s"))["s"]
    assert (got["title"], got["description"], got["tags"], got["album"]) == ("A & B", "<d>", ["t1", "x>y"], None)
    gps = one(spark, S.parse_gps(S.format_gps(F.lit(-47.6242), "N", "S")).alias("g"), S.parse_gps(F.lit("bad")).alias("n"))
    assert gps["g"] == pytest.approx(-47.6242, abs=0.001) and gps["n"] is None
    t = one(spark, I.takeout(F.lit('{"title":"T","photoTakenTime":{"timestamp":"86400"},"geoData":{"latitude":0,"longitude":0}}')).alias("t"), I.takeout(F.lit("{bad")).alias("b"))
    assert t["t"]["title"] == "T" and t["t"]["lat"] is None and t["t"]["taken"].day == 2
    m = spark.createDataFrame([("/t/a.jpg",), ("/t/b.jpg",)], "path string")
    j = spark.createDataFrame([("/t/a.jpg.json", "1"), ("/t/a.jpg.supplemental-metadata.json", "2"), ("/t/b.jpg.supplemental-metadata.json", "3")], "path string, json string")
    assert {r["path"]: r["json"] for r in I.with_takeout(m, j).collect()} == {"/t/a.jpg": "1", "/t/b.jpg": "3"}


def test_scan_and_mime(spark, tmp_path):
    (tmp_path / "IMG.jpg").write_bytes(b"\xff\xd8\xff\xe0rest MicroVideo end")
    (tmp_path / "x.bin").write_bytes(b"\x89PNG\r\n\x1a\n....")
    rows = I.scan(spark, f"file://{tmp_path}").select("path", "length", I.mime_of(F.col("path"), F.col("content")).alias("m"), I.has_motion_trailer(F.col("content")).alias("t"))
    got = {r["path"].rsplit("/", 1)[1]: (r["m"], r["t"]) for r in rows.collect()}
    assert got == {"IMG.jpg": ("image/jpeg", True), "x.bin": ("image/png", False)}


def test_days(spark):
    r = one(spark, S.epoch_day(F.lit("2024-06-01 12:30:00").cast("timestamp")).alias("a"), S.epoch_day(F.lit("1969-12-31 12:00:00").cast("timestamp")).alias("b"))
    assert (r["a"], r["b"]) == (19875, 0)
    d = lambda s: F.lit(s).cast("date")
    r = one(spark, S.range_label(d("2024-01-03"), d("2024-01-03")).alias("a"), S.range_label(d("2024-01-03"), d("2024-01-10")).alias("b"), S.range_label(d("2023-12-30"), d("2024-01-02")).alias("c"))
    assert tuple(r) == ("Jan 3, 2024", "Jan 3 → Jan 10, 2024", "Dec 30, 2023 → Jan 2, 2024")
    r = one(spark, S.first_time(F.lit("nope"), F.lit("2020:01:02 03:04:05")).alias("t"))
    assert r["t"].year == 2020


def test_upserts_and_people(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, at long")
    new = spark.createDataFrame([(1, "c", 2, "upsert"), (2, "x", 3, "delete"), (3, "d", 1, "upsert"), (1, "late", 0, "upsert")], "k long, v string, at long, op string")
    assert sorted((r["k"], r["v"]) for r in L.merge_latest(old, new, ["k"], "at").collect()) == [(1, "c"), (3, "d")]
    faces = spark.createDataFrame([(1, 10, 0.5), (1, 11, None), (2, 12, 0.9), (None, 13, 0.1)], "person_id long, asset_id long, quality double")
    persons = spark.createDataFrame([(1, "a", False), (2, "b", True), (3, "c", False)], "id long, name string, hidden boolean")
    got = L.people(persons, faces, ("asset_id",)).collect()
    assert [(r["id"], r["n_faces"], r["cover"]) for r in got] == [(1, 2, 10)]
    assert {r["id"] for r in L.people(persons, faces, ("asset_id",), True).collect()} == {1, 2}


def test_queue(spark):
    jobs = spark.createDataFrame([(1, "k", 7, "pending", 0), (2, "k", 8, "done", 1), (3, "k", 9, "pending", 0)], "id long, kind string, asset_id long, state string, attempts int")
    wanted = spark.createDataFrame([("k", 7), ("k", 8), ("k", 8)], "kind string, asset_id long")
    assert [r["asset_id"] for r in feeds.enqueued(jobs, wanted).collect()] == [8]
    now = feeds.claimed(jobs).withColumn("error", F.lit(None).cast("string"))
    assert {r["id"]: (r["state"], r["attempts"]) for r in now.collect()} == {1: ("running", 1), 2: ("done", 1), 3: ("pending", 0)}
    end = feeds.finished(now, spark.createDataFrame([(1, "boom"), (3, None)], "id long, error string"))
    assert {r["id"]: (r["state"], r["error"]) for r in end.collect()} == {1: ("failed", "boom"), 2: ("done", None), 3: ("pending", None)}


def test_feed_stream_equals_batch(spark, tmp_path):
    rows = [(1, "a", 1, "upsert"), (1, "b", 2, "upsert"), (2, "c", 1, "upsert"), (2, "c", 3, "delete"), (3, "d", 1, "upsert")]
    schema = "k long, v string, at long, op string"
    for n, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p={n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("p")
    feeds.apply_feed(stream, str(tmp_path / "out"), ["k"], "at", str(tmp_path / "cp")).awaitTermination()
    last = max(int(p.name[2:]) for p in (tmp_path / "out").iterdir() if p.name.startswith("v="))
    got = spark.read.parquet(str(tmp_path / f"out/v={last}")).collect()
    assert sorted((r["k"], r["v"]) for r in got) == [(1, "b"), (3, "d")]


def test_shares_and_codes(spark):
    keys = spark.createDataFrame([(1, "p"), (1, "q")], "collection_id long, peer_identity string")
    ledger = spark.createDataFrame([(1, "p", "active", 1), (1, "q", "active", 1)], "collection_id long, peer_identity string, status string, changed_at long")
    left, log = sharing.revoked(keys, ledger, 1, "p", 2)
    assert [r["peer_identity"] for r in left.collect()] == ["q"]
    assert sorted(r["status"] for r in log.collect()) == ["active", "active", "revoked", "rotated"]
    raw = F.unhex(F.lit("00ff10ab00ff10ab00ff10ab00ff10ab"))
    r = one(spark, codes.base32(raw).alias("b"), F.hex(codes.from_base32(codes.base32(raw))).alias("h"), codes.from_base32(F.lit("a!")).alias("n"), codes.member_of(codes.member_key(F.lit(77))).alias("m"))
    import base64

    assert r["b"] == base64.b32encode(bytes.fromhex("00ff10ab" * 4)).decode().lower().rstrip("=")
    assert r["h"].lower() == "00ff10ab" * 4 and r["n"] is None and r["m"] == 77
    v = spark.createDataFrame([(bytearray(np.array([1.5, -2], "<f4").tobytes() + b"x"),)], "b binary").select(codes.floats("b").alias("v")).first()["v"]
    assert v == [1.5, -2.0]


def test_sql_functions(spark):
    S.register(spark)
    r = spark.sql("select hamming64(5, 6) as h, round(haversine_km(0, 0, 0, 1), 2) as km, tokenize('B a, b') as t").first()
    assert (r["h"], r["km"], r["t"]) == (2, 111.19, ["a", "b"])


def test_cities_of_a_cell_are_enough(spark):
    """The fold over a cell's cities gives what the fold over the whole table gives, near cities, at their edges and at the poles."""
    from lumora.functions import cities
    from lumora.operators import analytics as A

    rng = random.Random(4)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 179.999)]
    for lat, lon, *_ in cities.rows():
        spots += [(max(-90.0, min(90.0, lat + rng.uniform(-6, 6))), max(-180.0, min(180.0, lon + rng.uniform(-8, 8)))) for _ in range(6)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "asset_id long, lat double, lon double")
    want = {r[0]: r[1] for r in points.select("asset_id", S.nearest_city(F.col("lat"), F.col("lon")).alias("p")).collect()}
    got = {r["asset_id"]: r["place"] for r in A.named_points(points).collect()}
    assert got == {k: v for k, v in want.items() if v is not None} and len(got) > 200


def test_rasters_and_digests_are_computed_once(spark):
    import base64

    row = spark.range(1).select(F.array("id").alias("g"), F.lit("x" * 700).alias("text"), F.lit("x" * 700).cast("binary").alias("raw"))
    for column, name in ((S.difference_hash(F.reverse("g")), "reverse("), (codes.base32(F.unhex(F.md5("raw"))), "md5("), (codes.from_base32(F.reverse("text")), "reverse(")):
        assert row.select(column.alias("c"))._jdf.queryExecution().logical().toString().count(name) == 1
    want = base64.b32encode(b"x" * 700).decode().lower().rstrip("=")
    assert row.select(codes.base32(F.col("raw")).alias("b")).first()["b"] == want


def test_persons_assets_are_dealt_by_number_of_rows(spark, monkeypatch):
    assert A.parts_for(spark.range(5_000_001)) == 11
    monkeypatch.setattr(A, "parts_for", lambda rows: 13)
    faces = spark.createDataFrame([(k % 50, k % 3 or None) for k in range(400)], "asset_id long, person_id long")
    assets = spark.createDataFrame([(k, 1000 + k) for k in range(50)], "id long, day long")
    met = A.person_assets(faces, assets, date(2024, 1, 1))
    assert met.rdd.getNumPartitions() == 13 and met.count() == 100
    assert sorted((r["person_id"], r["n"]) for r in A.person_years(faces, assets, date(2024, 1, 1)).collect()) == [(1, 50), (2, 50)]


def test_tokens_travel_as_bytes(spark):
    index = T.token_index(spark.createDataFrame([(1, "a b b"), (2, "c"), (3, "a"), (4, "")], "id long, text string"), "k")
    kept = T.without(index, spark.createDataFrame([(2,), (9,)], "id long"))
    assert sorted(map(tuple, kept.collect())) == sorted(tuple(r) for r in index.collect() if r["id"] != 2)
    assert sorted(map(tuple, T.token_counts(kept).collect())) == [(1, 2), (3, 1)]
    assert "unhex" in kept._jdf.queryExecution().optimizedPlan().toString().split("LeftAnti")[1]

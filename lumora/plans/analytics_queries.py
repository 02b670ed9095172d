"""Queries of memories, places, trips, near duplicates, vectors and boxes."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumora.functions import cities
from lumora.functions import scalars as S
from lumora.operators import analytics as A
from lumora.operators.density import Grid, density_grid, grown
from lumora.operators import vector_lists
from lumora.operators.vectors import near_vectors, reassigned
from lumora.plans.book import query
from lumora.session import load, shared_dir
from lumora.sources import catalogue as C
from lumora.sources.catalogue import with_tables

TODAY = date(2002, 6, 15)
DATE = "(DATE '1970-01-01' + CAST(greatest(day, 0) AS INT))"


@query(
    with_tables(
        "asset",
        f"""SELECT year(t) AS year, 2002 - year(t) AS years_ago, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM (SELECT id, {DATE} AS t FROM asset WHERE day IS NOT NULL)
WHERE year(t) <> 2002 AND try_cast(strftime(t, '2002-%m-%d') AS DATE) IS NOT NULL
AND least(abs(dayofyear(try_cast(strftime(t, '2002-%m-%d') AS DATE)) - 166), 365 - abs(dayofyear(try_cast(strftime(t, '2002-%m-%d') AS DATE)) - 166)) <= 3 GROUP BY 1, 2""",
    )
)
def on_this_day(spark, d):
    return A.on_this_day(C.asset(spark, d), TODAY)


@query(
    with_tables(
        "asset",
        f"""SELECT year, bimonth, highlight, n_year FROM (SELECT year, CAST(b AS INT) AS bimonth, id AS highlight, row_number() OVER (PARTITION BY year, b ORDER BY id) AS r,
count(*) OVER (PARTITION BY year, b) AS n, count(*) OVER (PARTITION BY year) AS n_year FROM (SELECT id, year({DATE}) AS year, (month({DATE}) - 1) // 2 AS b FROM asset WHERE day IS NOT NULL) WHERE year < 2002)
WHERE r = n // 2 + 1""",
    )
)
def year_in_photos(spark, d):
    return A.year_highlights(C.asset(spark, d), TODAY).select("year", "bimonth", "highlight", "n_year")


@query(
    with_tables(
        "asset face",
        f"""SELECT person_id, year({DATE}) AS year, count(DISTINCT asset_id) AS n, min(asset_id) AS first_id, max(asset_id) AS last_id FROM face JOIN asset ON id = asset_id
WHERE person_id IS NOT NULL AND day IS NOT NULL AND year({DATE}) < 2002 GROUP BY 1, 2 HAVING count(DISTINCT asset_id) >= 3""",
    )
)
def person_year(spark, d):
    return A.person_years(C.face(spark, d), C.asset(spark, d), TODAY)


def _hav(a, b, c, e):
    return f"(asin(sqrt(least(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({e} - {b}) / 2), 2), 1.0))) * 12742.0)"


def _fold() -> str:
    rows = ", ".join(f"{{'lat': {r[0]}::DOUBLE, 'lon': {r[1]}::DOUBLE, 'city': '{r[2].replace(chr(39), chr(39) * 2)}', 'region': '{r[3].replace(chr(39), chr(39) * 2)}', 'country': '{r[4].replace(chr(39), chr(39) * 2)}', 'people': {r[5]}, 'd': NULL::DOUBLE}}" for r in cities.rows())
    at = _hav("lat", "lon", "a.lat", "a.lon")
    to = _hav("lat", "lon", "b.lat", "b.lon")
    first = f"CASE WHEN a.d IS NULL THEN {at} ELSE a.d END"
    take = f"{to} < {first} - 0.5 OR ({to} < {first} + 10 AND b.people > a.people)"
    put = lambda x, dist: f"{{'lat': {x}.lat, 'lon': {x}.lon, 'city': {x}.city, 'region': {x}.region, 'country': {x}.country, 'people': {x}.people, 'd': {dist}}}"
    return f"""spots AS (SELECT DISTINCT lat, lon FROM geo WHERE lat IS NOT NULL AND lon IS NOT NULL), folded AS (SELECT lat, lon,
list_reduce([{rows}], lambda a, b: CASE WHEN {take} THEN {put('b', to)} ELSE {put('a', first)} END) AS best FROM spots),
named AS (SELECT lat, lon, best.city AS city, best.region AS region, best.country AS country FROM folded WHERE best.d <= 500)"""


FOLD = _fold()


@query(with_tables("geo", "").rstrip() + ", " + FOLD + " SELECT city, country, count(*) AS n FROM named GROUP BY 1, 2")
def reverse_geocode(spark, d):
    spots = C.geo(spark, d).select("lat", "lon").distinct()
    return A.named_points(spots).groupBy("place.city", "place.country").agg(F.count("*").alias("n"))


@query(
    with_tables("geo", "").rstrip()
    + ", "
    + FOLD
    + """, p AS (SELECT country || ':' || city AS place_id, region, asset_id, g.lat, g.lon FROM geo g JOIN named USING (lat, lon)),
r AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY asset_id) - 1 AS r, count(*) OVER (PARTITION BY place_id) AS k FROM p)
SELECT place_id, min(region) AS region, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon,
string_agg(CAST(asset_id AS VARCHAR), ',' ORDER BY asset_id) FILTER (r % (greatest(k, 6) // 6) = 0 AND r < 6 * (greatest(k, 6) // 6)) AS sample FROM r GROUP BY 1"""
)
def places_grouped(spark, d):
    return A.places(C.geo(spark, d)).select("place_id", "region", "n", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "sample")


@query(with_tables("geo collection member hidden", "SELECT asset_id, lat, lon, source_id FROM geo WHERE lat IS NOT NULL AND day BETWEEN 9000 AND 10000 AND asset_id NOT IN (SELECT asset_id FROM hidden)"))
def map_points(spark, d):
    """Points of a range of days, without hidden ones."""
    from lumora.operators import library as L

    hidden = L.hidden_assets(C.collection_member(spark, d), C.collection(spark, d))
    return A.map_points(C.geo(spark, d), 9000, 10000, hidden=hidden).select("asset_id", "lat", "lon", "source_id")


@query(with_tables("geo", "SELECT asset_id, lat, lon FROM geo WHERE lat IS NOT NULL AND source_id = 7"))
def map_points_of_source(spark, d):
    """Points of one source with the hidden ones unlocked."""
    return A.map_points(C.geo(spark, d), source_id=7).select("asset_id", "lat", "lon")


@query(with_tables("geo", "SELECT CAST(floor(lon / 0.5) AS BIGINT) AS gx, CAST(floor(lat / 0.5) AS BIGINT) AS gy, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM geo WHERE lat IS NOT NULL GROUP BY 1, 2"))
def map_grid(spark, d):
    return A.map_grid(C.geo(spark, d), 4.0).select("gx", "gy", "n", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(
    with_tables(
        "geo",
        """SELECT list_sort(list(lat))[1 + least(CAST(floor(count(*) * 0.05) AS BIGINT), count(*) - 1)] AS lat_low, list_sort(list(lat))[1 + least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1)] AS lat_high,
list_sort(list(lon))[1 + least(CAST(floor(count(*) * 0.05) AS BIGINT), count(*) - 1)] AS lon_low, list_sort(list(lon))[1 + least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1)] AS lon_high FROM geo WHERE lat IS NOT NULL""",
    )
)
def geo_bounds(spark, d):
    return A.bounds(C.geo(spark, d))


@query(
    with_tables(
        "geo",
        """p AS (SELECT list_sort(list(lat)) AS a, list_sort(list(lon)) AS o, count(*) AS n FROM geo WHERE lat IS NOT NULL), b AS (SELECT a[1 + CAST(floor(n * 0.05) AS BIGINT)] AS lat_low, a[1 + CAST(floor(n * 0.95) AS BIGINT)] AS lat_high,
o[1 + CAST(floor(n * 0.05) AS BIGINT)] AS lon_low, o[1 + CAST(floor(n * 0.95) AS BIGINT)] AS lon_high FROM p), s AS (SELECT *, greatest(lat_high - lat_low, 1.0) AS span_lat, greatest(lon_high - lon_low, 1.0) AS span_lon FROM b)
SELECT lat_low, lat_high, lon_low, lon_high, span_lat, span_lon, greatest(least(144.0::DOUBLE / span_lat, 288.0::DOUBLE / span_lon, 8.0), 1.0) AS zoom, (lon_low + lon_high) / 2 / 360 * 720 AS cx, -((lat_low + lat_high) / 2 / 180) * 360 AS cy FROM s""",
    ).replace("\np AS", ",\np AS")
)
def map_view(spark, d):
    """Where the map opens: bounds without outliers, spans, zoom and centre."""
    return A.fitted_view(A.bounds(C.geo(spark, d)))


TRIP = dict(eps_km=60.0, eps_days=20.0, least=4)
CORES = """pts AS (SELECT asset_id AS id, lat, lon, day, lat * 111.0 AS x, lon * 111.0 * cos(radians(lat)) AS y, day * 3.0::DOUBLE AS z FROM geo WHERE lat IS NOT NULL AND day IS NOT NULL),
nb AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON a.id <> b.id AND abs(a.z - b.z) <= 60 AND abs(a.x - b.x) <= 60 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 3600),
core AS (SELECT a AS id FROM nb GROUP BY 1 HAVING count(*) + 1 >= 4),
ce AS (SELECT a, b FROM nb WHERE a IN (FROM core) AND b IN (FROM core)),
reach AS (SELECT id, id AS root FROM core UNION SELECT ce.a, r.root FROM reach r JOIN ce ON ce.b = r.id AND r.root < ce.a),
named0 AS (SELECT id, min(root) AS cluster FROM reach GROUP BY 1),
lab AS (SELECT * FROM named0 UNION ALL SELECT nb.a, min(n.cluster) FROM nb JOIN named0 n ON n.id = nb.b WHERE nb.a NOT IN (FROM core) GROUP BY 1)"""


@query(
    with_tables("geo", "").replace("WITH ", "WITH RECURSIVE ").rstrip()
    + ", "
    + CORES
    + " SELECT cluster AS trip_id, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, min(day) AS start_day, max(day) AS end_day FROM lab JOIN pts USING (id) GROUP BY 1"
)
def trips(spark, d):
    out = A.trips(C.geo(spark, d), **TRIP)
    return out.select("trip_id", "n", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "start_day", "end_day")


@query(
    with_tables("geo", "").replace("WITH ", "WITH RECURSIVE ").rstrip()
    + ", "
    + CORES
    + """ SELECT cluster AS trip_id, min(day) AS start_day, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS content_id
FROM lab JOIN pts USING (id) GROUP BY 1"""
)
def trip_members(spark, d):
    """Trips by first day with their sorted members and an id made of these; a trip is what one display holds."""
    return A.trip_members(C.geo(spark, d), **TRIP).orderBy("start_day", "trip_id")


@query(
    with_tables("geo", "").replace("WITH ", "WITH RECURSIVE ").rstrip()
    + ", "
    + CORES
    + ", t AS (SELECT cluster AS trip_id, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon, DATE '1970-01-01' + CAST(min(day) AS INT) AS s, DATE '1970-01-01' + CAST(max(day) AS INT) AS e FROM lab JOIN pts USING (id) GROUP BY 1), "
    + FOLD.replace("FROM geo WHERE", "FROM t WHERE")
    + """ SELECT trip_id, city AS place, coalesce(city, 'Trip · ' || n || ' photos') || ' · ' || CASE WHEN e = s THEN strftime(s, '%b %-d, %Y') WHEN year(s) = year(e) THEN strftime(s, '%b %-d') || ' → ' || strftime(e, '%b %-d, %Y')
ELSE strftime(s, '%b %-d, %Y') || ' → ' || strftime(e, '%b %-d, %Y') END AS label FROM t LEFT JOIN named USING (lat, lon)"""
)
def trip_labels(spark, d):
    return A.trips(C.geo(spark, d), **TRIP).select("trip_id", "place", "label")


@query(with_tables("geo", "").replace("WITH ", "WITH RECURSIVE ").rstrip() + ", " + CORES + " SELECT id AS asset_id, cluster AS trip_id FROM lab")
def trip_member_rows(spark, d):
    """Members of trips as rows, for trips of any size."""
    return A.trip_labels(C.geo(spark, d), **TRIP).select("asset_id", "trip_id")


@query(with_tables("geo", "").replace("WITH ", "WITH RECURSIVE ").rstrip() + ", " + CORES + " SELECT id AS asset_id, cluster AS trip_id FROM lab")
def trips_grown(spark, d):
    """Members of trips after the last twentieth of the days came in on top of the rest: only the surroundings of new points are looked at."""
    pts = A.trip_points(C.geo(spark, d), TRIP["eps_km"], TRIP["eps_days"])
    lo, hi = pts.agg(F.min("day"), F.max("day")).first()
    grid, cut = Grid(TRIP["eps_km"], TRIP["least"]), lo + (hi - lo) * 19 // 20 if lo is not None else 0
    state = density_grid(pts.where(F.col("day") < cut), grid)
    return grown(state, pts.where(F.col("day") >= cut), grid).where("cluster is not null").select(F.col("id").alias("asset_id"), F.col("cluster").alias("trip_id"))


HASH = "(SELECT CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) FROM (SELECT list_reduce(list_prepend(0::HUGEINT, list_transform(vec[1:64], lambda x: CAST(x > 0 AS HUGEINT))), lambda s, x: s * 2 + x) AS u))"


def _hashes(spark, d):
    return C.asset_vec(spark, d).select(F.col("asset_id").alias("id"), S.sign_hash(F.col("vec")).alias("hash"))


@query(
    with_tables("vec", "").rstrip()
    + f""", h AS (SELECT asset_id AS id, {HASH} AS hash FROM vec), c AS (SELECT hash, min(id) AS id FROM h GROUP BY 1)
SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.hash, b.hash)) AS INT) AS bits FROM c a JOIN c b ON a.id < b.id AND bit_count(xor(a.hash, b.hash)) <= 20
AND (((a.hash >> 60) & 15) = ((b.hash >> 60) & 15) OR ((a.hash >> 56) & 15) = ((b.hash >> 56) & 15))
UNION ALL SELECT c.id, h.id, 0 FROM h JOIN c ON c.hash = h.hash AND c.id <> h.id"""
)
def near_dup_pairs(spark, d):
    return A.near_hashes(_hashes(spark, d), 20)


@query(
    with_tables("vec", "").rstrip()
    + f""", o AS (SELECT asset_id AS id, {HASH} AS hash FROM vec), h AS (FROM o UNION ALL SELECT id + 1000000, xor(hash, CAST(1 AS BIGINT) << (id % 60)) FROM o UNION ALL SELECT id + 2000000, xor(hash, CAST(21 AS BIGINT) << (id % 50)) FROM o), c AS (SELECT hash, min(id) AS id FROM h GROUP BY 1)
SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.hash, b.hash)) AS INT) AS bits FROM c a JOIN c b ON a.id < b.id AND bit_count(xor(a.hash, b.hash)) <= 6
AND (((a.hash >> 60) & 15) = ((b.hash >> 60) & 15) OR ((a.hash >> 56) & 15) = ((b.hash >> 56) & 15))
UNION ALL SELECT c.id, h.id, 0 FROM h JOIN c ON c.hash = h.hash AND c.id <> h.id"""
)
def near_dup_pairs_close(spark, d):
    """Pairs within six bits, among hashes and changed copies of them, where long keys find every pair."""
    h = _hashes(spark, d)
    changed = lambda n, bits, most: h.select((F.col("id") + n).alias("id"), F.expr(f"hash ^ shiftleft({bits}L, CAST(id % {most} AS INT))").alias("hash"))
    return A.near_hashes(h.unionByName(changed(1_000_000, 1, 60)).unionByName(changed(2_000_000, 21, 50)), 6)


@query(
    with_tables("vec", "").replace("WITH ", "WITH RECURSIVE ").rstrip()
    + f""", h AS (SELECT asset_id AS id, {HASH} AS hash FROM vec),
e AS (SELECT a.id AS a, b.id AS b FROM h a JOIN h b ON a.id <> b.id AND bit_count(xor(a.hash, b.hash)) <= 20
AND (((a.hash >> 60) & 15) = ((b.hash >> 60) & 15) OR ((a.hash >> 56) & 15) = ((b.hash >> 56) & 15))),
reach AS (SELECT DISTINCT a AS id, a AS root FROM e UNION SELECT e.a, r.root FROM reach r JOIN e ON e.b = r.id AND r.root < e.a),
c AS (SELECT id, min(root) AS cluster FROM reach GROUP BY 1)
SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY label DESC NULLS LAST, id) = 1 AS is_best FROM c JOIN vec ON asset_id = id"""
)
def near_dup_clusters(spark, d):
    quality = C.asset_vec(spark, d).select(F.col("asset_id").alias("id"), F.col("label").cast("double").alias("quality"))
    return A.near_clusters(_hashes(spark, d), 20, quality)


def _query_vector(spark, d):
    row = C.asset_vec(spark, d).where("asset_id = 0").select("vec").first()
    return [float(x) for x in row["vec"]]


DOT = "list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(v.vec, q.vec), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), lambda s, x: s + x)"


@query(with_tables("vec", f"SELECT v.asset_id, round({DOT}, 6) AS score FROM vec v, (SELECT vec FROM vec WHERE asset_id = 0) q ORDER BY {DOT} DESC, v.asset_id LIMIT 20"))
def vector_topk(spark, d):
    vecs = C.asset_vec(spark, d)
    asked = F.broadcast(vecs.where("asset_id = 0").select(F.col("vec").alias("asked")))  # one row
    top = vecs.crossJoin(asked).withColumn("s", S.dot(F.col("vec"), F.col("asked"))).orderBy(F.col("s").desc(), "asset_id").limit(20)
    return top.select("asset_id", F.round("s", 6).alias("score"))


@query(
    with_tables(
        "asset vec",
        f"""SELECT id, round(score, 5) AS score FROM (SELECT a.id, a.day, CASE WHEN v.vec IS NOT NULL THEN {DOT} / (SELECT sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(v.vec, v.vec), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), lambda s, x: s + x)) * sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.vec, q.vec), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), lambda s, x: s + x))) END AS score
FROM asset a LEFT JOIN vec v ON v.asset_id = a.id, (SELECT vec FROM vec WHERE asset_id = 0) q WHERE a.is_raw) ORDER BY score DESC NULLS LAST, coalesce(day, 0) DESC, id DESC LIMIT 300""",
    )
)
def vector_rerank_unscored_last(spark, d):
    from lumora.operators import library as L

    out = L.search(C.asset(spark, d), L.Filter(is_raw=True), vectors=C.asset_vec(spark, d), query=_query_vector(spark, d), limit=300)
    return out.select("id", F.round("score", 5).alias("score"))


@query(
    with_tables("vec", "").rstrip()
    + """, x AS (SELECT label, unnest(vec) AS v, generate_subscripts(vec, 1) AS i FROM vec), m AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM x GROUP BY 1, 2),
s AS (SELECT label, sqrt(sum(m * m)) AS norm FROM m GROUP BY 1) SELECT label, CAST(i - 1 AS INT) AS i, round(m / norm, 5) AS x FROM m JOIN s USING (label)"""
)
def centroids(spark, d):
    out = A.centroids(C.asset_vec(spark, d), "label")
    return out.select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 5).alias("x"))


FACES = dict(eps=0.64, least=3)


@query(
    with_tables("vec", "").replace("WITH ", "WITH RECURSIVE ").rstrip()
    + f""", nb AS (SELECT v.asset_id AS a, q.asset_id AS b FROM vec v JOIN vec q ON v.asset_id <> q.asset_id WHERE {DOT} >= 1.0 - 0.64::DOUBLE),
core AS (SELECT a AS id FROM nb GROUP BY 1 HAVING count(*) + 1 >= 3), ce AS (SELECT a, b FROM nb WHERE a IN (FROM core) AND b IN (FROM core)),
reach AS (SELECT id, id AS root FROM core UNION SELECT ce.a, r.root FROM reach r JOIN ce ON ce.b = r.id AND r.root < ce.a),
n0 AS (SELECT id, min(root) AS cluster FROM reach GROUP BY 1),
lab AS (SELECT * FROM n0 UNION ALL SELECT nb.a, min(n0.cluster) FROM nb JOIN n0 ON n0.id = nb.b WHERE nb.a NOT IN (FROM core) GROUP BY 1)
SELECT v.asset_id AS id, cluster FROM vec v LEFT JOIN lab ON lab.id = v.asset_id"""
)
def face_clusters(spark, d):
    return A.vector_clusters(C.asset_vec(spark, d), **FACES)


@query(
    with_tables("vec", "").rstrip()
    + f""", big AS (SELECT v.asset_id AS a, q.asset_id AS b, round({DOT}, 6) AS score FROM vec v JOIN vec q ON v.asset_id < q.asset_id WHERE {DOT} >= 0.4::DOUBLE) SELECT * FROM big"""
)
def near_vector_pairs(spark, d):
    """All pairs of vectors with a dot product of 0.4 or more, by pivots."""
    return near_vectors(C.asset_vec(spark, d), 0.4).withColumn("score", F.round("score", 6))


def _lists(spark, d, tries=0):
    vecs = C.asset_vec(spark, d)
    lists = vector_lists.build(vecs, f"{shared_dir(spark)}/lumora-lists-{uuid.uuid4().hex}", tries=tries)
    return lists, vecs.where("asset_id % 50 = 0").select(F.col("asset_id").alias("query_id"), "vec")


@query(with_tables("vec", f"SELECT query_id, CAST(rank AS INT) AS rank, asset_id, round(score, 6) AS score FROM (SELECT q.asset_id AS query_id, v.asset_id, {DOT} AS score, row_number() OVER (PARTITION BY q.asset_id ORDER BY {DOT} DESC, v.asset_id) AS rank FROM vec v, vec q WHERE q.asset_id % 50 = 0) WHERE rank <= 20"))
def vector_lists_exact(spark, d):
    """The twenty nearest of every fiftieth vector from the stored lists, all of them read."""
    lists, asked = _lists(spark, d)
    return vector_lists.search(spark, lists, asked, exact=True).withColumn("score", F.round("score", 6))


@query(
    with_tables("vec", f"""SELECT round(avg(CAST(hit AS INT)), 6) AS accuracy FROM (SELECT query_id, bool_or(label = own) AS hit FROM (SELECT q.asset_id AS query_id, q.label AS own, v.label, row_number() OVER (PARTITION BY q.asset_id ORDER BY {DOT} DESC, v.asset_id) AS rank
FROM vec v, vec q WHERE q.asset_id % 50 = 0 AND v.asset_id <> q.asset_id) WHERE rank <= 5 GROUP BY 1)""")
)
def retrieval_accuracy(spark, d):
    """How often one of the five nearest other vectors has the query's own label."""
    lists, asked = _lists(spark, d)
    own = C.asset_vec(spark, d).select("asset_id", "label")
    near = vector_lists.search(spark, lists, asked, k=6, exact=True).where("asset_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))  # six rows a query
    hits = near.withColumn("r", rank).where("r <= 5").join(own, "asset_id").join(own.select(F.col("asset_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return hits.groupBy("query_id").agg(F.bool_or(F.col("label") == F.col("own")).alias("hit")).agg(F.round(F.avg(F.col("hit").cast("int")), 6).alias("accuracy"))


@query(with_tables("vec", "SELECT DISTINCT asset_id AS query_id, true AS enough FROM vec WHERE asset_id % 50 = 0"))
def vector_lists_recall(spark, d):
    """Every query with whether the search of a few lists, as measured when they were built, finds nine tenths of the true neighbours of all queries."""
    lists, asked = _lists(spark, d, tries=64)
    share = vector_lists.recall_at(vector_lists.search(spark, lists, asked), vector_lists.search(spark, lists, asked, exact=True))
    return asked.select("query_id").distinct().withColumn("enough", F.lit(share >= 0.9))


@query(
    with_tables("vec", "").rstrip()
    + """, x AS (SELECT asset_id // 16 AS library, asset_id % 16 AS label FROM vec), o AS (SELECT library, max(label + 100) AS top FROM x WHERE label % 5 <> 0 GROUP BY 1)
SELECT x.library, label, label + 100 AS identity, 1.0::DOUBLE AS score FROM x WHERE label % 5 <> 0
UNION ALL SELECT x.library, label, coalesce(top, -1) + row_number() OVER (PARTITION BY x.library ORDER BY label), NULL FROM x LEFT JOIN o ON o.library = x.library WHERE label % 5 = 0"""
)
def identities_carried(spark, d):
    """New clusters of many libraries as identities of the ones before: those that stayed keep theirs, new ones come after."""
    k = F.col("asset_id")
    new = C.asset_vec(spark, d).select(F.expr("asset_id div 16").alias("library"), (k % 16).alias("label"), "vec")
    old = new.where("label % 5 <> 0").select("library", (F.col("label") + 100).alias("identity"), "vec")
    return reassigned(new, old, "library", 0.55).withColumn("score", F.round("score", 4))


@query()
def merge_centroids(spark, d):
    """Clusters of identities whose centroids are near take the smallest id."""
    vecs = C.asset_vec(spark, d)
    found = A.vector_clusters(vecs, **FACES).where("cluster is not null").join(vecs.select(F.col("asset_id").alias("id"), "vec"), "id")
    return A.merged_clusters(A.centroids(found, "cluster"), "cluster", 0.6)


@query(
    with_tables("vec", "").rstrip()
    + """, c AS (SELECT label, asset_id % 10 AS f, count(*) AS n FROM vec GROUP BY 1, 2), t AS (SELECT sum(n * (n - 1) / 2) AS tp FROM c),
g AS (SELECT sum(n * (n - 1) / 2) AS got FROM (SELECT sum(n) AS n FROM c GROUP BY f)), r AS (SELECT sum(n * (n - 1) / 2) AS re FROM (SELECT sum(n) AS n FROM c GROUP BY label))
SELECT CAST(tp AS DOUBLE) AS tp, CAST(got - tp AS DOUBLE) AS fp, CAST(re - tp AS DOUBLE) AS fn, round(tp / got, 6) AS "precision", round(tp / re, 6) AS recall, round(2 * (tp / got) * (tp / re) / (tp / got + tp / re), 6) AS f1 FROM t, g, r"""
)
def pairwise_f1(spark, d):
    out = A.pairwise_f1(C.asset_vec(spark, d).withColumn("found", F.col("asset_id") % 10), "label", "found")
    return out.select("tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(
    "SELECT round(avg(CAST(list_contains(top, label) AS INT)), 6) AS accuracy FROM (SELECT label, [vec_id % 10, (vec_id + 3) % 10, (vec_id + 5) % 10] AS top FROM embeddings)"
)
def topk_accuracy(spark, d):
    k = F.col("asset_id")
    top = F.array(k % 10, (k + 3) % 10, (k + 5) % 10)
    return C.asset_vec(spark, d).agg(F.round(F.avg(F.array_contains(top, F.col("label").cast("long")).cast("int")), 6).alias("accuracy"))


GRAY = "list_transform(range(72), lambda i: (o_orderkey * (i + 3) * 7919) % 251)"


@query(
    f"""WITH g AS (SELECT o_orderkey AS id, {GRAY} AS gray FROM orders), b AS (SELECT id, list_transform(list_filter(range(72), lambda i: i % 9 < 8), lambda i: CAST(gray[i + 1] > gray[i + 2] AS HUGEINT)) AS bits FROM g),
h AS (SELECT id, list_reduce(list_prepend(0::HUGEINT, bits), lambda s, x: s * 2 + x) AS u FROM b)
SELECT id, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS hash FROM h"""
)
def dhash(spark, d):
    """Difference hashes of small rasters that come from the order numbers."""
    gray = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: (F.col("o_orderkey") * (i + 3) * 7919) % 251)
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), S.difference_hash(gray).alias("hash"))


BOX = ("l_quantity", "l_discount * 100", "l_quantity + 10 + l_linenumber", "l_discount * 100 + 8")


def _boxes(spark, d):
    x1, y1, x2, y2 = (F.expr(e) for e in BOX)
    box = F.struct((-F.col("l_extendedprice")).alias("s"), F.col("l_partkey").alias("k"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(box)).alias("boxes"))


@query(
    f"""SELECT a.l_orderkey AS id, round(sum(w * h / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - w * h)), 6) AS total FROM
(SELECT *, {BOX[0]} AS x1, {BOX[1]} AS y1, {BOX[2]} AS x2, {BOX[3]} AS y2 FROM lineitem) a JOIN (SELECT *, {BOX[0]} AS x1, {BOX[1]} AS y1, {BOX[2]} AS x2, {BOX[3]} AS y2 FROM lineitem) b ON a.l_orderkey = b.l_orderkey,
LATERAL (SELECT greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0.0) AS w, greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0.0) AS h) GROUP BY 1"""
)
def iou_pairs(spark, d):
    """Sum of overlaps over all pairs of boxes of a picture (a picture has few boxes)."""
    b = _boxes(spark, d)
    each = F.aggregate("boxes", F.lit(0.0), lambda s, x: s + F.aggregate("boxes", F.lit(0.0), lambda t, y: t + S.iou(x, y)))
    return b.select(F.col("l_orderkey").alias("id"), F.round(each, 6).alias("total"))


@query(
    f"""WITH RECURSIVE g AS (SELECT l_orderkey AS id, list({{'s': -l_extendedprice, 'k': l_partkey, 'x1': {BOX[0]}, 'y1': {BOX[1]}, 'x2': {BOX[2]}, 'y2': {BOX[3]}}} ORDER BY -l_extendedprice, l_partkey, {BOX[0]}, {BOX[1]}, {BOX[2]}, {BOX[3]}) AS boxes FROM lineitem GROUP BY 1),
r AS (SELECT id, boxes, 0 AS i, boxes[1:0] AS kept FROM g UNION ALL SELECT id, boxes, i + 1, CASE WHEN len(list_filter(kept, lambda a: greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)
  > 0.4 * ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)))) > 0 THEN kept ELSE list_append(kept, b) END
  FROM (SELECT *, boxes[i + 1] AS b FROM r WHERE i < len(boxes)))
SELECT id, CAST(len(boxes) AS INT) AS n, CAST(len(kept) AS INT) AS n_kept, array_to_string(list_transform(kept, lambda b: CAST(b.k AS VARCHAR)), ',') AS kept FROM r WHERE i = len(boxes)"""
)
def nms(spark, d):
    """Boxes left after greedy suppression, best price first."""
    kept = S.suppressed(F.col("boxes"), 0.4)
    return _boxes(spark, d).select(F.col("l_orderkey").alias("id"), F.size("boxes").alias("n"), F.size(kept).alias("n_kept"), F.array_join(F.transform(kept, lambda b: b["k"].cast("string")), ",").alias("kept"))


@query("SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS k, round(640.0 / greatest(l_quantity * 10, l_extendedprice), 8) AS scale, round((640.0 - l_quantity * 10 * (640.0 / greatest(l_quantity * 10, l_extendedprice))) / 2, 6) AS pad_x, round((640.0 - l_extendedprice * (640.0 / greatest(l_quantity * 10, l_extendedprice))) / 2, 6) AS pad_y FROM lineitem")
def letterbox(spark, d):
    box = S.letterbox(F.col("l_quantity") * 10, F.col("l_extendedprice"), 640)
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"), F.round(box["scale"], 8).alias("scale"), F.round(box["pad_x"], 6).alias("pad_x"), F.round(box["pad_y"], 6).alias("pad_y"))


@query(with_tables("asset face", """SELECT person_id, year(DATE '1970-01-01' + CAST(day AS INT)) AS year, string_agg(DISTINCT CAST(asset_id AS VARCHAR), ',' ORDER BY CAST(asset_id AS VARCHAR)) AS ids
FROM face JOIN asset ON id = asset_id WHERE person_id IS NOT NULL AND day IS NOT NULL AND year(DATE '1970-01-01' + CAST(day AS INT)) < 2002 GROUP BY 1, 2 HAVING count(DISTINCT asset_id) >= 3"""))
def person_year_assets(spark, d):
    """What the memory of a person's year shows: its assets, one list a card."""
    f = C.face(spark, d)
    met = A.person_assets(f, C.asset(spark, d), TODAY).repartition(A.parts_for(f), "person_id", "year")
    cards = met.groupBy("person_id", "year").agg(F.collect_list(F.col("asset_id").cast("string")).alias("ids")).where(F.size("ids") >= 3)
    return cards.select("person_id", "year", F.array_join(F.array_sort("ids"), ",").alias("ids"))


@query(with_tables("vec", "SELECT label AS cluster, count(*) AS n, min(asset_id) AS first_id FROM vec GROUP BY 1"))
def clusters_by_size(spark, d):
    """Clusters, the largest first."""
    by = C.asset_vec(spark, d).groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("n"), F.min("asset_id").alias("first_id"))
    return by.orderBy(F.col("n").desc(), "first_id")


@query(with_tables("vec", "SELECT asset_id, label AS cluster, CASE WHEN asset_id % 4 = 0 THEN 'new' ELSE 'old' END AS model FROM vec WHERE asset_id % 3 <> 0 OR asset_id % 4 = 0"))
def vectors_upserted(spark, d):
    """Vectors of an older model with those of a newer one written over them by asset."""
    from lumora.operators import library as L

    v = C.asset_vec(spark, d).select("asset_id", F.col("label").alias("cluster"))
    old = v.where("asset_id % 3 <> 0").withColumns({"model": F.lit("old"), "at": F.lit(1)})
    new = v.where("asset_id % 4 = 0").withColumns({"model": F.lit("new"), "at": F.lit(2), "op": F.lit("upsert")})
    return L.merge_latest(old, new, ["asset_id"], "at").select("asset_id", "cluster", "model")

"""Queries of text search, ingest, sidecars and scalar functions over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumora.functions import scalars as S
from lumora.operators import ingest as I
from lumora.operators import text_index as T
from lumora.plans.book import query
from lumora.session import load, shared_dir

KEY = "demo-key"
TOKENS = r"list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')))"


@query(f"SELECT doc_id, len({TOKENS}) AS n, array_to_string({TOKENS}, ' ') AS tokens FROM documents")
def text_tokens(spark, d):
    t = S.tokenize(F.col("text"))
    return load(spark, d, "documents").select("doc_id", F.size(t).alias("n"), F.array_join(t, " ").alias("tokens"))


@query(f"SELECT substr(sha256('{KEY}' || 'tok' || chr(31) || word), 1, 32) AS token, count(*) AS n FROM (SELECT unnest({TOKENS}) AS word FROM documents) GROUP BY 1")
def blind_tokens(spark, d):
    return T.token_index(load(spark, d, "documents"), KEY, "doc_id").groupBy("token").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id AS id FROM documents WHERE list_has_all({TOKENS}, ['the', 'of', 'idiot'])")
def text_search_and(spark, d):
    return T.and_search(T.token_index(load(spark, d, "documents"), KEY, "doc_id"), "The idiot, OF", KEY, None)


@query(f"SELECT doc_id AS id FROM documents WHERE list_has_all({TOKENS}, ['der', 'die']) ORDER BY 1 LIMIT 100")
def text_search_limited(spark, d):
    return T.and_search(T.token_index(load(spark, d, "documents"), KEY, "doc_id"), "der DIE", KEY, 100)


def _stored_index(spark, d):
    """The stored index of all texts, in which every tenth asset was indexed anew by its recognised lines, and every hundredth by none."""
    path = f"{shared_dir(spark)}/lumora-index-{uuid.uuid4().hex}"
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    T.store(docs, KEY, path)
    line = lambda t: F.struct(t.alias("text"), F.array(F.lit(0)).alias("bbox"), F.lit(0.9).alias("conf"))
    lines = F.when(F.col("id") % 100 != 3, F.to_json(F.array(line(F.concat(F.lit("Scan, "), "lang")), line(F.concat(F.lit("of "), "source"))))).otherwise("broken")
    T.store_lines(docs.where("id % 10 = 3").select("id", lines.alias("lines")), KEY, path, 1)
    return path


@query(f"SELECT doc_id AS id FROM documents WHERE doc_id % 10 <> 3 AND list_has_all({TOKENS}, ['the', 'of'])")
def text_search_stored(spark, d):
    """A search of the stored index: assets that were indexed anew are found by their new tokens only."""
    return T.search_stored(spark, _stored_index(spark, d), "OF the", KEY, None)


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 10 = 3 AND doc_id % 100 <> 3 AND lang = 'fr' ORDER BY 1 LIMIT 100")
def text_search_lines(spark, d):
    """Assets found by the words of different recognised lines."""
    return T.search_stored(spark, _stored_index(spark, d), "scan of FR", KEY)


@query(f"WITH x AS (SELECT doc_id AS id, unnest({TOKENS}) AS w FROM documents WHERE doc_id % 10 <> 3 UNION ALL SELECT doc_id, unnest({TOKENS.replace('lower(text)', 'lower(html)')}) FROM (SELECT page_id AS doc_id, html FROM pages WHERE page_id % 10 = 3)) SELECT id, count(DISTINCT w) AS n FROM x GROUP BY 1")
def text_index_reindexed(spark, d):
    """The keyed index after every tenth text was replaced by a page: the old tokens go, the new ones come."""
    index = T.token_index(load(spark, d, "documents"), KEY, "doc_id")
    changed = load(spark, d, "pages").where("page_id % 10 = 3").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    gone = load(spark, d, "documents").where("doc_id % 10 = 3").select(F.col("doc_id").alias("id"))
    return T.token_counts(T.reindexed(T.without(index, gone), changed, KEY))


@query("SELECT doc_id AS id FROM documents WHERE 1 = 0")
def text_search_empty(spark, d):
    return T.and_search(T.token_index(load(spark, d, "documents"), KEY, "doc_id"), " !? ", KEY)


PATH = "'/dump/' || (100 + user_id % 9) || 'APPLE/' || CASE event_type WHEN 'click' THEN 'IMG_' || lpad(CAST(event_id // 3 AS VARCHAR), 4, '0') || '.HEIC' WHEN 'view' THEN 'IMG_' || lpad(CAST(event_id // 3 AS VARCHAR), 4, '0') || '.MOV' WHEN 'purchase' THEN 'Screenshots/shot' || event_id || '.png' ELSE '.hidden' || event_id || '.txt' END"


def _paths(spark, d):
    e, k = load(spark, d, "events"), F.col("event_type")
    n = F.lpad(F.expr("cast(event_id div 3 as string)"), 4, "0")
    name = (
        F.when(k == "click", F.concat(F.lit("IMG_"), n, F.lit(".HEIC")))
        .when(k == "view", F.concat(F.lit("IMG_"), n, F.lit(".MOV")))
        .when(k == "purchase", F.concat(F.lit("Screenshots/shot"), F.col("event_id").cast("string"), F.lit(".png")))
        .otherwise(F.concat(F.lit(".hidden"), F.col("event_id").cast("string"), F.lit(".txt")))
    )
    return e.select("event_id", F.concat(F.lit("/dump/"), (F.col("user_id") % 9 + 100).cast("string"), F.lit("APPLE/"), name).alias("path"))


@query(
    f"""WITH p AS (SELECT event_id, {PATH} AS path FROM events)
SELECT event_id, path, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext, event_type <> 'x' AND path NOT LIKE '%.txt' AS candidate, path LIKE '%/Screenshots/%' AS screenshot FROM p JOIN events USING (event_id)"""
)
def file_candidates(spark, d):
    p = F.col("path")
    return _paths(spark, d).select("event_id", "path", S.extension(p).alias("ext"), I.is_candidate(p).alias("candidate"), I.is_screenshot(p).alias("screenshot"))


@query(
    f"""WITH p AS (SELECT DISTINCT {PATH} AS path FROM events), q AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '([^/]*?)(\\.[^./]*)?$', 1) AS stem FROM p)
SELECT folder, stem, min(path) FILTER (path LIKE '%.HEIC') AS still, min(path) FILTER (path LIKE '%.MOV') AS motion FROM q GROUP BY 1, 2
HAVING count(*) FILTER (path LIKE '%.HEIC') > 0 AND count(*) FILTER (path LIKE '%.MOV') > 0"""
)
def pairs_live(spark, d):
    return I.sibling_pairs(_paths(spark, d).select("path").distinct()).where("motion is not null").select("folder", "stem", "still", "motion")


@query(
    """WITH p AS (SELECT DISTINCT '/b/' || (l_suppkey % 5) || '/IMG_' || CASE WHEN l_linenumber = 1 THEN 'E' ELSE '' END || l_orderkey || CASE WHEN l_linenumber = 2 THEN '.JPG' WHEN l_linenumber = 6 THEN '.png' ELSE '.heic' END AS path FROM lineitem),
q AS (SELECT path, regexp_extract(path, 'IMG_E?([0-9]+)', 1) AS number FROM p WHERE path NOT LIKE '%.png')
SELECT number, count(*) AS n FROM q GROUP BY 1 HAVING count(*) >= 3 OR (count(*) > 1 AND bool_or(path LIKE '%IMG_E%'))"""
)
def bursts(spark, d):
    n = F.col("l_linenumber")
    path = F.concat(
        F.lit("/b/"), (F.col("l_suppkey") % 5).cast("string"), F.lit("/IMG_"), F.when(n == 1, "E").otherwise(""), F.col("l_orderkey").cast("string"), F.when(n == 2, ".JPG").when(n == 6, ".png").otherwise(".heic")
    )
    return I.bursts(load(spark, d, "lineitem").select(path.alias("path")).distinct()).select("number", "n")


EXTENSIONS = "jpg JPEG png heic heif webp bmp gif tif tiff mp4 mov m4v mkv webm cr2 cr3 nef arw dng raf orf rw2 avif txt svg".split()
EXT_SQL = "['" + "', '".join(EXTENSIONS) + "']"


@query(
    f"""WITH p AS (SELECT event_id, '/a/' || CASE WHEN event_id % 31 = 0 THEN '.' ELSE '' END || 'f' || event_id || '.' || {EXT_SQL}[1 + event_id % {len(EXTENSIONS)}] AS path, lower({EXT_SQL}[1 + event_id % {len(EXTENSIONS)}]) AS ext FROM events)
SELECT event_id, event_id % 31 <> 0 AND ext NOT IN ('avif', 'txt', 'svg') AS candidate, ext IN ('cr2', 'cr3', 'nef', 'arw', 'dng', 'raf', 'orf', 'rw2') AS raw,
CASE WHEN ext IN ('jpg', 'jpeg') THEN 'image/jpeg' WHEN ext IN ('png', 'gif', 'webp') THEN 'image/' || ext WHEN ext IN ('heic', 'heif') THEN 'image/heic' WHEN ext IN ('tif', 'tiff') THEN 'image/tiff'
WHEN ext IN ('mp4', 'm4v') THEN 'video/mp4' WHEN ext = 'mov' THEN 'video/quicktime' WHEN ext = 'mkv' THEN 'video/x-matroska' WHEN ext = 'webm' THEN 'video/webm' ELSE 'application/octet-stream' END AS mime FROM p"""
)
def file_kinds(spark, d):
    """Every extension: taken in or not, raw or not, and its media type."""
    ext = F.get(F.array(*map(F.lit, EXTENSIONS)), (F.col("event_id") % len(EXTENSIONS)).cast("int"))
    path = F.concat(F.lit("/a/"), F.when(F.col("event_id") % 31 == 0, ".").otherwise(""), F.lit("f"), F.col("event_id").cast("string"), F.lit("."), ext)
    e = load(spark, d, "events").select("event_id", path.alias("path"))
    p = F.col("path")
    return e.select("event_id", I.is_candidate(p).alias("candidate"), I.is_raw(p).alias("raw"), I.mime_by_extension(p).alias("mime"))


@query("SELECT count(*) AS n, sum(strlen(text)) AS bytes FROM documents")
def scan_totals(spark, d):
    """Files of a scan and their bytes."""
    return load(spark, d, "documents").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


@query(
    """SELECT doc_id, '/m/' || doc_id || '.jpg.xmp' AS side, CASE WHEN doc_id % 3 = 0 THEN nullif(trim(split_part(text, chr(10), 1)), '') END AS title, doc_id % 3 = 0 AS has_xmp FROM documents"""
)
def sidecar_beside(spark, d):
    """The XMP that lies beside a file, found by its path and read."""
    docs = load(spark, d, "documents").select("doc_id", F.concat(F.lit("/m/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"), F.trim(F.split("text", "\n")[0]).alias("t"))
    none = F.lit(None).cast("string")
    files = docs.where("doc_id % 3 = 0").select(I.sidecar_path(F.col("path")).alias("path"), I.render_sidecar(F.col("t"), none, F.array().cast("array<string>")).alias("text"))
    out = I.with_sidecar(docs, files).withColumn("s", I.sidecar(F.col("xmp")))
    return out.select("doc_id", I.sidecar_path(F.col("path")).alias("side"), F.col("s.title").alias("title"), F.col("xmp").isNotNull().alias("has_xmp"))


@query("SELECT event_id, '{\"mime\":\"' || event_type || '\",\"exif\":{\"user\":' || user_id || '}' || CASE WHEN event_id % 2 = 0 THEN ',\"sidecar\":{\"id\":' || event_id || '}' ELSE '' END || '}' AS record FROM events")
def exif_records(spark, d):
    e = load(spark, d, "events")
    side = F.when(F.col("event_id") % 2 == 0, F.struct(F.col("event_id").alias("id")))
    return e.select("event_id", I.merged_record(F.col("event_type"), F.struct(F.col("user_id").alias("user")), side).alias("record"))


@query("SELECT event_id, event_type AS a, CAST(user_id AS VARCHAR) AS b, nullif(CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END, '') AS device FROM events")
def exif_display(spark, d):
    """Fields as a map by `ifd::tag`, the last of equal keys, and a quoted device name."""
    field = lambda ifd, tag, v: F.struct(F.lit(ifd).alias("ifd"), F.lit(tag).alias("tag"), v.alias("value"))
    fields = F.array(field(0, "Model", F.lit("old")), field(1, "Lens", F.col("user_id").cast("string")), field(0, "Model", F.col("event_type")))
    shown = I.display_values(fields)
    quoted = F.concat(F.lit('"'), F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type")), F.lit('"'))
    e = load(spark, d, "events").select("event_id", shown.alias("m"), I.unquoted(quoted).alias("device"))
    return e.select("event_id", F.col("m")["0::Model"].alias("a"), F.col("m")["1::Lens"].alias("b"), "device")


@query("SELECT o_orderkey AS id, substr(sha256('demo-keypath' || chr(31) || '/p/' || o_orderkey), 1, 32) AS path_key FROM orders")
def path_keys(spark, d):
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), I.path_key(F.concat(F.lit("/p/"), F.col("o_orderkey").cast("string")), KEY).alias("path_key"))


@query("SELECT count(*) AS n, count(*) FILTER (doc_id % 13 <> 0) AS whole FROM documents")
def stored_blobs_verified(spark, d):
    """Stored contents read again; every thirteenth was damaged after its key was taken."""
    docs = load(spark, d, "documents").select(I.content_key(F.col("text")).alias("hash"), F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("content"))
    return I.verified(docs).agg(F.count("*").alias("n"), F.count_if("whole").alias("whole"))


@query(
    """WITH s AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey % 4000 + 1 AS w, l_suppkey % 3000 + 1 AS h FROM lineitem)
SELECT id, line, w, h, CAST(greatest(round(w * least(1.0, 1024.0::DOUBLE / greatest(w, h))), 1) AS INT) AS tw, CAST(greatest(round(h * least(1.0, 1024.0::DOUBLE / greatest(w, h))), 1) AS INT) AS th FROM s"""
)
def thumbnail_sizes(spark, d):
    x = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 4000 + 1).alias("w"), (F.col("l_suppkey") % 3000 + 1).alias("h"))
    x = x.withColumn("t", I.thumbnail_size(F.col("w"), F.col("h"), 1024))
    return x.select("id", "line", "w", "h", F.col("t.width").alias("tw"), F.col("t.height").alias("th"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'cached' || doc_id ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 5 = 0 OR sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 7 = 0)")
def announced_blobs(spark, d):
    docs = load(spark, d, "documents")
    cached = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("cached"), F.col("doc_id").cast("string")))
    assets = docs.select(F.col("doc_id").alias("id"), cached.alias("cached"), F.col("text").alias("content"))
    return I.announced(assets, docs.where("doc_id % 7 = 0").select(I.content_key(F.col("text")).alias("hash")))


@query(
    """WITH p AS (SELECT DISTINCT '/r/' || (o_custkey % 7) || '/DSC' || (o_orderkey // 3) || CASE o_orderkey % 3 WHEN 0 THEN '.NEF' WHEN 1 THEN '.jpg' ELSE '.mov' END AS path FROM orders),
q AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '([^/]*?)(\\.[^./]*)?$', 1) AS stem FROM p)
SELECT folder, stem, min(path) FILTER (path LIKE '%.jpg') AS still, min(path) FILTER (path LIKE '%.mov') AS motion, min(path) FILTER (path LIKE '%.NEF') AS raw FROM q GROUP BY 1, 2
HAVING count(*) FILTER (path LIKE '%.jpg') > 0 AND count(*) FILTER (path NOT LIKE '%.jpg') > 0"""
)
def pairs_raw(spark, d):
    """Stills with the raw file or the clip of the same folder and stem."""
    k = F.col("o_orderkey")
    ext = F.when(k % 3 == 0, ".NEF").when(k % 3 == 1, ".jpg").otherwise(".mov")
    path = F.concat(F.lit("/r/"), (F.col("o_custkey") % 7).cast("string"), F.lit("/DSC"), F.expr("cast(o_orderkey div 3 as string)"), ext)
    return I.sibling_pairs(load(spark, d, "orders").select(path.alias("path")).distinct())


@query("SELECT hash, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT sha256(text) AS hash, doc_id FROM documents) GROUP BY 1")
def dedupe_by_hash(spark, d):
    docs = load(spark, d, "documents").select(I.content_key(F.col("text")).alias("hash"), "doc_id")
    return docs.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    """WITH t AS (SELECT sha256(text) AS hash, source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, doc_id FROM documents), old AS (SELECT hash FROM t WHERE doc_id % 3 = 0),
new AS (SELECT hash, min(path) AS path FROM t WHERE doc_id % 3 <> 0 GROUP BY 1) SELECT hash, path FROM new WHERE hash NOT IN (SELECT hash FROM old)"""
)
def insert_if_new(spark, d):
    """Contents of two thirds of the texts that the other third does not hold, by their first path."""
    path = F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    t = load(spark, d, "documents").select(I.content_key(F.col("text")).alias("hash"), path.alias("path"), "doc_id")
    return I.new_contents(t.where("doc_id % 3 = 0"), t.where("doc_id % 3 <> 0").select("hash", "path"))


@query(
    """WITH t AS (SELECT CASE WHEN doc_id % 41 = 0 THEN NULL ELSE sha256(text) END AS hash, doc_id FROM documents), old AS (SELECT hash FROM t WHERE doc_id % 3 = 0 AND hash IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS r FROM t WHERE doc_id % 3 <> 0)
SELECT CASE WHEN hash IS NULL THEN 'skipped' WHEN r > 1 OR hash IN (SELECT hash FROM old) THEN 'deduped' ELSE 'inserted' END AS outcome, count(*) AS n FROM n GROUP BY 1"""
)
def ingest_report(spark, d):
    hash_ = F.when(F.col("doc_id") % 41 != 0, I.content_key(F.col("text")))
    t = load(spark, d, "documents").select(hash_.alias("hash"), F.col("doc_id").alias("path"))
    return I.ingest_report(t.where("path % 3 = 0 and hash is not null"), t.where("path % 3 <> 0"))


@query("WITH s AS (SELECT DISTINCT sha256(text) AS hash, length(text) AS bytes FROM documents) SELECT count(*) AS n, sum(bytes) AS bytes FROM s WHERE hash NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 <> 0)")
def gc_orphans(spark, d):
    docs = load(spark, d, "documents")
    stored = docs.select(I.content_key(F.col("text")).alias("hash"), F.length("text").alias("bytes")).distinct()
    live = docs.where("doc_id % 4 <> 0").select(I.content_key(F.col("text")).alias("hash"))
    return I.orphans(stored, live).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("SELECT doc_id, CASE WHEN r = 0 THEN source || '.jpg' ELSE source || '-' || r || '.jpg' END AS out_name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents)")
def export_name_collisions(spark, d):
    rows = load(spark, d, "documents").select("doc_id", F.concat("source", F.lit(".jpg")).alias("name"))
    return I.export_names(rows, "name", "doc_id").select("doc_id", "out_name")


@query(r"SELECT page_id, nullif(trim(regexp_extract(html, '<title(?:\s[^>]*)?>(.*?)</title>', 1, 's')), '') AS title FROM pages")
def sidecar_simple(spark, d):
    return load(spark, d, "pages").select("page_id", S.between_tags(F.col("html"), "title").alias("title"))


@query("SELECT page_id, nullif(regexp_extract(html, '\\bhref\\s*=\\s*\"([^\"]*)\"', 1), '') AS href, nullif(regexp_extract(html, '\\blang\\s*=\\s*\"([^\"]*)\"', 1), '') AS lang FROM pages")
def sidecar_attribute(spark, d):
    h = F.col("html")
    return load(spark, d, "pages").select("page_id", S.attribute(h, "href").alias("href"), S.attribute(h, "lang").alias("lang"))


@query(r"SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<li(?:\s[^>]*)?>(.*?)</li>', 1, 's'), lambda x: trim(x)), '|') AS items FROM pages")
def sidecar_bag(spark, d):
    return load(spark, d, "pages").select("page_id", F.array_join(S.items(F.col("html"), "li"), "|").alias("items"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', '''') AS plain FROM pages")
def xml_decode(spark, d):
    return load(spark, d, "pages").select("page_id", S.decode_entities(F.col("html")).alias("plain"))


@query()
def sidecar_round_trip(spark, d):
    """Titles and first lines of texts rendered as sidecars and read back."""
    lines = F.split("text", "\n")
    docs = load(spark, d, "documents").select("doc_id", F.trim(lines[0]).alias("t"), F.slice(F.split("text", " "), 1, 3).alias("tags"))
    body = I.render_sidecar(F.col("t"), F.col("doc_id").cast("string"), F.col("tags"))
    read = docs.withColumn("s", I.sidecar(body))
    return read.select("doc_id", (F.col("s.title").eqNullSafe(F.nullif("t", F.lit("")))).alias("same_title"), (F.col("s.description") == F.col("doc_id").cast("string")).alias("same_id"), F.size("s.tags").alias("n_tags"))


@query("SELECT event_id, round(k + (event_id % 6000) / 100.0 / 60, 6) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS degrees FROM (SELECT event_id, CAST(props->>'k' AS INT) AS k FROM events)")
def gps_parse(spark, d):
    k = F.from_json("props", "k int")["k"]
    text = F.concat(k.cast("string"), F.lit(","), F.format_string("%.2f", (F.col("event_id") % 6000) / 100), F.when(F.col("event_id") % 2 == 0, "N").otherwise("S"))
    return load(spark, d, "events").select("event_id", F.round(S.parse_gps(text), 6).alias("degrees"))


@query("SELECT o_orderkey AS id, printf('%d,%.4f%s', CAST(floor(abs(x)) AS INT), (abs(x) - floor(abs(x))) * 60, CASE WHEN x < 0 THEN 'W' ELSE 'E' END) AS gps FROM (SELECT o_orderkey, (o_orderkey % 2880 - 1440) / 8.0 AS x FROM orders)")
def gps_format(spark, d):
    x = (F.col("o_orderkey") % 2880 - 1440) / 8.0
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), S.format_gps(x, "E", "W").alias("gps"))


@query("SELECT event_id, CAST(props->>'k' AS DOUBLE) AS lat, CAST(event_id % 360 AS DOUBLE) AS lon FROM events WHERE event_id % 5 <> 0")
def json_positions(spark, d):
    """Positions from JSON; a missing half drops the row."""
    lon = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit(', "lon": '), (F.col("event_id") % 360).cast("string"))).otherwise("")
    k = F.from_json("props", "k int")["k"].cast("string")
    p = F.from_json(F.concat(F.lit('{"lat": '), k, lon, F.lit("}")), "lat double, lon double, alt double")
    rows = load(spark, d, "events").withColumn("p", p).where("p.lat is not null and p.lon is not null")
    return rows.select("event_id", "p.lat", "p.lon")


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) * 86400 AS taken, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 90 AS DOUBLE) END AS lat FROM events")
def takeout_fields(spark, d):
    k = F.from_json("props", "k long")["k"]
    lat = F.when(F.col("event_id") % 3 == 0, 0.0).otherwise((F.col("event_id") % 90).cast("double"))
    lon = F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.lit(5.0))
    json = F.to_json(F.struct(F.lit("t").alias("title"), F.struct((k * 86400).cast("string").alias("timestamp")).alias("photoTakenTime"), F.struct(lat.alias("latitude"), lon.alias("longitude")).alias("geoData")))
    return load(spark, d, "events").withColumn("x", I.takeout(json)).select("event_id", F.unix_timestamp("x.taken").alias("taken"), F.col("x.lat").alias("lat"))


@query("SELECT event_id, CAST(trunc(epoch(ts) / 86400.0) AS BIGINT) AS day FROM events")
def day_truncation(spark, d):
    return load(spark, d, "events").select("event_id", S.epoch_day(F.col("ts")).alias("day"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN e = s THEN strftime(s, '%b %-d, %Y') WHEN year(s) = year(e) THEN strftime(s, '%b %-d') || ' → ' || strftime(e, '%b %-d, %Y')
ELSE strftime(s, '%b %-d, %Y') || ' → ' || strftime(e, '%b %-d, %Y') END AS label FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS e FROM orders)"""
)
def range_label(spark, d):
    s = F.to_date("o_orderdate")
    e = F.date_add(s, (F.col("o_orderkey") % 40).cast("int"))
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), S.range_label(s, e).alias("label"))


@query("SELECT n, CASE WHEN n <= 1 THEN 18.0 WHEN n < 10 THEN 36.0 ELSE round(least(56.0, 36 + 8 * log10(n)), 6) END AS size FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def marker_sizes(spark, d):
    n = load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.select("n", F.round(S.marker_size(F.col("n")), 6).alias("size"))

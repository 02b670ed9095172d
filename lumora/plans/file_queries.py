"""Queries of file contents: EXIF from bytes, stored and exported files, ingest end to end."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lumora.operators import ingest as I
from lumora.operators import ingest_run
from lumora.plans.book import query
from lumora.session import load, shared_dir
from lumora.sources import catalogue as C
from lumora.sources import exif, files
from lumora.sources.catalogue import with_tables


@F.pandas_udf(BinaryType())
def _pictures(p: pd.DataFrame) -> pd.Series:
    def one(r) -> bytes:
        at = None if pd.isna(r.lat) else (r.lat, r.lon)
        out = exif.written(r.device, r.lens, r.taken, r.original, *(at or (None, None)), alt=r.alt if at else None, size=(int(r.w), int(r.h)) if r.sized else None, own_size=(640, 480) if r.framed else None, big=bool(r.big))
        return out[:20] if r.broken else out

    return pd.Series([one(r) for r in p.itertuples(index=False)])


def _photos(spark, d):
    """Every asset as a small JPEG with EXIF; a few are cut off."""
    k = F.col("id")
    rows = C.asset(spark, d).select("id", "day", "device", "lens").join(C.geo(spark, d).select(F.col("asset_id").alias("id"), "lat", "lon"), "id")
    date = lambda p: F.date_format(F.date_from_unix_date(F.col("day").cast("int")), p)
    parts = {
        "device": F.col("device"), "lens": F.when(k % 7 == 0, "").otherwise(F.col("lens")), "taken": date("yyyy:MM:dd 00:00:00"), "original": F.when(k % 3 != 0, date("yyyy-MM-dd 01:00:00")), "lat": F.col("lat"), "lon": F.col("lon"),
        "alt": (k % 1000) / 4, "sized": k % 2 == 0, "framed": k % 5 == 0, "w": k % 500 + 10, "h": k % 300 + 20, "big": k % 4 == 0, "broken": k % 13 == 0,
    }
    return rows.select("id", _pictures(F.struct(*(c.alias(n) for n, c in parts.items()))).alias("content"))


@query(
    with_tables(
        "asset geo",
        """SELECT a.id, CASE WHEN ok THEN device END AS device, CASE WHEN ok AND a.id % 7 <> 0 THEN lens END AS lens, CASE WHEN ok THEN CASE WHEN a.id % 5 = 0 THEN 640 WHEN a.id % 2 = 0 THEN a.id % 500 + 10 END END AS width,
CASE WHEN ok THEN CASE WHEN a.id % 5 = 0 THEN 480 WHEN a.id % 2 = 0 THEN a.id % 300 + 20 END END AS height, CASE WHEN ok THEN CAST(DATE '1970-01-01' + CAST(a.day AS INT) AS TIMESTAMP) + CASE WHEN a.id % 3 <> 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END END AS taken,
CASE WHEN ok THEN round(lat, 5) END AS lat, CASE WHEN ok THEN round(lon, 5) END AS lon, CASE WHEN ok AND lat IS NOT NULL THEN a.id % 1000 / 4.0::DOUBLE END AS alt FROM (SELECT *, id % 13 <> 0 AS ok FROM asset) a JOIN geo g ON g.asset_id = a.id""",
    )
)
def exif_probe(spark, d):
    """What EXIF says about each picture, out of its bytes."""
    x = F.col("exif")
    out = exif.probed(_photos(spark, d))
    return out.select("id", *(x[c].alias(c) for c in ("device", "lens", "width", "height", "taken")), F.round(x["lat"], 5).alias("lat"), F.round(x["lon"], 5).alias("lon"), x["alt"].alias("alt"))


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/lumora-files-{uuid.uuid4().hex}"


@query(
    """WITH c AS (SELECT count(DISTINCT text) AS d, count(text) AS n, count(*) FILTER (text IS NULL) AS f, (SELECT sum(strlen(t)) FROM (SELECT DISTINCT text AS t FROM documents)) AS b FROM documents)
SELECT 0 AS run, d AS inserted, n - d AS deduped, f AS failed, CAST(b AS BIGINT) AS bytes FROM c UNION ALL SELECT 1, 0, n, f, 0 FROM c"""
)
def stored_contents(spark, d):
    """Texts kept by content, written twice: the second run finds all of them there."""
    folder = _folder(spark)
    for _ in range(2):
        files.store(load(spark, d, "documents").select(F.col("text").cast("binary").alias("content")), folder)
    return files.reports(spark, folder)


@query(
    """WITH n AS (SELECT doc_id, text, lang, source || CASE WHEN r > 0 THEN '-' || r ELSE '' END || '.jpg' AS name FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents))
SELECT name AS file, strlen(text) AS bytes, NULL AS title FROM n WHERE text IS NOT NULL UNION ALL SELECT name || '.xmp', NULL, lang FROM n WHERE doc_id % 2 = 0"""
)
def album_exported(spark, d):
    """An album's files and sidecars as they lie in the folder after the export."""
    folder = _folder(spark)
    k = F.col("doc_id")
    side = F.when(k % 2 == 0, I.render_sidecar(F.col("lang"), F.lit(None).cast("string"), F.array("source")))
    files.export(load(spark, d, "documents").select(k.alias("id"), F.concat("source", F.lit(".jpg")).alias("name"), F.col("text").alias("content"), side.alias("sidecar")), folder)
    name, is_side = F.regexp_extract("path", "([^/]*)$", 1), F.col("path").endswith(".xmp")
    title = F.when(is_side, I.sidecar(F.decode("content", "UTF-8"))["title"])
    return files.lying(spark, folder, "*.{jpg,xmp}", name.alias("file"), F.when(~is_side, F.col("length")).alias("bytes"), title.alias("title"))


def _inbox(spark, d):
    """Each document as a file of one of five kinds; some can't be read, some pictures have a sidecar. And the keys known before."""
    k = F.col("doc_id")
    docs = load(spark, d, "documents")
    ext = F.element_at(F.array(*map(F.lit, ("jpg", "heic", "txt", "mp4", "JPG"))), (k % 5 + 1).cast("int"))
    path = F.concat(F.lit("/inbox/"), "source", F.lit("/IMG_"), k.cast("string"), F.lit("."), ext)
    own = docs.select(path.alias("path"), F.when(k % 19 != 0, F.col("text").cast("binary")).alias("content"))
    side = I.render_sidecar(F.concat("lang", F.lit(" & "), "source"), F.lit(None).cast("string"), F.array("lang"))
    beside = docs.where("doc_id % 5 = 0 and doc_id % 3 = 0").select(F.concat(path, F.lit(".xmp")).alias("path"), side.cast("binary").alias("content"))
    known = docs.where("doc_id % 7 = 0").select(I.content_key(F.col("text")).alias("hash"))
    return own.unionByName(beside), known


INBOX = """f AS (SELECT '/inbox/' || source || '/IMG_' || doc_id || '.' || (['jpg', 'heic', 'txt', 'mp4', 'JPG'])[1 + doc_id % 5] AS path, doc_id % 5 <> 2 AS media, CASE WHEN doc_id % 19 <> 0 THEN sha256(text) END AS hash,
  CASE WHEN doc_id % 5 = 0 AND doc_id % 3 = 0 THEN lang || ' & ' || source END AS title, doc_id FROM documents),
k AS (SELECT DISTINCT sha256(text) AS hash FROM documents WHERE doc_id % 7 = 0 AND text IS NOT NULL), g AS (SELECT hash, min(path) AS first FROM f WHERE media AND hash IS NOT NULL GROUP BY 1),
r AS (SELECT path, CASE WHEN NOT media THEN 'skipped' WHEN f.hash IS NULL THEN 'error' WHEN k.hash IS NOT NULL OR path <> first THEN 'deduped' ELSE 'inserted' END AS outcome, CASE WHEN media THEN f.hash END AS hash, CASE WHEN media THEN title END AS title
  FROM f LEFT JOIN k ON k.hash = f.hash LEFT JOIN g ON g.hash = f.hash UNION ALL SELECT path || '.xmp', 'skipped', NULL, NULL FROM f WHERE doc_id % 5 = 0 AND doc_id % 3 = 0)"""


@query(f"WITH {INBOX} SELECT * FROM r")
def ingest_outcomes(spark, d):
    """What became of each file of an inbox."""
    return ingest_run.ingested(*_inbox(spark, d)).select("path", "outcome", "hash", "title")


@query(f"WITH {INBOX} SELECT count(*) AS seen, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'deduped') AS deduped, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'error') AS errors FROM r")
def ingest_totals(spark, d):
    return ingest_run.totals(ingest_run.ingested(*_inbox(spark, d)))

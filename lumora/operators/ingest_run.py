"""Ingest end to end: candidates, probe, sidecars, content keys, outcomes, jobs; one bad file changes nothing for the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.operators import ingest as I
from lumora.operators.records import jobs_after_ingest
from lumora.sources.exif import probed


def ingested(files: DataFrame, known: DataFrame) -> DataFrame:
    """A row for each of files(path, content): outcome, reason, hash, mime, flags, what its EXIF and sidecar say, and its partner.

    skipped: no media file by its name. error: the content could not be read (null). deduped: the content is known(hash) or was brought by a path before it.
    inserted: the rest. A sidecar `<path>.xmp` gives title, description and tags, and time and position where EXIF has none; `partner` is the clip
    or raw file of the same stem. Files are probed once, by content hashes; contents don't move between tasks.
    """
    media = files.withColumn("candidate", I.is_candidate(F.col("path")))
    texts = files.where(F.lower("path").endswith(".xmp")).select("path", F.decode("content", "UTF-8").alias("text"))
    own = media.where("candidate").select("path", "content", I.content_key(F.col("content")).alias("hash"), I.mime_of(F.col("path"), F.col("content")).alias("mime"), I.is_raw(F.col("path")).alias("is_raw"), I.is_screenshot(F.col("path")).alias("is_screenshot"), F.octet_length("content").cast("long").alias("bytes"))
    seen = probed(own)
    side = texts.select(F.regexp_extract("path", r"(?i)^(.*)\.xmp$", 1).alias("path"), I.sidecar(F.col("text")).alias("side"))
    pairs = I.sibling_pairs(own.select("path")).select(F.col("still").alias("path"), F.coalesce("motion", "raw").alias("partner"))
    first = own.where("hash is not null").groupBy("hash").agg(F.min("path").alias("first")).join(known.select("hash").distinct().withColumn("known", F.lit(True)), "hash", "left")
    told = seen.where("hash is not null").join(first, "hash")
    told = told.withColumn("outcome", F.when(F.col("known") | (F.col("path") != F.col("first")), "deduped").otherwise("inserted")).drop("known", "first")
    told = told.unionByName(seen.where("hash is null").withColumn("outcome", F.lit("error"))).join(side, "path", "left").join(pairs, "path", "left")
    x, s = F.col("exif"), F.col("side")
    rows = told.select(
        "path", "outcome", F.when(F.col("outcome") == "error", "unreadable").alias("reason"), "hash", "mime", "bytes", "is_raw", "is_screenshot", x["device"].alias("device"), x["lens"].alias("lens"), x["width"].alias("width"), x["height"].alias("height"),
        F.coalesce(x["taken"], s["created"]).alias("taken"), F.coalesce(x["lat"], s["lat"]).alias("lat"), F.coalesce(x["lon"], s["lon"]).alias("lon"), s["title"].alias("title"), s["description"].alias("description"), s["tags"].alias("tags"), "partner",
    )
    rest = media.where(~F.col("candidate")).select("path", F.lit("skipped").alias("outcome"), F.lit("no media file").alias("reason"))
    return rows.unionByName(rest, allowMissingColumns=True)


def totals(rows: DataFrame) -> DataFrame:
    """One row: files seen, inserted, deduped, skipped, errors."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return rows.agg(F.count("*").alias("seen"), n("inserted").alias("inserted"), n("deduped").alias("deduped"), n("skipped").alias("skipped"), n("error").alias("errors"))


def jobs(rows: DataFrame) -> DataFrame:
    """The jobs that follow each inserted file, by its content."""
    return jobs_after_ingest(rows.where("outcome = 'inserted'").select(F.col("hash").alias("id")))

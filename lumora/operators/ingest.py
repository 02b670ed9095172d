"""Ingest as DataFrames: candidate files, kinds, pairs, sidecars, content-addressed deduplication and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.functions import scalars as S
from lumora.operators.library import insert_new
from lumora.operators.order import numbered

# fixed values: extensions taken in, by kind
IMAGES = "jpg jpeg png heic heif webp bmp gif tif tiff".split()
VIDEOS = "mp4 mov m4v mkv webm".split()
RAW = "cr2 cr3 nef arw dng raf orf rw2".split()
# fixed values: first bytes in hex, and extensions, of media types
MAGIC = (("FFD8FF", "image/jpeg"), ("89504E470D0A1A0A", "image/png"), ("47494638", "image/gif"), ("424D", "image/bmp"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"))
RIFF = {"57454250": "image/webp", "57415645": "audio/x-wav", "41564920": "video/x-msvideo"}
MIMES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif", "tif": "image/tiff", "tiff": "image/tiff", "heic": "image/heic", "heif": "image/heic", "mp4": "video/mp4", "m4v": "video/mp4", "mov": "video/quicktime", "mkv": "video/x-matroska", "webm": "video/webm"}
MARKERS = ("MotionPhoto_Data", "MicroVideo", "MotionPhoto")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modificationTime, content of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def is_candidate(path: Column) -> Column:
    return ~S.file_name(path).startswith(".") & S.extension(path).isin([*IMAGES, *VIDEOS, *RAW])


def is_raw(path: Column) -> Column:
    return S.extension(path).isin(RAW)


def is_screenshot(path: Column) -> Column:
    """Named so, or in a folder named so."""
    return F.lower(S.file_name(path)).startswith("screenshot") | F.lower(path).rlike(r"(^|/)screenshots/[^/]*$")


def is_phone_folder(path: Column) -> Column:
    return path.rlike(r"/[0-9]+APPLE/")


def mime_of(path: Column, content: Column) -> Column:
    """By first bytes, else by extension; raw files and unknown ones are application/octet-stream."""
    head, ext = F.hex(F.substring(content, 1, 16)), S.extension(path)
    out = mime_by_extension(path)
    brand = F.decode(F.substring(content, 9, 4), "ISO-8859-1")
    boxed = F.when(brand.isin("heic", "heix", "mif1", "msf1"), "image/heic").when(brand == "qt  ", "video/quicktime").otherwise(F.when(ext.isin("heic", "heif"), "image/heic").otherwise("video/mp4"))
    out = F.when(F.substring(head, 9, 8) == "66747970", boxed).otherwise(out)
    out = F.when(head.startswith("1A45DFA3"), F.when(ext == "webm", "video/webm").otherwise("video/x-matroska")).otherwise(out)
    for kind, mime in RIFF.items():
        out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == kind), mime).otherwise(out)
    for hexa, mime in reversed(MAGIC):
        out = F.when(head.startswith(hexa), mime).otherwise(out)
    return out


def mime_by_extension(path: Column) -> Column:
    out = F.lit("application/octet-stream")
    for ext, mime in MIMES.items():
        out = F.when(S.extension(path) == ext, mime).otherwise(out)
    return out


def has_motion_trailer(content: Column) -> Column:
    """One of the markers in the last 128 KiB."""
    tail = F.decode(F.substring(content, -131072, 131072), "ISO-8859-1")
    return F.greatest(*(tail.contains(m) for m in MARKERS))


def burst_number(stem: Column) -> Column:
    """Digits of IMG_1234, IMG_E1234 and their lower-case forms; null else."""
    return F.nullif(F.regexp_extract(stem, r"^(?:IMG_|img_)[Ee]?([0-9]+)$", 1), F.lit(""))


def stem_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def sibling_pairs(paths: DataFrame) -> DataFrame:
    """(folder, stem, still, motion, raw): a still with a clip of the same stem, and a raw file with its picture."""
    ext = S.extension(F.col("path"))
    by = paths.groupBy(folder_of(F.col("path")).alias("folder"), stem_of(F.col("path")).alias("stem"))
    pick = lambda kinds: F.min(F.when(ext.isin(kinds), F.col("path")))
    out = by.agg(pick(["heic", "heif", "jpg", "jpeg"]).alias("still"), pick(["mov", "mp4"]).alias("motion"), pick(RAW).alias("raw"))
    return out.where("still is not null and (motion is not null or raw is not null)")


def bursts(paths: DataFrame) -> DataFrame:
    """(number, n, paths): pictures with one number over all folders, where one of several is an edit or there are three at least."""
    number = burst_number(stem_of(F.col("path")))
    own = paths.where(S.extension(F.col("path")).isin("jpg", "jpeg", "heic", "heif")).select("path", number.alias("number"))
    edit = F.bool_or(F.upper(stem_of(F.col("path"))).startswith("IMG_E"))
    by = own.where("number is not null").groupBy("number").agg(F.count("*").alias("n"), edit.alias("edited"), F.array_sort(F.collect_list("path")).alias("paths"))
    return by.where("(edited and n > 1) or n >= 3").drop("edited")


def sidecar_path(path: Column) -> Column:
    """Where the XMP of a file lies: its full name and `.xmp`."""
    return F.concat(path, F.lit(".xmp"))


def with_sidecar(media: DataFrame, files: DataFrame) -> DataFrame:
    """media(path) with xmp, the text of the file of files(path, text) that lies beside it; null where there is none."""
    beside = files.select(F.regexp_extract("path", r"(?i)^(.*)\.xmp$", 1).alias("path"), F.col("text").alias("xmp")).where("path <> ''")
    return media.join(beside, "path", "left")


def merged_record(mime: Column, exif: Column, side: Column) -> Column:
    """JSON of {mime, exif, sidecar}; a sidecar that is null is left out."""
    return F.to_json(F.struct(mime.alias("mime"), exif.alias("exif"), side.alias("sidecar")))


def display_values(fields: Column) -> Column:
    """Map from `ifd::tag` to the shown value, of array<struct<ifd, tag, value>>; of equal keys the last."""
    key = lambda f: F.concat_ws("::", f["ifd"].cast("string"), f["tag"])
    last = F.filter(fields, lambda f, i: ~F.exists(F.slice(fields, i + 2, F.size(fields)), lambda g: key(g) == key(f)))
    return F.map_from_entries(F.transform(last, lambda f: F.struct(key(f), f["value"])))


def unquoted(value: Column) -> Column:
    """Without the quotes around it; null if nothing is left."""
    return F.nullif(F.regexp_replace(value, '^"+|"+$', ""), F.lit(""))


def path_key(path: Column, key: str) -> Column:
    """Keyed digest of a path: 32 hex digits."""
    return F.substring(F.sha2(F.concat(F.lit(key + "path\x1f"), path), 256), 1, 32)


def verified(blobs: DataFrame) -> DataFrame:
    """blobs(hash, content) with `whole`: the content still has the key it is stored under."""
    return blobs.withColumn("whole", F.coalesce(content_key(F.col("content")) == F.col("hash"), F.lit(False)))


def thumbnail_size(width: Column, height: Column, side: int) -> Column:
    """struct(width, height) that fits a square; small pictures are not enlarged, no side falls below 1."""
    scale = F.least(F.lit(1.0), F.lit(float(side)) / F.greatest(width, height))
    fit = lambda x: F.greatest(F.round(x * scale), F.lit(1.0)).cast("int")
    return F.struct(fit(width).alias("width"), fit(height).alias("height"))


def announced(assets: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, hash) to be announced: the cached key or else that of the content, without keys that are stored already."""
    named = assets.select("id", F.coalesce("cached", content_key(F.col("content"))).alias("hash"))
    return named.join(stored.select("hash"), "hash", "left_anti").select("id", "hash")


TAKEOUT = (
    "title string, description string, photoTakenTime struct<timestamp:string>, "
    "geoData struct<latitude:double,longitude:double>, people array<struct<name:string>>"
)


def takeout(json: Column) -> Column:
    """struct(title, description, taken, lat, lon, persons) from an export's JSON; null if it does not parse; (0, 0) is no position."""
    x = F.from_json(json, TAKEOUT, {"mode": "PERMISSIVE"})

    def fields(x: Column) -> Column:
        lat, lon = x["geoData"]["latitude"], x["geoData"]["longitude"]
        off = (lat == 0) & (lon == 0)
        return F.struct(
            F.nullif(x["title"], F.lit("")).alias("title"),
            F.nullif(x["description"], F.lit("")).alias("description"),
            F.timestamp_seconds(x["photoTakenTime"]["timestamp"].try_cast("long")).alias("taken"),
            F.when(~off, lat).alias("lat"),
            F.when(~off, lon).alias("lon"),
            F.transform(x["people"], lambda p: p["name"]).alias("persons"),
        )

    return S.each(x, lambda x: F.when(x.isNotNull(), fields(x)))


def without_sidecars(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """media(path) that no file of sidecars(path) belongs to: what an import may still describe."""
    return media.join(sidecars.select(F.regexp_extract("path", r"(?i)^(.*)\.xmp$", 1).alias("path")), "path", "left_anti")


def with_takeout(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """media(path) with the JSON of sidecars(path, json) named `<path>.json`, else `<path>.supplemental-metadata.json`."""
    first = sidecars.select(F.regexp_extract("path", r"^(.*)\.json$", 1).alias("path"), F.col("json").alias("plain"))
    second = sidecars.select(F.regexp_extract("path", r"^(.*)\.supplemental-metadata\.json$", 1).alias("path"), F.col("json").alias("supplement"))
    out = media.join(first, "path", "left").join(second.where("path <> ''"), "path", "left")
    return out.withColumn("json", F.coalesce("plain", "supplement")).drop("plain", "supplement")


def sidecar(body: Column) -> Column:
    """struct(title, description, tags, notes, created, lat, lon, persons, album) from XMP text, fields null where absent."""

    def alt(tag: str) -> Column:
        inner = F.regexp_extract(body, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
        return S.decode_entities(F.coalesce(S.between_tags(inner, "rdf:li"), S.between_tags(body, tag)))

    def bag(tag: str) -> Column:
        inner = F.regexp_extract(body, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
        return F.transform(S.items(inner, "rdf:li"), S.decode_entities)

    def value(name: str) -> Column:
        return F.coalesce(S.between_tags(body, name), S.attribute(body, name))

    time = F.coalesce(*(F.try_to_timestamp(value(n)) for n in ("xmp:CreateDate", "photoshop:DateCreated")))
    return F.struct(
        alt("dc:title").alias("title"), alt("dc:description").alias("description"), bag("dc:subject").alias("tags"),
        value("exif:UserComment").alias("notes"), time.alias("created"), S.parse_gps(value("exif:GPSLatitude")).alias("lat"),
        S.parse_gps(value("exif:GPSLongitude")).alias("lon"), bag("Iptc4xmpExt:PersonInImage").alias("persons"), value("lumora:Album").alias("album"),
    )


def render_sidecar(title: Column, description: Column, tags: Column) -> Column:
    """XMP text that `sidecar` reads back; null fields are left out."""
    lang = lambda tag, v: F.when(v.isNotNull(), F.concat(F.lit(f"<{tag}><rdf:Alt><rdf:li xml:lang=\"x-default\">"), S.encode_entities(v), F.lit(f"</rdf:li></rdf:Alt></{tag}>")))
    bag = F.concat(F.lit("<dc:subject><rdf:Bag>"), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("<rdf:li>"), S.encode_entities(t), F.lit("</rdf:li>"))), ""), F.lit("</rdf:Bag></dc:subject>"))
    return F.concat_ws("", F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF><rdf:Description>'), lang("dc:title", title), lang("dc:description", description), F.when(F.size(tags) > 0, bag), F.lit("</rdf:Description></rdf:RDF></x:xmpmeta>"))


def content_key(content: Column) -> Column:
    return F.sha2(content, 256)


def new_contents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming(path, hash) rows that bring a content not yet held, the first path of each."""
    return insert_new(existing, incoming, ["hash"], ["path"])


def ingest_report(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(outcome, n): inserted, deduped and skipped files of incoming(path, hash); a null hash could not be read."""
    first = F.row_number().over(Window.partitionBy("hash").orderBy("path"))
    known = existing.select("hash", F.lit(True).alias("known")).distinct()
    told = incoming.where("hash is not null").withColumn("r", first).join(known, "hash", "left")
    outcome = F.when(F.col("known") | (F.col("r") > 1), "deduped").otherwise("inserted")
    both = told.select(outcome.alias("outcome")).unionByName(incoming.where("hash is null").select(F.lit("skipped").alias("outcome")))
    return both.groupBy("outcome").agg(F.count("*").alias("n"))


def orphans(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored blobs (hash, bytes) that no live row names."""
    return stored.join(live.select("hash"), "hash", "left_anti")


def export_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """rows with out_name: repeats of a file name get -1, -2, ... before the extension, in the order given, nulls last.

    All rows are numbered by name and order in sorted ranges; a row's number less the first of its name is its repeat, so a name that most files
    share is no one task's.
    """
    placed = numbered(rows, [F.col(name), F.col(order).asc_nulls_last()], "__p")
    first = placed.groupBy(name).agg(F.min("__p").alias("__first"))
    r = F.col("__p") - F.col("__first")
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)?$", 1)
    out = F.when(r == 0, F.col(name)).otherwise(F.concat(stem, F.lit("-"), r.cast("string"), ext))
    return placed.join(first, name).select(*rows.columns, out.alias("out_name"))

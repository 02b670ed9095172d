"""Point reads, deletes, updates and appends as transforms of whole tables: rows in, rows out."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.operators.library import RULE
from lumora.operators.order import numbered
from lumora.sources.versions import publish

INCOMING = "__incoming_shares__"
# fixed values: kinds of background work, and those that need a model
KINDS = "embed_asset detect_faces phash rebuild_person_clusters rebuild_near_dup ocr classify_pet".split()
NEED_MODELS = "embed_asset detect_faces rebuild_person_clusters ocr classify_pet".split()
AFTER_INGEST = ("embed_asset", "detect_faces")
# records that travel as JSON; binary fields as base64
COLLECTION_META = "kind string, name string, cover_key string"
MEMBER_ENTRY = (
    "cas_ref string, content_key string, stored_key string, wrapped_file_key string, mime string, bytes long, width long, height long, duration_ms long, taken_at_utc_day long, "
    "is_video boolean, is_raw boolean, is_screenshot boolean, is_live boolean, is_motion boolean, filename string, taken_at_utc string, gps string, device string, lens string, exif_all string"
)

# reads --------------------------------------------------------------------------------------------------------------


def one(rows: DataFrame, **want) -> DataFrame:
    """Rows whose columns equal the given values: a lookup by key."""
    for name, value in want.items():
        rows = rows.where(F.col(name) == value)
    return rows


def asset_detail(assets: DataFrame, row_id: int, unlocked: bool, sealed: tuple[str, ...] = ("device", "lens", "gps")) -> DataFrame:
    """One asset with its position as fields; sealed columns are null unless unlocked, and a position that does not parse is null."""
    out = one(assets, id=row_id)
    for name in sealed:
        out = out.withColumn(name, F.when(F.lit(unlocked), F.col(name)))
    p = F.from_json("gps", "lat double, lon double, alt double")
    return out.withColumns({k: p[k] for k in ("lat", "lon", "alt")}).drop("gps")


def smart_albums(collections: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(id, name, rule, n, snapshot_at) of smart albums whose spec reads as a rule, with their stored members and last refresh."""
    rule = F.from_json("spec", RULE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = collections.where("kind = 'smart_album' and spec is not null").where(F.expr("try_parse_json(spec) is not null"))
    per = snapshot.groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("n"), F.max("snapshot_at").alias("snapshot_at"))
    out = parsed.withColumn("rule", rule).join(per, "id", "left")
    return out.select("id", "name", "rule", F.coalesce("n", F.lit(0)).alias("n"), "snapshot_at")


def pet(species: Column, confidence: Column, threshold: float = 0.6) -> Column:
    return species.isNotNull() & F.coalesce(confidence >= threshold, F.lit(False))


# writes -------------------------------------------------------------------------------------------------------------


def without(rows: DataFrame, gone: DataFrame, keys: list[str], owner: int | None = None, owner_col: str = "owner_id") -> DataFrame:
    """rows without those that gone names by keys; with an owner, only what is theirs goes."""
    mark = gone.select(*keys).distinct()
    if owner is None:
        return rows.join(mark, keys, "left_anti")
    mine = rows.where(F.col(owner_col).eqNullSafe(F.lit(owner)))
    return rows.where(~F.col(owner_col).eqNullSafe(F.lit(owner))).unionByName(mine.join(mark, keys, "left_anti"))


def without_collections(collections: DataFrame, members: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(collections, members) without the collections gone(id) and what they hold."""
    left = members.join(gone.select(F.col("id").alias("collection_id")), "collection_id", "left_anti")
    return collections.join(gone.select("id"), "id", "left_anti"), left.select(*members.columns)


def updated(rows: DataFrame, changes: DataFrame, key: str, guard: Column | None = None) -> DataFrame:
    """rows with the other columns of changes put in place of their own where the key is named (null: set to null) and guard holds."""
    names = [c for c in changes.columns if c != key]
    told = changes.select(key, F.struct(*names).alias("__new"), F.lit(True).alias("__hit"))
    hit = F.coalesce("__hit", F.lit(False)) & (F.lit(True) if guard is None else F.coalesce(guard, F.lit(False)))
    out = rows.join(told, key, "left").withColumn("__hit", hit)
    return out.select(*(F.when(F.col("__hit"), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in rows.columns))


def appended(rows: DataFrame, new: DataFrame, order: str, key: str = "id") -> DataFrame:
    """rows and the new ones with keys that go on from the largest, in the order given; new rows are numbered in sorted ranges, however many they are."""
    top = rows.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    added = numbered(new, [order], "__r").join(F.broadcast(top))
    added = added.withColumn(key, (F.col("__top") + F.col("__r") + 1).cast(rows.schema[key].dataType))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in added.columns]
    return rows.unionByName(added.select("*", *missing).select(*rows.columns))


def split_person(faces: DataFrame, ids: DataFrame, new_person: int) -> DataFrame:
    """faces with those that ids names by face_id moved to a new person."""
    return updated(faces, ids.select("face_id").distinct().withColumn("person_id", F.lit(new_person).cast(faces.schema["person_id"].dataType)), "face_id")


def replaced(rows: DataFrame, path: str) -> DataFrame:
    """The table at path after its rows took the place of the old ones, at once (see sources.versions)."""
    return publish(rows, path)


def incoming_source(sources: DataFrame, owner: int) -> DataFrame:
    """sources with the owner's source for received shares, added once."""
    there = sources.where((F.col("owner_id") == owner) & (F.col("name") == INCOMING)).select("owner_id")
    new = sources.sparkSession.createDataFrame([(owner, INCOMING)], "owner_id long, name string").join(there, "owner_id", "left_anti")
    return appended(sources, new, "name")


# background work ----------------------------------------------------------------------------------------------------


def jobs_after_ingest(assets: DataFrame) -> DataFrame:
    """(kind, asset_id): the work that every new asset asks for."""
    return assets.select(F.explode(F.array(*map(F.lit, AFTER_INGEST))).alias("kind"), F.col("id").alias("asset_id"))


def reindex(missing_vectors: DataFrame, missing_faces: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new jobs(kind, asset_id), report(embed_queued, detect_queued, assets_touched)); a job that exists is not queued again."""
    wanted = missing_vectors.select(F.lit("embed_asset").alias("kind"), F.col("id").alias("asset_id"))
    wanted = wanted.unionByName(missing_faces.select(F.lit("detect_faces").alias("kind"), F.col("id").alias("asset_id")))
    new = wanted.join(jobs.select("kind", "asset_id").distinct(), ["kind", "asset_id"], "left_anti")
    touched = wanted.agg(F.count_distinct("asset_id").alias("assets_touched"))
    queued = new.agg(F.count_if(F.col("kind") == "embed_asset").alias("embed_queued"), F.count_if(F.col("kind") == "detect_faces").alias("detect_queued"))
    return new, queued.join(F.broadcast(touched))


def drained(jobs: DataFrame, models: bool) -> DataFrame:
    """jobs after a worker step: what is running ends, and what needs models fails where there are none; unknown kinds fail."""
    known, needs = F.col("kind").isin(KINDS), F.col("kind").isin(NEED_MODELS)
    error = F.when(~known, "unknown kind").when(needs & F.lit(not models), "models unavailable")
    run = F.col("state") == "running"
    state = F.when(run, F.when(error.isNull(), "done").otherwise("failed")).otherwise(F.col("state"))
    return jobs.withColumns({"error": F.when(run, error), "state": state})


# records ------------------------------------------------------------------------------------------------------------


def as_record(schema: str, values: dict[str, Column]) -> Column:
    """JSON of a record of that schema; fields without a value are written as null."""
    fields = [f.split() for f in schema.split(", ")]
    row = F.struct(*(values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields))
    return F.to_json(row, {"ignoreNullFields": "false"})


def feature_collection(features: DataFrame, order: str, per: str | None = None) -> DataFrame:
    """GeoJSON text: a FeatureCollection of features(feature) for each value of `per` (one file each); groups are bounded by what a file may hold."""
    by = features.groupBy(*([per] if per else []))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order, "feature"))), lambda f: f["feature"])
    return by.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(rows, ","), F.lit("]}")).alias("geojson"))


def html_escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def text_lines_json(lines: Column) -> Column:
    """JSON of array<struct<text, score, box>>: recognised lines as they are stored."""
    return F.to_json(lines)


def unletterboxed(box: Column, scale: Column, pad_x: Column, pad_y: Column) -> Column:
    """struct(x, y, w, h) in the picture of a box x1, y1, x2, y2 in the network's square; sides are not negative."""
    x1, y1 = (box["x1"] - pad_x) / scale, (box["y1"] - pad_y) / scale
    x2, y2 = (box["x2"] - pad_x) / scale, (box["y2"] - pad_y) / scale
    return F.struct(x1.alias("x"), y1.alias("y"), F.greatest(x2 - x1, F.lit(0.0)).alias("w"), F.greatest(y2 - y1, F.lit(0.0)).alias("h"))


def day_instant(day: Column) -> Column:
    """The first moment of a day number; beyond what a timestamp holds, now."""
    return F.when(day.between(-(10**6) * 2, 10**6 * 2), F.timestamp_seconds(day * 86_400)).otherwise(F.current_timestamp())


def zoom(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(1.0)), F.lit(128.0))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, label) of lines `file,label`; lines that start with # are comments, later commas belong to the label."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & F.col("value").contains(","))
    return lines.select(F.trim(F.substring_index("value", ",", 1)).alias("file"), F.trim(F.expr("substring(value, instr(value, ',') + 1)")).alias("label"))


def rule_json(**fields) -> str:
    return json.dumps(fields)

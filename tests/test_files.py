"""EXIF bytes in both orders, cut and broken files; the file sink's counts, restarts and failures; ingest from a folder."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lumora.operators import ingest as I
from lumora.operators import ingest_run
from lumora.sources import exif, files


@pytest.mark.parametrize("big", [False, True])
def test_written_fields_come_back(big):
    x = exif.probe(exif.written("Model 7", "35mm", "2020:01:02 03:04:05", "2019-12-31 23:59:58", -33.86882, 151.20929, 58.25, (4000, 3000), None, big))
    assert (x["device"], x["lens"], x["width"], x["height"], x["taken_s"], x["alt"]) == ("Model 7", "35mm", 4000, 3000, 1577836798, 58.25)
    assert abs(x["lat"] + 33.86882) < 1e-7 and abs(x["lon"] - 151.20929) < 1e-7
    assert {f["tag"]: f["value"] for f in x["fields"]}["GPSLatitudeRef"] == '"S"'
    assert exif.probe(exif.written(own_size=(12, 34), size=(1, 2), big=big))["width"] == 12
    assert exif.probe(exif.written("", "", "never", None, big=big))["taken_s"] is None
    plain = exif.tiff_in(exif.written("A", big=big))[0]
    assert exif.probe(plain)["device"] == "A"
    png = b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + b"IHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big") + b"\0" * 9 + len(plain).to_bytes(4, "big") + b"eXIf" + plain + b"\0" * 4
    assert [exif.probe(png)[k] for k in ("device", "width", "height")] == ["A", 7, 9]


def test_broken_bytes_never_fail():
    whole = exif.written("Model 7", "35mm", "2020:01:02 03:04:05", None, 1.5, 2.5, 3.0, (10, 20), (30, 40))
    rng = random.Random(2)
    for n in range(len(whole)):
        exif.probe(whole[:n])
    for _ in range(3000):
        bad = bytearray(whole)
        for _ in range(rng.randrange(1, 6)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        exif.probe(bytes(bad))
    loop = b"II*\0\x08\0\0\0" + b"\x01\0" + b"\x69\x87\x04\0\x01\0\0\0\x08\0\0\0" + b"\x08\0\0\0"
    assert exif.probe(loop)["device"] is None and exif.probe(None)["fields"] == [] and exif.probe(b"")["lat"] is None
    assert exif.dms_to_decimal([(1, 1), (30, 1)]) is None and exif.dms_to_decimal([(1, 1), (30, 0), (0, 1)]) is None and exif.dms_to_decimal([(1, 1), (30, 1), (36, 1)]) == 1.51


def listed(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if "_reports" not in d and not f.endswith(".crc"))


def test_store_is_idempotent_and_counts(spark, tmp_path):
    folder = str(tmp_path / "cas")
    df = spark.createDataFrame([(b"a",), (b"a",), (b"b",), (None,), (b"",)], "content binary").repartition(3)
    files.store(df, folder)
    first = listed(folder)
    at = {f: os.stat(f"{folder}/{f}").st_mtime_ns for f in first}
    files.store(df.unionByName(spark.createDataFrame([(b"c",)], "content binary")), folder)
    got = [tuple(r) for r in files.reports(spark, folder).orderBy("run").collect()]
    assert got == [(0, 3, 1, 1, 2), (1, 1, 4, 1, 1)]
    assert len(first) == 3 and len(listed(folder)) == 4 and all(os.stat(f"{folder}/{f}").st_mtime_ns == t for f, t in at.items())
    assert all(f.split("/")[1][:2] == f.split("/")[0] for f in first)


def test_a_failed_job_leaves_no_half_file(spark, tmp_path):
    folder = str(tmp_path / "cas")
    bad = spark.range(40).select(F.concat(F.lit("x/"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.lit("whole")).cast("binary").alias("content"), F.lit(1).alias("n"))
    with pytest.raises(Exception, match="lost"):
        files.put(bad.repartition(4), folder)
    assert not [f for f in listed(folder) if f.startswith(".tmp")] and not os.path.exists(f"{folder}/_reports")
    assert all(open(f"{folder}/{f}", "rb").read() == b"whole" for f in listed(folder))
    os.makedirs(f"{folder}/x/7/in the way", exist_ok=True) if not os.path.exists(f"{folder}/x/7") else None
    files.put(spark.range(40).select(F.concat(F.lit("y/"), F.col("id").cast("string")).alias("path"), F.lit("whole").alias("content"), F.lit(1).alias("n")), folder)
    assert files.reports(spark, folder).first()["inserted"] == 40


def test_ingest_from_a_folder(spark, tmp_path):
    box = tmp_path / "DCIM/100APPLE"
    box.mkdir(parents=True)
    one = exif.written("Phone", "wide", "2021:05:06 07:08:09", None, 48.85, 2.35, 30.0, (40, 30))
    (box / "IMG_0001.JPG").write_bytes(one)
    (box / "IMG_0001.MOV").write_bytes(b"\0\0\0\x14ftypqt  clip")
    (box / "IMG_0002.jpg").write_bytes(one)
    (box / "IMG_0003.jpg").write_bytes(one[:30])
    (box / "IMG_0004.png").write_bytes(b"known before")
    (box / "notes.txt").write_bytes(b"no")
    (box / "IMG_0003.jpg.xmp").write_text(spark.range(1).select(I.render_sidecar(F.lit("A & B"), F.lit(None).cast("string"), F.array(F.lit("t")))).first()[0])
    found = I.scan(spark, str(tmp_path)).select("path", "content").unionByName(spark.createDataFrame([("/gone/IMG_9.jpg", None)], "path string, content binary"))
    known = spark.createDataFrame([(b"known before",)], "content binary").select(I.content_key(F.col("content")).alias("hash"))
    rows = {r["path"].rpartition("/")[2]: r for r in ingest_run.ingested(found, known).collect()}
    assert {k: r["outcome"] for k, r in rows.items()} == {
        "IMG_0001.JPG": "inserted", "IMG_0001.MOV": "inserted", "IMG_0002.jpg": "deduped", "IMG_0003.jpg": "inserted", "IMG_0004.png": "deduped", "notes.txt": "skipped", "IMG_0003.jpg.xmp": "skipped", "IMG_9.jpg": "error",
    }
    a, b = rows["IMG_0001.JPG"], rows["IMG_0003.jpg"]
    assert (a["device"], a["width"], a["mime"], a["partner"].rpartition("/")[2]) == ("Phone", 40, "image/jpeg", "IMG_0001.MOV") and abs(a["lat"] - 48.85) < 1e-7
    assert (b["device"], b["title"], b["tags"]) == (None, "A & B", ["t"])
    out = ingest_run.ingested(found, known)
    assert tuple(ingest_run.totals(out).first()) == (8, 3, 2, 2, 1) and ingest_run.jobs(out).count() == 6
    assert tuple(ingest_run.totals(ingest_run.ingested(found.limit(0), known)).first()) == (0, 0, 0, 0, 0)


def test_small_files_share_tasks(spark, tmp_path):
    for k in range(640):
        (tmp_path / f"f{k}.jpg").write_bytes(b"x" * (k % 7 + 1))
    was = spark.conf.get("spark.sql.files.openCostInBytes")
    got = files.lying(spark, str(tmp_path), "*.jpg", F.col("length"))
    assert sorted(r["length"] for r in got.collect()) == sorted(k % 7 + 1 for k in range(640))
    assert len(got.inputFiles()) <= 6 and spark.conf.get("spark.sql.files.openCostInBytes") == was


def _album(spark, tmp_path, rows):
    import duckdb

    from lumora.plans import registry
    from tests.test_oracles import rows_of

    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.ORACLES["album_exported"])
    names = [c[0] for c in want.description]
    got = registry.QUERIES["album_exported"](spark, str(tmp_path))
    return rows_of(got.columns, got.collect()), rows_of(names, want.fetchall())


def test_empty_files_and_rows_without_an_id_are_in_the_album(spark, tmp_path):
    rows = [(3, "", "de", "a"), (1, "one", "en", "a"), (None, "no id", "en", "a"), (2, "", None, "b"), (4, None, "fr", "b"), (6, "six", "fr", "_b")]
    got, want = _album(spark, tmp_path, rows)
    assert len(want) == 8 and got == want


def test_exported_files_lie_in_several_folders_with_their_sidecars(spark, tmp_path):
    rows = spark.range(300).select("id", F.lit("a.jpg").alias("name"), F.lit("x").alias("content"), F.when(F.col("id") % 2 == 0, "side").alias("sidecar"))
    files.export(rows, str(tmp_path))
    names = [f for f in listed(tmp_path)]
    assert len(names) == 450 and 100 < len({f.rpartition("/")[0] for f in names}) <= 256
    assert all(f"{f.removesuffix('.xmp')}" in names for f in names)


def test_a_file_that_cannot_be_written_fails_the_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.jpg", "x", None)], "id long, name string, content string, sidecar string")
    files.export(rows, str(tmp_path))
    (at,) = (f for f in listed(tmp_path) if f.endswith("a.jpg"))
    os.remove(tmp_path / at)
    os.makedirs(tmp_path / at / "in the way")
    with pytest.raises(Exception, match="(?i)directory"):
        files.export(rows, str(tmp_path))

"""A sink that writes each row as a file of its own, whole or not at all, once; and what is stored with it."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lumora.operators.ingest import content_key, export_names
from lumora.session import discard, settle, small_batches

#: Files that a task reads; files whose contents are held at once, and the bytes after which fewer are.
EACH = 4096
HELD = 256
HELD_BYTES = 1 << 24


@dataclass
class Counts(WriterCommitMessage):
    inserted: int = 0
    deduped: int = 0
    failed: int = 0
    bytes: int = 0


def _opened(folder: str):
    """The file system of a folder and the path in it; plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if urlsplit(folder).scheme else f"file://{folder}")


class FileWriter(DataSourceWriter):
    """Rows (path, content, n): content goes to a temporary file of this job and is renamed to its path when whole.

    A path that is there already is kept (n rows deduped) unless `replace` is set. So a task that runs again, or a second run, writes nothing twice. A null
    content and a file that can't be written count as failed (n rows) and stop nothing; if `strict` is set, a file that can't be written fails its task.
    Temporary files go when the job ends, either way.
    """

    def __init__(self, folder: str, replace: bool, strict: bool = False) -> None:
        self.folder, self.replace, self.strict, self.job = folder.rstrip("/"), replace, strict, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Counts:
        files, base = _opened(self.folder)
        out, holding, made_dirs = Counts(), f"{base}/.tmp/{self.job}/{uuid.uuid4().hex}", set()
        files.create_dir(holding, recursive=True)
        for r in rows:
            n = r["n"] if r["n"] is not None else 1
            if r["content"] is None or not r["path"]:
                out.failed += n
                continue
            at, made = f"{base}/{r['path']}", f"{holding}/{uuid.uuid4().hex}"
            try:
                if not self.replace and files.get_file_info(at).is_file:
                    out.deduped += n
                    continue
                with files.open_output_stream(made) as f:
                    f.write(bytes(r["content"]))
                if (into := at.rpartition("/")[0]) not in made_dirs:
                    files.create_dir(into, recursive=True)
                    made_dirs.add(into)
                files.move(made, at)
            except OSError:
                if self.strict:
                    raise
                out.failed += n
                if files.get_file_info(made).is_file:
                    files.delete_file(made)
            else:
                out.inserted, out.deduped, out.bytes = out.inserted + 1, out.deduped + n - 1, out.bytes + len(r["content"])
        return out

    def _clear(self) -> None:
        files, base = _opened(self.folder)
        if files.get_file_info(f"{base}/.tmp/{self.job}").type.name == "Directory":
            files.delete_dir(f"{base}/.tmp/{self.job}")

    def commit(self, messages: list) -> None:
        self._clear()
        files, base = _opened(self.folder)
        total = {k: sum(getattr(m, k) for m in messages if m is not None) for k in ("inserted", "deduped", "failed", "bytes")}
        files.create_dir(f"{base}/_reports", recursive=True)
        number = len(files.get_file_info(_listing(f"{base}/_reports")))
        with files.open_output_stream(f"{base}/_reports/{number:08d}-{self.job}.json") as f:
            f.write(json.dumps({"run": number, **total}).encode())

    def abort(self, messages: list) -> None:
        self._clear()


def _listing(path: str):
    from pyarrow import fs

    return fs.FileSelector(path)


class FileSink(DataSource):
    """format("lumora_files"): one file a row of (path, content, n) below the folder `path`; option replace=true writes over what is there, strict=true fails where a file can't be written."""

    @classmethod
    def name(cls) -> str:
        return "lumora_files"

    def schema(self) -> str:
        return "path string, content binary, n long"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], *(self.options.get(k, "false") == "true" for k in ("replace", "strict")))


def put(rows: DataFrame, folder: str, replace: bool = False, strict: bool = False) -> None:
    """Write rows(path, content, n) through the sink; paths must differ within rows."""
    rows.sparkSession.dataSource.register(FileSink)
    typed = rows.select("path", F.col("content").cast("binary").alias("content"), F.col("n").cast("long").alias("n"))
    typed.write.format("lumora_files").mode("append").option("replace", str(replace).lower()).option("strict", str(strict).lower()).save(folder)


def store(contents: DataFrame, folder: str) -> None:
    """Keep each different content once, as <first two digits of its hash>/<hash>. Copies are merged before they travel, a null content counts as failed."""
    by = contents.select("content", content_key(F.col("content")).alias("hash")).groupBy("hash").agg(F.first("content").alias("content"), F.count("*").alias("n"))
    put(by.select(F.concat_ws("/", F.substring("hash", 1, 2), "hash").alias("path"), "content", "n"), folder)


def export(rows: DataFrame, folder: str) -> None:
    """Files of an album under their names, repeats as name-1, name-2 by id, each with its sidecar where rows(id, name, content, sidecar) has one.

    They lie in up to 256 folders, by the first two hex digits of their name's MD5, a sidecar beside its file: so no folder holds all, and writers don't wait for one.
    """
    named = export_names(rows, "name", "id").withColumn("at", F.concat(F.substring(F.md5("out_name"), 1, 2), F.lit("/"), "out_name"))
    media = named.select(F.col("at").alias("path"), F.col("content").cast("binary").alias("content"), F.lit(1).alias("n"))
    beside = named.where("sidecar is not null").select(F.concat("at", F.lit(".xmp")).alias("path"), F.col("sidecar").cast("binary").alias("content"), F.lit(1).alias("n"))
    put(media.unionByName(beside), folder, replace=True, strict=True)


def _patterns(glob: str) -> list[str]:
    """A glob with {a,b} as plain ones."""
    braces = re.search(r"\{([^{}]*)\}", glob)
    return [g for x in braces[1].split(",") for g in _patterns(glob[: braces.start()] + x + glob[braces.end() :])] if braces else [glob]


def lying(spark: SparkSession, folder: str, glob: str, *columns: Column) -> DataFrame:
    """Columns of the files (path, length, content) that lie in a folder and the folders in it, as a written table.

    Folders are listed in tasks and the list is a written table too, so the driver holds no file names; a task reads some thousand files. Empty files count, the sink's own folders don't.
    """
    patterns = _patterns(glob)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = _opened(folder)
        for b in batches:
            for path in b["path"]:
                found = [x for x in files.get_file_info(_listing(path)) if (x.is_file and any(fnmatchcase(x.base_name, p) for p in patterns)) or (x.type.name == "Directory" and x.base_name[:1] not in ("_", "."))]
                for k in range(0, len(found), EACH):
                    some = found[k : k + EACH]
                    yield pd.DataFrame({"path": [x.path for x in some], "length": [x.size if x.is_file else -1 for x in some]})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = _opened(folder)
        for b in batches:
            held, size = [], 0
            for path, length in zip(b["path"], b["length"]):
                with files.open_input_stream(path) as f:
                    held.append((path, length, f.read()))
                size += length
                if len(held) == HELD or size >= HELD_BYTES:
                    yield pd.DataFrame(held, columns=["path", "length", "content"])
                    held, size = [], 0
            if held:
                yield pd.DataFrame(held, columns=["path", "length", "content"])

    top = spark.createDataFrame([(_opened(folder)[1].rstrip("/"),)], "path string").coalesce(1)
    first = settle(top.mapInPandas(listed, "path string, length long"))
    inner = first.where("length < 0").select("path").repartition(min(64, spark.sparkContext.defaultParallelism * 2))
    second = settle(inner.mapInPandas(listed, "path string, length long"))
    found = first.unionByName(second).where("length >= 0")
    tasks = found.count() // EACH + 1
    with small_batches(spark):
        out = settle(found.repartition(tasks).mapInPandas(read, "path string, length long, content binary").select(*columns))
    discard(first, second)
    return out


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """(run, inserted, deduped, failed, bytes) of each finished write into a folder."""
    return spark.read.schema("run long, inserted long, deduped long, failed long, bytes long").json(f"{folder}/_reports")

"""File inventory, archives and embedded images."""

from __future__ import annotations

import io
import itertools
import mimetypes
import os
import posixpath
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions import vocabulary as V
from plumbline.operators.ordered import newest


def read_files(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """One row per file below the path. Without content only the listing is read; folders that are mounted are listed in tasks."""
    if not with_content and "*" not in path and (path.startswith("/") or re.match("file:/", path)):
        return _listing(spark, re.sub("^file:/+", "/", path))
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    keep = ["path", "length", "modificationTime"] + (["content"] if with_content else [])
    return df.select(*keep)


def _seen(name: str) -> bool:
    """Whether Spark's readers see a file or folder of this name."""
    return not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """The files below a mounted folder. Names of folders come to the driver, level by level; files stay in the tasks.

    Empty and hidden files give no row, as with Spark's reader.
    """
    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["folder"]:
                with os.scandir(folder) as entries:
                    yield pd.DataFrame({"folder": [e.path for e in entries if e.is_dir() and _seen(e.name)]}, dtype="object")

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["folder"]:
                with os.scandir(folder) as entries:
                    found = (e for e in entries if _seen(e.name) and not e.is_dir())
                    while rows := [(f"file:{e.path}", e.stat().st_size, e.stat().st_mtime_ns // 1_000_000) for e in itertools.islice(found, 10_000)]:
                        yield pd.DataFrame([r for r in rows if r[1]], columns=["path", "length", "at"])

    def of(folders: list[str]) -> DataFrame:
        return spark.createDataFrame([(f,) for f in folders], "folder string")

    root = root.rstrip("/") or "/"
    if not os.path.isdir(root):  # a single file, or none: the reader says so
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    level = folders = [root]
    while level := [r[0] for r in of(level).mapInPandas(inside, "folder string").collect()]:
        folders = folders + level
    return of(folders).mapInPandas(files, "path string, length bigint, at bigint").select(
        "path", "length", F.timestamp_millis("at").alias("modificationTime"))


def inventory(files: DataFrame) -> DataFrame:
    """Name, extension, type, size and whether an upload would take the file."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ext = X.extension(name)
    allowed, fits = ext.isin(V.ALLOWED_EXTENSIONS), F.col("length") <= V.MAX_FILE_BYTES
    return files.select(
        "path", name.alias("name"), ext.alias("extension"), X.file_type(ext).alias("file_type"), F.col("length").alias("size"),
        (allowed & fits).alias("accepted"),
        F.when(~allowed, "extension").when(~fits, "size").alias("reason"))


#: File contents that a Python worker takes or gives at once.
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches of contents that fit a worker: their rows are of any size, so bytes and rows bound them."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)):
        set_to = spark.conf.get(key, None)
        if set_to is None or not 0 < int(set_to) <= most:
            spark.conf.set(key, str(most))


MEMBER = "archive string, member string, content binary, size bigint, error string"


def _members(content: bytes, depth: int) -> Iterator[tuple[str, bytes | None, str | None]]:
    """Name, data and error of the members of an archive and of the archives in it, one at a time."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for entry in archive.infolist():
            if entry.is_dir():
                continue
            name = posixpath.basename(entry.filename)
            try:
                data = archive.read(entry)
            except Exception as e:
                yield name, None, str(e)
                continue
            if posixpath.splitext(name)[1].lower() not in V.ARCHIVE_SUFFIXES:
                yield name, data, None
            elif depth <= 1:
                yield name, None, "nested too deep"
            else:
                try:
                    yield from _members(data, depth - 1)
                except Exception as e:
                    yield name, None, str(e)


def expand_archives(files: DataFrame, max_depth: int = V.ARCHIVE_MAX_DEPTH, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Members of zip archives (path, content); an archive or a member that cannot be read gives one error row.

    Members leave the worker in small batches, so it never holds all members of its archives.
    """
    small_batches(files.sparkSession)
    names = ["archive", "member", "content", "size", "error"]

    def rows_of(path: str, content: bytes) -> Iterator[tuple]:
        try:
            if max_depth <= 0:
                raise ValueError("nested too deep")
            for name, data, error in _members(content, max_depth):
                yield path, name, data, None if data is None else len(data), error
        except Exception as e:
            yield path, None, None, None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for row in rows_of(path, content):
                    rows.append(row)
                    held += row[3] or 0
                    if held >= batch_bytes:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, MEMBER)


def archive_members(files: DataFrame) -> DataFrame:
    """Direct members of an archive from its directory, without reading their data."""
    small_batches(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        rows = [(path, e.filename, e.file_size, None) for e in archive.infolist() if not e.is_dir()]
                except Exception as e:
                    rows = [(path, None, None, str(e))]
                if rows:
                    yield pd.DataFrame(rows, columns=["archive", "member", "size", "error"])

    return files.select("path", "content").mapInPandas(run, "archive string, member string, size bigint, error string")


def archive_summary(members: DataFrame) -> DataFrame:
    """Member count, total size and names. The names of one archive are gathered, as its directory was."""
    return members.filter("error is null").groupBy("archive").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("total_size"),
        F.sort_array(F.collect_list("member")).alias("files"))


def member_types(members: DataFrame) -> DataFrame:
    """Type and MIME type per member."""
    guesses = {ext: mimetypes.guess_type("x" + ext)[0] for ext in V.FILE_TYPE_BY_EXTENSION}
    pairs = [F.lit(x) for ext, mime in guesses.items() if mime for x in (ext, mime)]
    ext = X.extension("member")
    return members.withColumns({
        "file_type": X.file_type(ext),
        "mime": F.coalesce(F.try_element_at(F.create_map(*pairs), ext), F.lit("application/octet-stream"))})


def image_inventory(images: DataFrame, per_sheet: int | None = None) -> DataFrame:
    """Format, size and preview of embedded images. images: file_id, sheet, position, content."""
    rows = images if per_sheet is None else newest(images, ["file_id", "sheet"], [F.asc("position")], per_sheet)
    preview = F.base64(F.substring("content", 1, 5000))
    preview = F.regexp_replace(preview, r"\s", "")
    return rows.select(
        "file_id", "sheet", "position",
        F.concat_ws("_", F.lit("IMG"), F.col("file_id").cast("string"), "sheet", F.col("position").cast("string")).alias("id"),
        X.image_format("content").alias("format"), F.length("content").cast("long").alias("size_bytes"),
        F.when(F.length(preview) > 500, F.concat(F.substring(preview, 1, 500), F.lit("..."))).otherwise(preview).alias("preview"))

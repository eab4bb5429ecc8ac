"""Log documents that are saved again under their name, as a data source for batches and streams.

Spark's file stream takes a path once; here a file is read again whenever it was written again. A stream's offset is
the time of the newest file it has taken and the sizes of the files of that very time, so it does not grow with the
folder. Each file is a partition of its own. The folder has to be mounted on the driver and on all executors.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql import functions as F

ROW = ("path string, modified timestamp, fileId bigint, filename string, session string, idx int, at string, message string, data string, "
       "error string")


class SavedFile(InputPartition):
    """A file as it stood when it was listed."""

    def __init__(self, path: str, time: int, size: int):
        self.path, self.time, self.size = path, time, size


def saved_files(folder: str, ending: str = ".json") -> list[SavedFile]:
    """Files below the folder, oldest first; names that begin with a dot or underscore are none."""
    found = []
    for at, folders, names in os.walk(folder):
        folders[:] = sorted(f for f in folders if not f.startswith((".", "_")))
        for name in names:
            if name.endswith(ending) and not name.startswith((".", "_")):
                path = os.path.join(at, name)
                try:
                    state = os.stat(path)
                except FileNotFoundError:  # taken away since it was listed
                    continue
                found.append(SavedFile(path, state.st_mtime_ns, state.st_size))
    return sorted(found, key=lambda f: (f.time, f.path))


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def read_file(file: SavedFile) -> Iterator[tuple]:
    """ROW tuples of a file with one document or a document on each line; what cannot be read is one row with an error."""
    when = datetime.fromtimestamp(file.time / 1e9, timezone.utc)
    try:
        with open(file.path, encoding="utf-8") as f:
            whole = f.read()
        try:
            documents = [json.loads(whole)]
        except json.JSONDecodeError:
            documents = [json.loads(line) for line in whole.splitlines() if line.strip()]
        rows = []
        for doc in documents:
            for idx, entry in enumerate(doc.get("logs") or []):
                rows.append((file.path, when, None if doc.get("fileId") is None else int(doc["fileId"]), _text(doc.get("filename")), _text(doc.get("timestamp")), idx,
                             _text(entry.get("timestamp")), _text(entry.get("message")), _text(entry.get("data")), None))
    except (OSError, ValueError, AttributeError, TypeError) as problem:
        rows = [(file.path, when, None, None, None, None, None, None, None, str(problem))]
    yield from rows


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[SavedFile]:
        return saved_files(self.folder) or [SavedFile("", 0, 0)]

    def read(self, partition: SavedFile) -> Iterator[tuple]:
        return read_file(partition) if partition.path else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"time": -1, "sizes": {}}

    def latestOffset(self) -> dict:
        files = saved_files(self.folder)
        newest = max((f.time for f in files), default=-1)
        return {"time": newest, "sizes": {f.path: f.size for f in files if f.time == newest}}

    def partitions(self, start: dict, end: dict) -> list[SavedFile]:
        """Files written after `start` and not after `end`, as they stand now.

        A file that was written again beyond `end` in the meantime comes with the batch of its new time.
        """
        taken = []
        for f in saved_files(self.folder):
            new = f.time > start["time"] or (f.time == start["time"] and start["sizes"].get(f.path) != f.size)
            known = f.time < end["time"] or (f.time == end["time"] and f.path in end["sizes"])
            if new and known:
                taken.append(f)
        return taken or [SavedFile("", 0, 0)]

    def read(self, partition: SavedFile) -> Iterator[tuple]:
        return read_file(partition) if partition.path else iter(())

    def commit(self, end: dict) -> None:
        pass


class LogDocuments(DataSource):
    """spark.read / spark.readStream .format("log_documents").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "log_documents"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])


def read_log_documents(spark: SparkSession, folder: str) -> DataFrame:
    """ROW of every entry of every log document below the folder."""
    spark.dataSource.register(LogDocuments)
    return spark.read.format("log_documents").load(folder)


def stream_log_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream: new files, and files that were written again, as often as they were while it ran."""
    spark.dataSource.register(LogDocuments)
    return spark.readStream.format("log_documents").load(folder)


def newest_save(rows: DataFrame) -> DataFrame:
    """Of all readings of a file the entries of its last one. `rows`: ROW."""
    last = rows.groupBy("path").agg(F.max("modified").alias("modified"))
    return rows.join(last, ["path", "modified"])

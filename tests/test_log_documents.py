"""Log documents that are saved again: batch and stream from one source."""

import json
import os
from collections import Counter

from plumbline.sources import log_documents as L
from plumbline.streaming import stateful as T


def save(folder, name, logs, file_id=1, at=None):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}"
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"fileId": file_id, "filename": name, "timestamp": "s", "logs": [{"timestamp": str(i), "message": m, "data": {"n": i}} for i, m in enumerate(logs)]}, f)
    if at is not None:
        os.utime(path, (at, at))


def take(spark, folder, out):
    query = L.stream_log_documents(spark, folder).writeStream.option("checkpointLocation", f"{out}/check").format("parquet").start(f"{out}/rows")
    query.processAllAvailable()
    query.stop()
    return spark.read.schema(L.ROW).parquet(f"{out}/rows")


def test_rewritten_files_are_read_again_once(spark, tmp_path):
    folder, out = str(tmp_path / "logs"), str(tmp_path / "out")
    save(folder, "a.json", ["x", "y"], at=1000)
    save(f"{folder}/sub", "b.json", ["ü"], 2, at=1000)
    with open(f"{folder}/broken.json", "w") as f:
        f.write("{no json")
    os.utime(f"{folder}/broken.json", (999, 999))
    first = take(spark, folder, out).collect()
    assert Counter((os.path.basename(r.path), r.fileId, r.idx, r.message, r.data) for r in first if r.error is None) == Counter(
        [("a.json", 1, 0, "x", '{"n": 0}'), ("a.json", 1, 1, "y", '{"n": 1}'), ("b.json", 2, 0, "ü", '{"n": 0}')])
    assert [os.path.basename(r.path) for r in first if r.error] == ["broken.json"]
    assert take(spark, folder, out).count() == 4  # nothing new
    save(folder, "a.json", ["x", "y", "z"], at=2000)  # saved again under its name
    save(folder, "c.json", ["w"], 3, at=2000)
    rows = take(spark, folder, out)
    assert Counter(os.path.basename(r.path) for r in rows.collect()) == {"a.json": 5, "b.json": 1, "c.json": 1, "broken.json": 1}
    save(folder, "d.json", ["v"], 4, at=2000)  # a file of the very time of the last offset
    rows = take(spark, folder, out)
    assert rows.filter("fileId = 4").count() == 1
    key = ["path", "idx", "message", "error"]
    assert Counter(map(tuple, L.newest_save(rows).select(*key).collect())) == Counter(map(tuple, L.read_log_documents(spark, folder).select(*key).collect()))


def test_documents_line_by_line_and_an_empty_folder(spark, tmp_path):
    folder = str(tmp_path / "lines")
    os.makedirs(folder)
    assert L.read_log_documents(spark, folder).count() == 0
    with open(f"{folder}/x.json", "w") as f:
        f.write('{"fileId": 1, "logs": [{"message": "a"}]}\n{"fileId": 2, "logs": null}\n\n{"fileId": null, "logs": [{"message": null}, {}]}')
    got = L.read_log_documents(spark, folder).select("fileId", "idx", "message", "error").collect()
    assert Counter(map(tuple, got)) == Counter([(1, 0, "a", None), (None, 0, None, None), (None, 1, None, None)])

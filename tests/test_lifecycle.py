"""Files, projects, snapshots, listings, sources, sinks and streams."""

import io
import json
from datetime import datetime
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from plumbline import schema
from plumbline.plans import lifecycle as L
from plumbline.sources import files as SF
from plumbline.sources import tables as ST
from plumbline.streaming import intake as I

FILES = "file_id long, project_id long, name string, mime string, processed boolean, error string"


def files(spark):
    return spark.createDataFrame([
        (1, 1, "Grundriss_RevB.pdf", None, True, None), (2, 1, "brief.pdf", None, True, ""), (3, 2, "liste.xlsx", None, False, "kaputt"),
        (4, 3, "x.ifc", None, False, None), (5, 3, "x.csv", None, True, None)], FILES)


def test_routing_and_pending(spark):
    routed = {r.file_id: (r.route, r.error is not None) for r in L.route_files(L.classify_files(files(spark)).drop("error")).collect()}
    assert routed == {1: ("plan", False), 2: ("page", False), 3: ("table", False), 4: ("model", False), 5: (None, True)}
    assert sorted(r.file_id for r in L.pending(files(spark)).collect()) == [3, 4]
    assert [r.file_id for r in L.pending(files(spark), ids=[4, 5]).collect()] == [4]
    done = spark.createDataFrame([(3,)], "file_id long")
    assert sorted(r.file_id for r in L.pending(files(spark), done).collect()) == [1, 2, 4, 5]


def test_status(spark):
    p = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long")
    got = {r.project_id: r.status for r in L.project_status(p, files(spark)).collect()}
    assert got == {1: "validated", 2: "error", 3: "processing", 4: "processing"}


def test_versions(spark):
    s = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, True)], "project_id long, version int, is_active boolean")
    changed = spark.createDataFrame([(1,), (3,)], "project_id long")
    got = sorted((r.project_id, r.version, r.is_active) for r in L.next_versions(s, changed).collect())
    assert got == [(1, 1, False), (1, 2, False), (1, 3, True), (2, 1, True), (3, 1, True)]


def test_entities_show_under_each_file_once(spark):
    e = spark.createDataFrame([("R1", [{"file_id": 1}, {"file_id": 1}, {"file_id": 2}])], "id string, sources array<struct<file_id:long>>")
    rows = L.entities_by_file(files(spark).select("file_id", "name"), L.explode_sources(e, "spaces")).collect()
    assert sorted((r.file_id, r.entity_id) for r in rows if r.entity_id) == [(1, "R1"), (2, "R1")]
    assert sorted(r.file_id for r in rows if not r.entity_id) == [3, 4, 5]


def test_reconcile(spark):
    ddl = "file_id long, key string, n long"
    lost = L.reconcile(spark.createDataFrame([(1, "a", 3), (1, "b", 2), (1, "c", 1)], ddl), spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "z", 1)], ddl))
    assert sorted((r.key, r.loss) for r in lost.collect()) == [("b", "shrunk"), ("c", "missing")]


def test_sorting_and_listing(spark):
    p = spark.createDataFrame([(1, "Zug", "Projektnummer: 9", None), (2, "Äpfel", None, "Bern"), (3, "apfel", "Projektnummer: 1", "Aarau")],
                              "id long, name string, description string, location string").withColumns(
        {"status": F.lit("x"), "created_at": F.current_timestamp()})
    assert [r.id for r in L.sort_projects(p, "name").collect()] == [3, 2, 1]
    assert [r.id for r in L.sort_projects(p, "location").collect()] == [1, 3, 2]
    assert [r.id for r in L.sort_projects(p, "number", ascending=False).collect()] == [1, 3, 2]
    assert [r.id for r in L.listing(p, "id", 1, 1).collect()] == [2]


def test_delete_and_sections(spark):
    gone = spark.createDataFrame([(1,)], "project_id long")
    kept = L.delete_projects(gone, {"files": files(spark)})
    assert kept["files"].filter("project_id = 1").count() == 0 and kept["files"].count() == 3
    s = spark.createDataFrame([(1, ["a", "b"]), (1, []), (2, ["c"])], "project_id long, data array<string>")
    assert {r.project_id: r.entries for r in L.total_entries(L.filled_sections(s)).collect()} == {1: 2, 2: 1}
    assert L.without_lineage(spark.createDataFrame([(1, 2)], "a int, sources int")).columns == ["a"]


def test_archives(spark, tmp_path):
    def zipped(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in members.items():
                z.writestr(name, data)
        return out.getvalue()

    deep = zipped({"tief.txt": b"t"})
    for _ in range(3):
        deep = zipped({"n.zip": deep, "oben.txt": b"o"})
    (tmp_path / "a.zip").write_bytes(zipped({"x/plan.pdf": b"pdf", "x/": b"", "in.zip": zipped({"liste.xlsx": b"12345"}), "alt.tar": b"?"}))
    (tmp_path / "b.zip").write_bytes(deep)
    (tmp_path / "c.zip").write_bytes(b"nope")
    (tmp_path / "d.txt").write_text("x")
    listing = SF.read_files(spark, str(tmp_path), with_content=True)
    inv = {r["name"]: (r.file_type, r.accepted, r.reason) for r in SF.inventory(listing).collect()}
    assert inv["a.zip"] == ("ZIP", True, None) and inv["d.txt"] == ("Unknown", False, "extension")
    zips = listing.filter(F.col("path").endswith(".zip"))
    rows = SF.member_types(SF.expand_archives(zips)).collect()
    found = sorted((r.archive[-5:], r.member, r["size"], r.file_type, r.mime) for r in rows if r.error is None)
    # three levels are read, the fourth is not
    assert [f for f in found if f[0] == "a.zip"] == [
        ("a.zip", "liste.xlsx", 5, "Excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"), ("a.zip", "plan.pdf", 3, "PDF", "application/pdf")]
    assert [f[1] for f in found if f[0] == "b.zip"] == ["oben.txt"] * 3
    assert sorted((r.archive[-5:], r.member or "") for r in rows if r.error) == [("a.zip", "alt.tar"), ("b.zip", "n.zip"), ("c.zip", "")]
    s = SF.archive_summary(SF.archive_members(zips)).filter(F.col("archive").endswith("a.zip")).first()
    assert (s.file_count, s.files) == (3, ["alt.tar", "in.zip", "x/plan.pdf"])


def test_images(spark):
    rows = [(1, "S", i, b"\xff\xd8" + b"x" * i) for i in range(60)]
    d = spark.createDataFrame(rows, "file_id long, sheet string, position long, content binary")
    got = SF.image_inventory(d, per_sheet=50).orderBy("position").collect()
    assert len(got) == 50 and got[3].size_bytes == 5 and got[3].id == "IMG_1_S_3" and got[0].format == "jpeg"
    assert SF.image_inventory(d).count() == 60


def test_sources_and_sinks(spark, tmp_path):
    rules = ST.spec_rules(spark, ST.read_spec(spark))
    assert rules.filter("rule = 'required'").count() == 7 and rules.filter("rule = 'service'").count() == 9
    (tmp_path / "spec.yaml").write_text("mindestanforderungen:\n  raeume:\n    min_anzahl: 2\nsia_phasen: []\nplausibilitaetsgrenzen: {}\n")
    assert ST.spec_rules(spark, ST.read_spec(spark, str(tmp_path / "spec.yaml"))).collect() == [("raeume", "minimum", "2")]
    log = {"fileId": 2, "filename": "f", "timestamp": "t", "logs": [{"timestamp": "1", "message": "Load failed", "data": {"a": 1}}, {"timestamp": "2", "message": "warn", "data": None}]}
    (tmp_path / "log.json").write_text(json.dumps(log, indent=1))
    entries = ST.log_entries(ST.read_event_logs(spark, str(tmp_path / "log.json")))
    read = [(r.message, json.loads(r.data) if r.data else None) for r in entries.orderBy("idx").collect()]
    assert read == [("Load failed", {"a": 1}), ("warn", None)]
    s = L.log_summary(entries, ["fileId"]).first()
    assert (s.total, s.errors, s.warnings) == (2, 1, 1)
    ST.append_json_lines(entries, str(tmp_path / "nd"))
    ST.append_json_lines(entries, str(tmp_path / "nd"))
    assert spark.read.json(str(tmp_path / "nd")).count() == 4
    cells = spark.createDataFrame([(1, "S", 1, 1, "a", "s")], schema.CELL)
    ST.write_report(cells, str(tmp_path / "csv"), "csv")
    assert ST.read_decoded(spark, "cells", str(tmp_path / "csv"), "csv").collect() == cells.collect()
    p = spark.createDataFrame([(7, "N", None, "Bern", "x", None)], schema.PROJECT)
    first = schema.empty_model(p).first()
    assert (first.id, first.version, first.spaces) == ("PROJ_000007", 1, [])
    paras = ST.paragraphs_of_text(spark.createDataFrame([(1, "a\nb")], "file_id long, text string"))
    assert [(r.para_idx, r.text) for r in paras.collect()] == [(0, "a"), (1, "b")]


def test_snapshots_by_project(spark, tmp_path):
    snap = spark.createDataFrame([(1, 1, True), (2, 1, True)], "project_id long, version int, is_active boolean")
    ST.write_snapshots(snap, str(tmp_path / "s"))
    assert (tmp_path / "s" / "project_id=1").is_dir()
    plan = spark.read.parquet(str(tmp_path / "s")).filter("project_id = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(project_id" in plan


def test_stream_takes_only_new_files(spark, tmp_path):
    drop, out = tmp_path / "drop", str(tmp_path / "out")
    ddl = "file_id bigint, text string"

    def run():
        rows = ST.paragraphs_of_text(I.read_drop_folder(spark, str(drop), ddl))
        I.append_stream(rows, f"{out}/rows", f"{out}/cp").awaitTermination()
        return spark.read.parquet(f"{out}/rows").count()

    spark.createDataFrame([(1, "a\nb")], ddl).write.parquet(str(drop), mode="append")
    assert run() == 2 and run() == 2
    spark.createDataFrame([(2, "c")], ddl).write.parquet(str(drop), mode="append")
    assert run() == 3


def test_merge_stream_writes_a_version_per_batch(spark, tmp_path):
    drop, out = str(tmp_path / "drop"), str(tmp_path / "out")
    ddl = "project_id bigint, pos bigint, file_id bigint, name string"

    def merge(both):
        return both.groupBy("project_id", "name").agg(F.min("pos").alias("pos"), F.min_by("file_id", "pos").alias("file_id")).select(
            "project_id", "pos", "file_id", "name")

    def run(rows):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(drop, mode="append")
        I.merge_stream(I.read_drop_folder(spark, drop, ddl), out, f"{out}/cp", merge, ddl).awaitTermination()
        return sorted((r.project_id, r["name"]) for r in I.active_rows(spark, out, ddl).collect())

    assert run([(1, 0, 1, "a"), (2, 0, 1, "z")]) == [(1, "a"), (2, "z")]
    assert run([(1, 0, 2, "a"), (1, 1, 2, "b")]) == [(1, "a"), (1, "b"), (2, "z")]
    assert {r.project_id: r.version for r in I.versions(spark, out).collect()} == {1: 2, 2: 1}
    # the old version is still there
    assert spark.read.parquet(f"{out}/model").filter("batch = 0").count() == 2


def test_upload_stream_and_quarantine(spark, tmp_path):
    up, out = tmp_path / "up", str(tmp_path / "out")
    up.mkdir()
    (up / "a.pdf").write_bytes(b"1")
    (up / "b.txt").write_bytes(b"22")

    def process(batch):
        name = F.regexp_extract("path", r"([^/]+)$", 1)
        return batch.select(name.alias("file_id"), F.lit(1).alias("attempt"), F.when(~name.endswith(".pdf"), "unbekannt").alias("error"))

    I.quarantine_stream(I.read_upload_folder(spark, str(up)), process, f"{out}/ok", f"{out}/bad", f"{out}/cp").awaitTermination()
    failed, ok = spark.read.parquet(f"{out}/bad"), spark.read.parquet(f"{out}/ok")
    assert [(r.file_id, r.error) for r in I.to_retry(failed, ok).collect()] == [("b.txt", "unbekannt")]


def test_late_log_rows_count(spark, tmp_path):
    """Three batches with falling times: without a limit every row counts."""
    from plumbline.streaming import intake

    rows = "n int, ts timestamp, user_id int, message string"
    for k, hour in enumerate((12, 9, 6)):
        data = [(i, datetime(2026, 1, 1, hour, i), 1, "Error") for i in range(10)]
        spark.createDataFrame(data, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = {}

    def step(batch, n):
        seen.update({r.window_start: r.total for r in batch.collect()})

    intake.log_counts(source, "ts", ["user_id"], "1 hour").writeStream.outputMode("update").option(
        "checkpointLocation", str(tmp_path / "cp")).foreachBatch(step).trigger(availableNow=True).start().awaitTermination()
    assert sum(seen.values()) == 30 and len(seen) == 3


def test_log_stream(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    for n, minute in enumerate(("00", "01", "59")):
        (folder / f"{n}.json").write_text(json.dumps({"fileId": 1, "logs": [
            {"timestamp": f"2026-01-01T10:{minute}:05Z", "message": "Error"}, {"timestamp": f"2026-01-01T10:{minute}:50Z", "message": "ok"}]}))
    counts = I.log_counts(I.read_log_stream(spark, str(folder)), "at", ["fileId"], "1 minute", "10 minutes")
    I.append_stream(counts, f"{out}/rows", f"{out}/cp").awaitTermination()
    got = sorted((str(r.window_start), r.total, r.errors) for r in spark.read.parquet(f"{out}/rows").collect())
    assert got == [("2026-01-01 10:00:00", 2, 1), ("2026-01-01 10:01:00", 2, 1)]


def test_a_page_reads_its_partitions_only(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("key"))
    L.write_listing(rows, [F.desc("key"), F.asc("id")], str(tmp_path / "list"))
    want = sorted(((-(i % 7), i) for i in range(1000)))
    for skip, limit in ((0, 5), (480, 40), (990, 100), (5000, 10), (0, 1000)):
        page = L.listing_page(spark, str(tmp_path / "list"), "id bigint, key bigint", skip, limit)
        assert [(r.id, r.place) for r in page.collect()] == [(i, skip + k + 1) for k, (_, i) in enumerate(want[skip:skip + limit])]
    plan = L.listing_page(spark, str(tmp_path / "list"), "id bigint, key bigint", 0, 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "_part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    L.write_listing(rows.limit(0), [F.asc("id")], str(tmp_path / "none"))
    assert L.listing_page(spark, str(tmp_path / "none"), "id bigint, key bigint").count() == 0


def test_drop_folder_takes_a_table_of_one_file_and_of_many(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(6)], "doc_id long, text string")
    rows.repartition(3).write.parquet(f"{tmp_path}/many/documents.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/raw")
    (tmp_path / "one").mkdir()
    next((tmp_path / "raw").glob("part-*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    for kind in ("many", "one"):
        rows.write.parquet(f"{tmp_path}/{kind}/other.parquet")
        docs = I.read_drop_folder(spark, f"{tmp_path}/{kind}", "doc_id bigint, text string", name_filter="documents.parquet")
        I.append_stream(docs, f"{tmp_path}/{kind}-out", f"{tmp_path}/{kind}-check").awaitTermination()
        assert sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/{kind}-out").collect()) == list(range(6))


def test_archives_reach_the_workers_in_batches_of_bounded_size(spark, tmp_path):
    import random

    from contract import streams
    from plumbline.sources import files as SF
    text = random.Random(1).randbytes(1 << 20).hex()
    spark.createDataFrame([(k, text) for k in range(1, 25)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [int(batch["content"].map(len).sum())]})

    archives = streams.archives(spark, str(tmp_path))
    most = archives.mapInPandas(sizes, "n long").agg(F.max("n")).first()[0]
    assert 0 < most <= 2 * SF.BATCH_BYTES
    assert SF.archive_members(archives).filter("error is null").count() == 3 * sum(k % 9 > 0 for k in range(1, 25))


def test_listing_reads_folders_in_few_tasks(spark, tmp_path):
    """Names, sizes and times as the reader gives them; tasks follow the folders, not 32 files each."""
    for k in range(400):
        folder = tmp_path / f"teil {k % 3}" / "innen" if k % 3 else tmp_path
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"Plan ä {k} 100%#.pdf").write_bytes(b"x" * k)
    for name in (".hidden", "_draft", "_a=1", "halb._COPYING_"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "_temporary").mkdir()
    (tmp_path / "_temporary" / "a.pdf").write_bytes(b"x")
    listed = SF.read_files(spark, str(tmp_path))
    known = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("path", "length", "modificationTime")
    assert listed.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism < known.rdd.getNumPartitions()
    assert sorted(listed.collect()) == sorted(known.collect())
    assert 399 <= listed.count() < 405  # one is empty
    assert SF.read_files(spark, f"file://{tmp_path}/teil 1").count() == 133

"""Sources, sinks and incremental jobs, on data that Spark derives from the given tables."""

import io
import json
import os
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from contract import query
from contract import standins as S
from contract.housekeeping import LOG
from contract.scalars import EXT, TYPE_SQL
from plumbline import schema
from plumbline.functions import vocabulary as V
from plumbline.session import scratch_path
from plumbline.sources import files as SF
from plumbline.sources import log_documents as LD
from plumbline.sources import tables as ST
from plumbline.streaming import intake as I
from plumbline.streaming import stateful as T


@query(f"""WITH {S.FILES}, e AS (SELECT *, {EXT} AS ext FROM files),
  t AS (SELECT *, {TYPE_SQL.split(' WHEN mime')[0]} ELSE 'Unknown' END AS file_type, ext IN ({', '.join(repr(x) for x in V.ALLOWED_EXTENSIONS)}) AS ok FROM e)
  SELECT 'up/' || name AS path, name, ext AS extension, file_type, size, ok AND size <= 524288000 AS accepted, CASE WHEN NOT ok THEN 'extension' WHEN size > 524288000 THEN 'size' END AS reason FROM t""")
def file_inventory(spark, sf):
    listing = S.file_register(spark, sf).select(F.concat(F.lit("up/"), "name").alias("path"), F.col("size").alias("length"))
    return SF.inventory(listing)


def archives(spark, sf):
    """Each document zipped: its text, a folder, and an inner archive that holds it again."""
    def pack(batches):
        for batch in batches:
            out, held = [], 0
            for k, text in zip(batch["doc_id"], batch["text"]):
                inner = io.BytesIO()
                with zipfile.ZipFile(inner, "w") as z:
                    z.writestr(f"kopie_{k}.docx", text)
                outer = io.BytesIO()
                with zipfile.ZipFile(outer, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(f"ordner/text_{k}.pdf", text)
                    z.writestr("ordner/", "")
                    z.writestr("innen.zip", inner.getvalue())
                    z.writestr("defekt.gz", b"no archive")
                out.append((f"a{k}.zip", outer.getvalue() if k % 9 else b"broken"))
                held += len(out[-1][1])
                if held >= SF.BATCH_BYTES:
                    yield pd.DataFrame(out, columns=["path", "content"])
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=["path", "content"])

    SF.small_batches(spark)
    return S.read(spark, sf, "documents").select("doc_id", "text").mapInPandas(pack, "path string, content binary")


@query("""SELECT 'a' || doc_id || '.zip' AS archive, 'text_' || doc_id || '.pdf' AS member, strlen(text) AS size, 'PDF' AS file_type, false AS failed FROM documents WHERE doc_id % 9 <> 0 UNION ALL
  SELECT 'a' || doc_id || '.zip', 'kopie_' || doc_id || '.docx', strlen(text), 'Word', false FROM documents WHERE doc_id % 9 <> 0 UNION ALL
  SELECT 'a' || doc_id || '.zip', 'defekt.gz', NULL, 'Unknown', true FROM documents WHERE doc_id % 9 <> 0 UNION ALL
  SELECT 'a' || doc_id || '.zip', NULL, NULL, 'Unknown', true FROM documents WHERE doc_id % 9 = 0""")
def archive_expansion(spark, sf):
    return SF.member_types(SF.expand_archives(archives(spark, sf))).select("archive", "member", "size", "file_type", F.col("error").isNotNull().alias("failed"))


@query("""SELECT 'a' || doc_id || '.zip' AS archive, 3::BIGINT AS file_count, 'defekt.gz|innen.zip|ordner/text_' || doc_id || '.pdf' AS files FROM documents WHERE doc_id % 9 <> 0""")
def archive_listing(spark, sf):
    return SF.archive_summary(SF.archive_members(archives(spark, sf))).select("archive", "file_count", F.concat_ws("|", "files").alias("files"))


@query("""WITH i AS (SELECT doc_id, lang, CASE doc_id % 5 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' WHEN 3 THEN 'bmp' ELSE 'unknown' END AS format,
    CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 8 WHEN 2 THEN 6 WHEN 3 THEN 2 ELSE 1 END + strlen(text) AS size_bytes FROM documents)
  SELECT doc_id % 3 AS file_id, lang AS sheet, doc_id AS position, 'IMG_' || (doc_id % 3) || '_' || lang || '_' || doc_id AS id, format, size_bytes FROM i""")
def image_inventory(spark, sf):
    k = F.col("doc_id")
    magic = (F.when(k % 5 == 0, "FFD8").when(k % 5 == 1, "89504E470D0A1A0A").when(k % 5 == 2, "474946383961").when(k % 5 == 3, "424D").otherwise("00"))
    images = S.read(spark, sf, "documents").select((k % 3).alias("file_id"), F.col("lang").alias("sheet"), k.alias("position"),
                                                   F.concat(F.unhex(magic), F.encode("text", "UTF-8")).alias("content"))
    return SF.image_inventory(images, per_sheet=None).drop("preview")


@query(f"""WITH {S.spaces_sql()} SELECT project_id, pos, id, name, area_m2, file FROM spaces WHERE pos % 2 = 0""")
def snapshot_json_round_trip(spark, sf):
    """Snapshots written as JSON lines and read back with the declared schema; only active ones count."""
    s = S.spaces(spark, sf)
    path = scratch_path(spark, "snapshots")
    s.select(F.col("pos").alias("project_id"), F.lit(1).alias("version"), (F.col("pos") % 2 == 0).alias("is_active"),
             F.struct(F.array(F.struct(*s.columns)).alias("spaces")).alias("data")).write.json(path)
    return ST.entity_rows(ST.read_snapshots(spark, path), "spaces").select("project_id", "pos", "id", "name", "area_m2", F.col("sources")[0]["file"].alias("file"))


@query("""SELECT user_id AS file_id, event_id AS idx, event_type AS message, props AS data FROM events""")
def event_log_source(spark, sf):
    """Events as nested log documents, one per event, written and read as JSON."""
    e = S.read(spark, sf, "events")
    path = scratch_path(spark, "logs")
    entry = F.struct(F.col("ts").cast("string").alias("timestamp"), F.col("event_type").alias("message"), F.col("props").alias("data"))
    e.select(F.col("user_id").alias("fileId"), F.col("event_id").cast("string").alias("filename"), F.array(entry).alias("logs")).write.json(path)
    logs = spark.read.schema(schema.EVENT_LOG).json(path)
    return ST.log_entries(logs).select(F.col("fileId").alias("file_id"), F.col("filename").cast("long").alias("idx"), "message", "data")


@query("""SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1""")
def json_lines_append(spark, sf):
    path = scratch_path(spark, "ndjson")
    ST.append_json_lines(S.read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag")), path)
    ST.append_json_lines(S.read(spark, sf, "orders").select(F.col("o_orderstatus").alias("flag")), path)
    return spark.read.schema("flag string").json(path).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part")
def report_sink(spark, sf):
    """A report written as csv and read back."""
    path = scratch_path(spark, "report")
    ST.write_report(S.read(spark, sf, "part").select("p_partkey", "p_name", F.col("p_size").cast("long").alias("p_size")), path, "csv")
    return spark.read.schema("p_partkey bigint, p_name string, p_size bigint").option("header", True).csv(path)


# --- incremental jobs ---------------------------------------------------------------------------------


@query("SELECT doc_id AS file_id, para_idx, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS para_idx FROM documents)")
def incremental_intake(spark, sf):
    """Documents as a drop folder: a stream takes what is new and appends its paragraphs."""
    out = scratch_path(spark, "intake")
    docs = I.read_drop_folder(spark, sf, "doc_id bigint, text string", name_filter="documents.parquet")
    rows = ST.paragraphs_of_text(docs.withColumnRenamed("doc_id", "file_id"))
    I.append_stream(rows, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("file_id", F.col("para_idx").cast("long").alias("para_idx"), "text")


@query("""SELECT p_partkey % 25 AS project_id, count(DISTINCT p_name) AS spaces, 1::BIGINT AS version FROM part GROUP BY 1""")
def incremental_merge(spark, sf):
    """Parts arrive as a stream; each batch merges by equal name into the next version of its projects."""
    out = scratch_path(spark, "merge")
    parts = I.read_drop_folder(spark, sf, "p_partkey bigint, p_name string", name_filter="part.parquet")
    rows = parts.select((F.col("p_partkey") % 25).alias("project_id"), F.col("p_partkey").alias("pos"), F.lit(0).cast("long").alias("file_id"), F.col("p_name").alias("name"))
    ddl = "project_id bigint, pos bigint, file_id bigint, name string"

    def merge(both):
        return both.groupBy("project_id", "name").agg(F.min("pos").alias("pos"), F.min_by("file_id", "pos").alias("file_id")).select("project_id", "pos", "file_id", "name")

    I.merge_stream(rows, out, f"{out}/checkpoint", merge, ddl).awaitTermination()
    counts = I.active_rows(spark, out, ddl).groupBy("project_id").agg(F.count(F.lit(1)).alias("spaces"))
    return counts.join(I.versions(spark, out), "project_id")


@query("""SELECT doc_id AS file_id, 'unbekannter Typ' AS error FROM documents WHERE lang = 'de' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def failed_files_to_retry(spark, sf):
    """A stream routes failures to a quarantine table; files that a later run took are not retried."""
    out = scratch_path(spark, "quarantine")
    docs = I.read_drop_folder(spark, sf, "doc_id bigint, lang string, text string", name_filter="documents.parquet")

    def process(batch):
        return batch.select(F.col("doc_id").alias("file_id"), F.lit(1).alias("attempt"), F.length("text").alias("n"),
                            F.when(F.col("lang") == "de", "unbekannter Typ").alias("error"))

    I.quarantine_stream(docs, process, f"{out}/ok", f"{out}/failed", f"{out}/checkpoint").awaitTermination()
    later = S.read(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("file_id"))
    done = spark.read.parquet(f"{out}/ok").select("file_id").unionByName(later)
    return I.to_retry(spark.read.parquet(f"{out}/failed"), done).select("file_id", "error")


@query(f"""WITH {LOG} SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id, count(*) AS total,
  count(*) FILTER (contains(lower(message), 'error') OR contains(lower(message), 'failed')) AS errors, count(*) FILTER (contains(lower(message), 'warn')) AS warnings FROM log GROUP BY 1, 2""")
def event_log_stream(spark, sf):
    """Windowed counts over the event stream; no row is late, and the sink keeps the last value of each window."""
    out = scratch_path(spark, "eventlog")
    events = I.read_drop_folder(spark, sf, "event_id bigint, ts timestamp, user_id bigint, event_type string", name_filter="events.parquet")
    t = F.col("event_type")
    message = F.when(t == "error", "Request FAILED").when(t == "view", "Warning: slow").when(t == "click", "error and warn").otherwise(t)
    counts = I.log_counts(events.withColumn("message", message), "ts", ["user_id"], "1 hour")

    def step(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    counts.writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").foreachBatch(step).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    last = rows.groupBy("window_start", "user_id").agg(F.max_by(F.struct("total", "errors", "warnings"), "batch").alias("v"))
    return last.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "user_id", "v.*")


# --- keyed state --------------------------------------------------------------------------------------

OUTCOMES = """o AS (SELECT event_id // 4 AS file_id, event_id, ts, CASE event_type WHEN 'click' THEN NULL WHEN 'error' THEN 'defekt' ELSE 'Zeit: ' || event_type END AS error,
    event_type NOT IN ('click', 'error') AS again, row_number() OVER w AS i, count(*) FILTER (event_type NOT IN ('click', 'error')) OVER w AS failures
    FROM events WINDOW w AS (PARTITION BY event_id // 4 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
  e AS (SELECT file_id, coalesce(min(i) FILTER (error IS NULL OR NOT again OR failures > 2), max(i)) AS last FROM o GROUP BY 1),
  s AS (SELECT o.file_id, o.i::INT AS attempts, o.error, CASE WHEN error IS NULL THEN 'done' WHEN NOT again THEN 'failed' WHEN failures > 2 THEN 'given up' ELSE 'waiting' END AS status,
    time_bucket(INTERVAL 1 MILLISECOND, ts) + INTERVAL 1 HOUR AS next_at FROM o JOIN e ON o.file_id = e.file_id AND o.i = e.last)"""


@query(f"""WITH {OUTCOMES} SELECT file_id, CASE WHEN status = 'waiting' AND next_at <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY THEN 'due' ELSE status END AS status,
  attempts, error FROM s""")
def file_retries(spark, sf):
    """Events as attempts of files: what each file's state is after all of them, and which retries are due."""
    out = scratch_path(spark, "retries")
    events = I.read_drop_folder(spark, sf, "event_id bigint, ts timestamp, event_type string", name_filter="events.parquet")
    kind = F.col("event_type")
    error = F.when(kind == "click", None).when(kind == "error", "defekt").otherwise(F.concat(F.lit("Zeit: "), kind))
    outcomes = events.select(F.floor(F.col("event_id") / 4).cast("long").alias("file_id"), F.col("event_id").alias("attempt_id"), F.col("ts").alias("at"),
                             error.alias("error"), (~kind.isin("click", "error")).alias("retryable"))
    T.write_batches(T.retry_states(outcomes, 2, "1 hour", "1 day"), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return T.latest_states(spark, f"{out}/rows").select("file_id", "status", "attempts", "error")


@query(f"""WITH {LOG}, w AS (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS total,
    count(*) FILTER (contains(lower(message), 'error') OR contains(lower(message), 'failed')) AS errors, count(*) FILTER (contains(lower(message), 'warn')) AS warnings FROM log GROUP BY 1, 2)
  SELECT user_id, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, total, errors, warnings,
    window_start + INTERVAL 1 HOUR <= max_at - INTERVAL 12 HOUR AS closed FROM w JOIN (SELECT user_id, time_bucket(INTERVAL 1 MILLISECOND, max(ts)) AS max_at FROM log GROUP BY 1) USING (user_id)""")
def log_windows_closed(spark, sf):
    """Every entry is saved twice and counted once; windows that the log has left far behind are closed."""
    out = scratch_path(spark, "windows")
    events = I.read_drop_folder(spark, sf, "event_id bigint, ts timestamp, user_id bigint, event_type string", name_filter="events.parquet")
    t = F.col("event_type")
    message = F.when(t == "error", "Request FAILED").when(t == "view", "Warning: slow").when(t == "click", "error and warn").otherwise(t)
    entries = events.select(F.col("user_id").alias("fileId"), F.col("ts").alias("at"), message.alias("message"), F.col("event_id").cast("string").alias("entry"),
                            F.explode(F.sequence(F.lit(1), F.lit(2))).alias("saved"))
    T.write_batches(T.log_windows(entries, "1 hour", "12 hours"), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    counts = T.window_counts(spark, f"{out}/rows")
    return counts.select(F.col("fileId").alias("user_id"), F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "total", "errors", "warnings", "closed")


@query("""SELECT user_id % 20 AS file_id, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) - 1 AS idx, event_type AS message, props AS data, 2::BIGINT AS readings FROM events""")
def log_documents_resaved(spark, sf):
    """Each log document is saved with half of its entries, taken by a stream, saved again under its name, and taken again."""
    out = scratch_path(spark, "saved").removeprefix("file:")
    events = S.read(spark, sf, "events").select((F.col("user_id") % 20).alias("file"), "event_id", "event_type", "props")

    def save(rows):
        doc = {"fileId": int(rows["file"].iat[0]), "filename": "log", "logs": [
            {"timestamp": None, "message": m, "data": d} for m, d in zip(*(rows.sort_values("event_id")[c] for c in ("event_type", "props")), strict=True)]}
        path = f"{out}/logs/{doc['fileId']}.json"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.part", "w", encoding="utf-8") as f:
            json.dump(doc, f)
        os.replace(f"{path}.part", path)
        return pd.DataFrame({"n": [len(rows)]})

    for part in (events.filter("event_id % 2 = 0"), events):
        part.groupBy("file").applyInPandas(save, "n long").agg(F.sum("n")).collect()
        stream = LD.stream_log_documents(spark, f"{out}/logs").writeStream.option("checkpointLocation", f"{out}/check").format("parquet").start(f"{out}/rows")
        stream.processAllAvailable()
        stream.stop()
    rows = spark.read.schema(LD.ROW).parquet(f"{out}/rows")
    readings = rows.groupBy("path").agg(F.countDistinct("modified").alias("readings"))
    return LD.newest_save(rows).join(readings, "path").select(F.col("fileId").alias("file_id"), F.col("idx").cast("long").alias("idx"), "message", "data", "readings")

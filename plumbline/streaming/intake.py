"""Incremental jobs: file intake, merge into a new version, retries, event-log counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline import schema
from plumbline.plans import lifecycle
from plumbline.plans.merge import in_arrival_order


def read_drop_folder(spark: SparkSession, path: str, row_schema: str, fmt: str = "parquet", files_per_batch: int = 1000,
                     name_filter: str | None = None) -> DataFrame:
    """Files of the folder as they arrive. `name_filter`, a glob, takes the files of that name and those in folders of that name."""
    reader = spark.readStream.schema(row_schema).format(fmt).option("maxFilesPerTrigger", files_per_batch)
    # braces make any name a pattern: a stream takes a plain path for a folder, and a table may be one file
    return reader.load(f"{path}/{{{name_filter}}}" if name_filter else path)


def read_upload_folder(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files as they arrive; the stream's checkpoint is the ledger of what was seen."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True).load(path)
    )


def append_stream(rows: DataFrame, out: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Process what is there, write it exactly once, stop."""
    return (
        rows.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start(out)
    )


def _read_or_empty(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The table, or no rows if nothing is there yet; any other failure is one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(ddl).parquet(path) if there else spark.createDataFrame([], ddl)


def merge_stream(rows: DataFrame, out: str, checkpoint: str, merge: Callable[[DataFrame], DataFrame], ddl: str) -> StreamingQuery:
    """Merge each micro-batch into the projects it touches and write those as a new version.

    A batch writes the folder of its own number, and the ledger says which projects it
    holds. The active rows of a project are those of its newest batch. A batch that is
    run again reads only older batches and overwrites its own folder.
    """
    spark = rows.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        touched = batch.select("project_id").distinct()
        old = active_rows(spark, out, ddl, before=batch_id).join(touched, "project_id", "left_semi").drop("batch")
        merged = merge(in_arrival_order(old, batch))
        merged.write.mode("overwrite").parquet(f"{out}/model/batch={batch_id}")
        touched.write.mode("overwrite").parquet(f"{out}/ledger/batch={batch_id}")
        batch.unpersist()

    return (
        rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
        .trigger(availableNow=True).start()
    )


def active_rows(spark: SparkSession, out: str, ddl: str, before: int | None = None) -> DataFrame:
    """Rows of the newest version of each project; `before` looks only at older batches."""
    ledger = _read_or_empty(spark, f"{out}/ledger", "project_id bigint, batch bigint")
    model = _read_or_empty(spark, f"{out}/model", f"{ddl}, batch bigint")
    if before is not None:
        ledger, model = ledger.filter(F.col("batch") < before), model.filter(F.col("batch") < before)
    newest = ledger.groupBy("project_id").agg(F.max("batch").alias("batch"))
    return model.join(newest, ["project_id", "batch"])


def versions(spark: SparkSession, out: str) -> DataFrame:
    """Version number of each project: how many batches have touched it."""
    ledger = _read_or_empty(spark, f"{out}/ledger", "project_id bigint, batch bigint")
    return ledger.groupBy("project_id").agg(F.count(F.lit(1)).alias("version"))


def quarantine_stream(files: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, failed: str,
                      checkpoint: str) -> StreamingQuery:
    """Route results and failures of each batch to two tables. `process` adds an `error` column."""
    def step(batch: DataFrame, batch_id: int) -> None:
        done = process(batch).persist()
        done.filter("error is null").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        done.filter("error is not null").write.mode("overwrite").parquet(f"{failed}/batch={batch_id}")
        done.unpersist()

    return (
        files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
        .trigger(availableNow=True).start()
    )


def to_retry(failed: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Failed files that no later run has processed, with their last error."""
    last = failed.groupBy("file_id").agg(F.max_by("error", "attempt").alias("error"), F.max("attempt").alias("attempt"))
    return last.join(succeeded.select("file_id"), "file_id", "left_anti")


def log_counts(entries: DataFrame, at: str, keys: list[str], window: str = "1 minute", late: str | None = None) -> DataFrame:
    """Entries, errors and warnings per window and key.

    Every row counts, however late, so a backfill does not depend on the order of its files; read it in update mode.
    For an endless stream, `late` closes windows that far behind, and drops the rows that come after.
    """
    counted = (entries if late is None else entries.withWatermark(at, late)).groupBy(F.window(at, window), *keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(lifecycle.is_error(F.col("message"))).alias("errors"),
        F.count_if(lifecycle.is_warning(F.col("message"))).alias("warnings"))
    return counted.select(F.col("window.start").alias("window_start"), *keys, "total", "errors", "warnings")


def read_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Log files as they are saved, one row per entry."""
    logs = spark.readStream.schema(schema.EVENT_LOG).option("multiLine", True).json(path)
    return logs.select("fileId", F.explode("logs").alias("l")).select(
        "fileId", F.to_timestamp("l.timestamp").alias("at"), "l.message")

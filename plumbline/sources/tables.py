"""Decoded inputs, snapshots, rule specifications, event logs and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import schema
from plumbline.functions import vocabulary as V

DECODED = {
    "files": schema.FILE, "cells": schema.CELL, "paragraphs": schema.PARAGRAPH, "doc_table_cells": schema.TABLE_CELL,
    "pages": schema.PAGE, "tokens": schema.TOKEN, "bim_objects": schema.MODEL_OBJECT, "bim_relations": schema.MODEL_RELATION,
}


def read_decoded(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """A decoded input table with its declared schema; csv and json work for the flat ones."""
    reader = spark.read.schema(DECODED[name])
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def paragraphs_of_text(files: DataFrame) -> DataFrame:
    """Paragraph rows of plain text files: (file_id, text) -> one row per line."""
    return files.select("file_id", F.posexplode(F.split("text", "\n")).alias("para_idx", "text")).select(
        "file_id", "para_idx", F.lit("Normal").alias("style"), "text")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Project snapshots from JSON, one document per line, with the whole declared model."""
    model = ", ".join(f"{name}: array<struct<{ddl}>>" for name, ddl in schema.ENTITIES.items())
    return spark.read.schema(
        f"project_id bigint, version int, is_active boolean, created_at timestamp, data struct<{model}>").json(path)


def write_snapshots(snapshots: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by project, so that a reader of one project opens its folder only."""
    snapshots.write.mode(mode).partitionBy("project_id").parquet(path)


def entity_rows(snapshots: DataFrame, kind: str) -> DataFrame:
    """One entity list of the active snapshots as rows."""
    return snapshots.filter("is_active").select("project_id", F.explode(f"data.{kind}").alias("e")).select("e.*")


def read_spec(spark: SparkSession, path: str | None = None) -> dict:
    """Offer specification from YAML or JSON. The file is a hand-written rule list."""
    if path is None:
        return V.OFFER_SPEC
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def spec_rules(spark: SparkSession, spec: dict) -> DataFrame:
    """The specification as rows (section, rule, value)."""
    rows = []
    for section, body in (spec.get("mindestanforderungen") or {}).items():
        rows += [(section, "required", f) for f in body.get("erforderliche_felder", [])]
        if "min_anzahl" in body:
            rows.append((section, "minimum", str(body["min_anzahl"])))
    for p in spec.get("sia_phasen") or []:
        rows += [(p["phase"], "service", s) for s in p["erforderliche_leistungen"]]
    for section, body in (spec.get("plausibilitaetsgrenzen") or {}).items():
        rows += [(section, key, str(value)) for key, value in body.items()]
    return spark.createDataFrame(rows, "section string, rule string, value string")


def read_event_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.EVENT_LOG).option("multiLine", True).json(path)


def log_entries(logs: DataFrame) -> DataFrame:
    return logs.select("fileId", "filename", F.col("timestamp").alias("session"), F.posexplode("logs").alias("idx", "l")).select(
        "fileId", "filename", "session", "idx", F.col("l.timestamp").alias("at"), "l.message", "l.data")


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Content rows of a report."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)

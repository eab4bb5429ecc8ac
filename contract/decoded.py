"""Sources read from files: what the decoders would leave behind is written first, then read as a job reads it."""

import os
import zlib

import pandas as pd
from pyspark.sql import functions as F

from contract import ORACLES, query
from contract import extraction as E
from contract import standins as S
from contract.scalars import EXT, TYPE_SQL
from plumbline.functions import vocabulary as V
from plumbline.plans import extract_model as EM
from plumbline.plans import extract_tables as ET
from plumbline.session import scratch_path
from plumbline.sources import files as SF
from plumbline.sources import tables as ST


def _written(spark, name, rows, fmt="parquet"):
    """The decoded table after a round trip through files."""
    path = scratch_path(spark, name)
    rows.write.option("header", True).format(fmt).save(path)
    return ST.read_decoded(spark, name, path, fmt)


@query(ORACLES["spaces_from_model"])
def spaces_from_written_model(spark, sf):
    objects, relations = _written(spark, "bim_objects", E.model_objects(spark, sf)), _written(spark, "bim_relations", E.model_relations(spark, sf, dealt=15), "json")
    return EM.spaces_from_model(objects, relations).select("file_id", "id", "name", "number", "usage", "storey", "zone", "area_m2", "height_m")


@query(ORACLES["spaces_from_sheets"])
def spaces_from_written_sheets(spark, sf):
    rows = ET.sheet_rows(_written(spark, "cells", E.cells(spark, sf)))
    return ET.spaces_from_sheets(rows, ET.sheet_layout(rows)).drop("sheet").withColumn("row", F.col("row").cast("long"))


@query(ORACLES["layout_lines"])
def layout_lines_written(spark, sf):
    return ET.layout_lines(_written(spark, "tokens", E.tokens(spark, sf))).select("file_id", "band", "tokens", "line")


@query(f"""WITH {S.FILES}, e AS (SELECT f.* EXCLUDE (size), {EXT.replace('name', 'f.name')} AS ext, strlen(d.text) AS size FROM files f JOIN documents d ON d.doc_id = f.file_id),
  t AS (SELECT *, {TYPE_SQL.split(' WHEN mime')[0]} ELSE 'Unknown' END AS file_type, ext IN ({', '.join(repr(x) for x in V.ALLOWED_EXTENSIONS)}) AS ok FROM e)
  SELECT name, ext AS extension, file_type, size, ok AND size <= 524288000 AS accepted, CASE WHEN NOT ok THEN 'extension' WHEN size > 524288000 THEN 'size' END AS reason FROM t""")
def file_scan(spark, sf):
    """Each document as a file of its own; the scan lists names and sizes without reading them."""
    folder = scratch_path(spark, "uploads").removeprefix("file:")

    def save(batches):
        for batch in batches:
            for name, text in zip(batch["name"], batch["text"], strict=True):
                # one flat folder would make all writers wait for each other
                within = f"{folder}/{zlib.crc32(name.encode()) % 1000:03}"
                os.makedirs(within, exist_ok=True)
                with open(f"{within}/{name}", "wb") as f:
                    f.write(text.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    texts = S.read(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "text")
    S.file_register(spark, sf).select("file_id", "name").join(texts, "file_id").select("name", "text").mapInPandas(save, "n long").agg(F.sum("n")).collect()
    return SF.inventory(SF.read_files(spark, folder)).drop("path")

"""Extraction from text, tables, layouts and building models."""

from pyspark.sql import functions as F

from contract import query
from contract import standins as S
from contract.scalars import any_sql, label_sql
from plumbline.functions import text as X
from plumbline.functions import vocabulary as V
from plumbline.plans import extract_model as EM
from plumbline.plans import extract_tables as ET
from plumbline.plans import extract_text as E
from plumbline.plans import lifecycle as L

HEADING = "contains(lower(style), 'heading') OR contains(lower(style), 'überschrift')"
SECTIONED = f"""WITH {S.PARAGRAPHS}, p AS (SELECT *, last_value(CASE WHEN {HEADING} THEN lower(text) END IGNORE NULLS) OVER (
    PARTITION BY file_id ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section, lower(text) AS t FROM paragraphs WHERE text <> '')"""


@query(f"""WITH {S.PARAGRAPHS} SELECT file_id, lower(text) AS section, CASE WHEN contains(lower(style), '2') THEN 2 ELSE 1 END AS level, para_idx
  FROM paragraphs WHERE text <> '' AND ({HEADING})""")
def section_outline(spark, sf):
    return E.sections(S.paragraphs(spark, sf)).select("file_id", "section", F.col("level").cast("long").alias("level"), F.col("para_idx").cast("long").alias("para_idx"))


@query(SECTIONED + f""" SELECT file_id, 'REQ_' || lpad(para_idx::VARCHAR, greatest(4, length(para_idx::VARCHAR))::INT, '0') AS id, text,
  {label_sql('t', V.REQUIREMENT_CATEGORIES, "'allgemein'")} AS category, {label_sql('t', V.PRIORITY_WORDS, "'mittel'")} AS priority,
  coalesce({label_sql('t', V.PHASE_WORDS)}, 'SIA ' || coalesce(nullif(regexp_extract(t, 'sia\\s*(\\d+)', 1), ''), nullif(regexp_extract(t, 'phase\\s*(\\d+)', 1), ''))) AS phase, section
  FROM p WHERE {any_sql('t', V.REQUIREMENT_WORDS)}""")
def requirements_from_paragraphs(spark, sf):
    return E.requirements_from_paragraphs(S.paragraphs(spark, sf)).drop("para_idx")


@query(f"""WITH {S.PARAGRAPHS} SELECT file_id, 'REQ_LIST_' || lpad(para_idx::VARCHAR, greatest(4, length(para_idx::VARCHAR))::INT, '0') AS id, text, 'liste' AS source_kind
  FROM paragraphs WHERE text <> '' AND style LIKE 'List%' AND {any_sql('text', V.LIST_REQUIREMENT_WORDS)}""")
def requirements_from_lists(spark, sf):
    return E.requirements_from_lists(S.paragraphs(spark, sf)).select("file_id", "id", "text", "source_kind")


BLANK_LINES = f"""{S.DOCS}, t AS (SELECT file_id, string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10)) AS p FROM docs),
  kept AS (SELECT file_id, [x FOR x IN list_transform(p, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) IF length(x) >= 20] AS p FROM t),
  paras AS (SELECT file_id, unnest(p) AS text, unnest(range(0, len(p))) AS idx FROM kept)"""


def _blank_line_docs(spark, sf):
    return S.docs(spark, sf).select("file_id", F.replace("text", F.lit(".\n"), F.lit(".\n\n")).alias("text"))


@query(f"WITH {BLANK_LINES} SELECT file_id, 'ANF_' || lpad(idx::VARCHAR, greatest(4, length(idx::VARCHAR))::INT, '0') AS id, text, idx FROM paras")
def requirements_from_pages(spark, sf):
    """Every long paragraph of every text, uncut."""
    return E.requirements_from_pages(_blank_line_docs(spark, sf), limit=None, longest=None).withColumn("idx", F.col("idx").cast("long"))


@query(f"WITH {S.DOCS}, l AS (SELECT file_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM docs) "
       f"SELECT file_id, i AS line_idx, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS text FROM l WHERE {any_sql('line', V.LINE_REQUIREMENT_WORDS)}")
def requirements_from_lines(spark, sf):
    return E.requirements_from_lines(S.docs(spark, sf)).select("file_id", F.col("line_idx").cast("long").alias("line_idx"), "text")


@query("SELECT doc_id AS file_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 50 AS needs_scan FROM documents")
def scan_fallback(spark, sf):
    return S.read(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), E.needs_scan("text").alias("needs_scan"))


@query("""SELECT conv_id AS file_id, string_agg('--- Seite ' || (turn + 1) || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text, 0::BIGINT AS part
  FROM conversations WHERE text <> '' GROUP BY 1""")
def page_text(spark, sf):
    pages = S.read(spark, sf, "conversations").select(F.col("conv_id").alias("file_id"), (F.col("turn") + 1).alias("page"), "text")
    return E.page_text(pages)


@query("""WITH w AS (SELECT doc_id AS file_id, count(*) AS paragraphs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents) GROUP BY 1),
  i AS (SELECT doc_id, count(*) AS n FROM labels WHERE toxic = 1 GROUP BY 1), t AS (SELECT conv_id, count(DISTINCT turn) AS n FROM conversations GROUP BY 1)
  SELECT coalesce(w.file_id, t.conv_id) AS file_id, coalesce(paragraphs, 0) AS paragraphs, coalesce(t.n, 0) AS tables, coalesce(i.n, 0) AS images, coalesce(i.n, 0) > 0 AS has_images
  FROM w FULL JOIN t ON t.conv_id = w.file_id LEFT JOIN i ON i.doc_id = coalesce(w.file_id, t.conv_id)""")
def document_statistics(spark, sf):
    p = S.lines(spark, sf).select("file_id")
    t = S.read(spark, sf, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("table_idx"))
    i = S.read(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("file_id"))
    return L.document_statistics(p, t, i)


# --- spreadsheet cells -----------------------------------------------------------------
# Each 500 parts make one file with a sheet of spaces: a title row left empty, headers in row 2.

HEADERS = ["Raum Nr", "Fläche m²", "Volumen", "Höhe", "Nutzungsart", "Geschoss", None, "Bezeichnung"]


def cells(spark, sf, sheet="Raumliste", headers=HEADERS, values=None):
    part = S.read(spark, sf, "part").withColumn("file_id", F.floor(F.col("p_partkey") / 500)).withColumn("row", (F.col("p_partkey") % 500 + 3).cast("int"))
    k = F.col("p_partkey")
    name = F.when(k % 50 == 7, "Summe").when(k % 41 == 5, "").otherwise(F.concat("p_name", F.lit(" "), k.cast("string")))
    values = values or [
        (F.lit("alt"), "s"), (F.concat((k % 97).cast("string"), F.lit(",5 m²")), "s"), ((k % 31).cast("string"), "n"),
        (F.when(k % 5 != 0, "ca 2.5"), "s"), (F.concat(F.lit("  "), "p_type", F.lit("\t")), "s"), (F.col("p_brand"), "s"), (F.lit("0"), "n"), (name, "s")]
    body = F.array(*[F.struct(F.lit(i).alias("col"), v.cast("string").alias("value"), F.lit(t).alias("dtype")) for i, (v, t) in enumerate(values, 1)])
    head = F.array(*[F.struct(F.lit(i).alias("col"), F.lit(h).cast("string").alias("value"), F.lit("s").alias("dtype")) for i, h in enumerate(headers, 1)])
    rows = part.select("file_id", F.lit(sheet).alias("sheet"), "row", F.inline(body))
    heads = part.select("file_id").distinct().select("file_id", F.lit(sheet).alias("sheet"), F.lit(2).alias("row"), F.inline(head))
    return rows.unionByName(heads)


PART = """p AS (SELECT p_partkey // 500 AS file_id, p_partkey % 500 + 3 AS row, p_partkey AS k, *,
  CASE WHEN p_partkey % 50 = 7 THEN 'Summe' WHEN p_partkey % 41 = 5 THEN '' ELSE p_name || ' ' || p_partkey END AS name FROM part)"""


def _sheet(spark, sf, **kw):
    rows = ET.sheet_rows(cells(spark, sf, **kw))
    return rows, ET.sheet_layout(rows)


@query(f"""WITH {PART} SELECT file_id, row, 'Raum_' || replace(name, ' ', '_') AS id, name, name AS number, ((k % 97) || '.5')::DOUBLE AS area_m2, (k % 31)::DOUBLE AS volume_m3,
  CASE WHEN k % 5 <> 0 THEN 2.5::DOUBLE END AS height_m, p_type AS usage, p_brand AS storey, NULL::VARCHAR AS zone FROM p WHERE name NOT IN ('', 'Summe')""")
def spaces_from_sheets(spark, sf):
    rows, layout = _sheet(spark, sf)
    return ET.spaces_from_sheets(rows, layout).drop("sheet").withColumn("row", F.col("row").cast("long"))


def _machine_sheet(spark, sf):
    k = F.col("p_partkey")
    return _sheet(spark, sf, sheet="Gerätetabelle", headers=["Typ", "Name", "Leistung kW", "Anlage", "Raum"], values=[
        (F.when(k % 4 != 0, F.col("p_type")), "s"), (F.when(k % 3 != 0, F.col("p_name")), "s"), ((k % 77).cast("string"), "n"),
        (F.concat(F.lit("S"), (k % 9).cast("string")), "s"), (F.when(k % 2 == 0, F.concat(F.lit("R"), k.cast("string"))), "s")])


@query(f"""WITH {PART}, g AS (SELECT file_id, row, k, CASE WHEN k % 4 <> 0 THEN p_type END AS kind, CASE WHEN k % 3 <> 0 THEN p_name END AS nm FROM p),
  h AS (SELECT *, coalesce(nm, kind) AS name FROM g)
  SELECT file_id, row, 'GER_' || replace(name, ' ', '_') || '_' || row AS id, coalesce(kind, name) AS kind, name, (k % 77)::DOUBLE AS power_kw, 'S' || (k % 9) AS system_id,
    CASE WHEN k % 2 = 0 THEN 'R' || k END AS space_id FROM h WHERE name IS NOT NULL""")
def equipment_from_sheets(spark, sf):
    rows, layout = _machine_sheet(spark, sf)
    return ET.equipment_from_sheets(rows, layout).drop("sheet").withColumn("row", F.col("row").cast("long"))


@query(f"""WITH {PART} SELECT file_id, row, 'ANL_' || replace(p_name, ' ', '_') || '_' || row AS id, coalesce(CASE WHEN k % 4 <> 0 THEN p_type END, p_name) AS kind, p_name AS name,
  (k % 77)::DOUBLE AS power_kw, (k % 1000 || '.0')::DOUBLE AS flow_m3h FROM p""")
def systems_from_sheets(spark, sf):
    k = F.col("p_partkey")
    rows, layout = _sheet(spark, sf, sheet="Anlagen", headers=["Anlage", "Typ", "kW", "Luftmenge m3/h"], values=[
        (F.col("p_name"), "s"), (F.when(k % 4 != 0, F.col("p_type")), "s"), ((k % 77).cast("string"), "n"), (F.concat((k % 1000).cast("string"), F.lit(" m3/h")), "s")])
    return ET.systems_from_sheets(rows, layout).drop("sheet").withColumn("row", F.col("row").cast("long"))


@query(f"""WITH {PART} SELECT file_id, row, 'TERM_' || lpad(row::VARCHAR, 4, '0') AS id, p_name AS text,
  CASE k % 3 WHEN 0 THEN '2026-' || lpad((k % 12 + 1)::VARCHAR, 2, '0') || '-01T00:00:00' WHEN 1 THEN 'KW ' || (k % 52) END AS due,
  CASE WHEN k % 2 = 0 THEN p_type ELSE 'Meilenstein' END AS category, p_brand AS phase FROM p""")
def milestones_from_sheets(spark, sf):
    k = F.col("p_partkey")
    day = F.concat(F.lit("2026-"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("-01 00:00:00"))
    c = cells(spark, sf, sheet="Terminplan", headers=["Aufgabe", "Datum", "Art", "SIA Phase"], values=[
        (F.col("p_name"), "s"), (F.when(k % 3 == 0, day).when(k % 3 == 1, F.concat(F.lit("KW "), (k % 52).cast("string"))), "s"),
        (F.when(k % 2 == 0, F.col("p_type")), "s"), (F.col("p_brand"), "s")])
    c = c.withColumn("dtype", F.when((F.col("col") == 2) & F.col("value").startswith("2026-"), "d").otherwise(F.col("dtype")))
    rows = ET.sheet_rows(c)
    return ET.milestones_from_sheets(rows, ET.sheet_layout(rows)).drop("sheet").withColumn("row", F.col("row").cast("long"))


@query(f"""WITH {PART} SELECT file_id, row, 'LEIST_' || lpad(row::VARCHAR, 4, '0') AS id, p_name AS text, 'h' AS unit, (k % 40)::DOUBLE AS quantity, p_brand AS phase, p_type AS category FROM p""")
def services_from_sheets(spark, sf):
    rows, layout = _sheet(spark, sf, sheet="LV", headers=["Position", "Einheit", "Menge", "Phase", "Kategorie"], values=[
        (F.col("p_name"), "s"), (F.lit("h"), "s"), ((F.col("p_partkey") % 40).cast("string"), "n"), (F.col("p_brand"), "s"), (F.col("p_type"), "s")])
    return ET.services_from_sheets(rows, layout).drop("sheet").withColumn("row", F.col("row").cast("long"))


@query(f"""WITH {PART} SELECT file_id, row, (k % 97) || ',5 m²' AS area, name AS label, '0' AS blank, 8 AS width FROM p""")
def raw_table_rows(spark, sf):
    """Every row as header -> text map; the header without a text got its placeholder."""
    rows, layout = _sheet(spark, sf)
    v = F.col("values")
    return ET.raw_rows(rows, layout).select(
        "file_id", F.col("row").cast("long").alias("row"), v["Fläche m²"].alias("area"), v["Bezeichnung"].alias("label"), v["Spalte_7"].alias("blank"),
        F.size(v).cast("long").alias("width"))


@query(f"WITH {PART} SELECT file_id, count(*) AS row_count, 2::BIGINT AS header_row, 8::BIGINT AS column_count FROM p GROUP BY 1")
def raw_table_summary(spark, sf):
    rows, layout = _sheet(spark, sf)
    return ET.raw_table_summary(ET.raw_rows(rows, layout), layout).select("file_id", "row_count", F.col("header_row").cast("long").alias("header_row"), "column_count")


@query(f"""WITH {PART} SELECT file_id, 'raumliste' AS kind, 2::BIGINT AS header_row, max(row) AS max_row, false AS has_formulas,
  'Raum Nr|Fläche m²|Volumen|Höhe|Nutzungsart|Geschoss|Spalte_7|Bezeichnung' AS headers FROM p GROUP BY 1""")
def sheet_metadata(spark, sf):
    _, layout = _sheet(spark, sf)
    return layout.select("file_id", "kind", F.col("header_row").cast("long").alias("header_row"), F.col("max_row").cast("long").alias("max_row"), "has_formulas",
                         F.concat_ws("|", ET.header_list(F.col("header_cells"), F.col("max_col"))).alias("headers"))


@query(f"""WITH {PART} SELECT file_id, k AS row, 'B' || k AS cell, p_brand AS content FROM p WHERE k % 500 < 20""")
def loose_cells(spark, sf):
    """Texts above the header row of a sheet."""
    part = S.read(spark, sf, "part")
    k = F.col("p_partkey")
    c = part.select(F.floor(k / 500).alias("file_id"), F.lit("Blatt").alias("sheet"), k.cast("int").alias("row"), F.lit(2).alias("col"), F.col("p_brand").alias("value"), F.lit("s").alias("dtype"))
    layout = c.select("file_id", "sheet").distinct().withColumn("header_row", (F.col("file_id") * 500 + 20).cast("int"))
    above = ET.loose_cells(c, layout)
    return above.select("file_id", F.col("row").cast("long").alias("row"), "cell", "content")


# --- tables of documents and layouts ------------------------------------------------------


def _table_cells(spark, sf, headers, values):
    part = S.read(spark, sf, "part").withColumn("file_id", F.floor(F.col("p_partkey") / 100)).withColumn("row", (F.col("p_partkey") % 100 + 1).cast("int"))
    body = F.array(*[F.struct(F.lit(i).alias("col"), v.cast("string").alias("text")) for i, v in enumerate(values)])
    head = F.array(*[F.struct(F.lit(i).alias("col"), F.lit(h).alias("text")) for i, h in enumerate(headers)])
    return part.select("file_id", F.lit(0).alias("table_idx"), "row", F.inline(body)).unionByName(
        part.select("file_id").distinct().select("file_id", F.lit(0).alias("table_idx"), F.lit(0).alias("row"), F.inline(head)))


DOC_PART = "p AS (SELECT p_partkey // 100 AS file_id, p_partkey % 100 + 1 AS row, p_partkey AS k, * FROM part)"


@query(f"""WITH {DOC_PART} SELECT file_id, row, 'Raum_' || replace(p_name, ' ', '_') || '_0_' || row AS id, p_name AS name, CASE WHEN k % 3 <> 0 THEN ((k % 60) || '.25')::DOUBLE END AS area_m2,
  p_type AS usage FROM p""")
def spaces_from_documents(spark, sf):
    k = F.col("p_partkey")
    c = _table_cells(spark, sf, ["Raum", "Fläche", "Nutzung"], [
        F.col("p_name"), F.when(k % 3 == 0, "ca. 20").otherwise(F.concat(F.lit(" "), (k % 60).cast("string"), F.lit(",25 "))), F.concat("p_type", F.lit(" "))])
    return ET.spaces_from_documents(ET.document_rows(c)).select("file_id", F.col("row").cast("long").alias("row"), "id", "name", "area_m2", "usage")


@query(f"""WITH {DOC_PART} SELECT file_id, row, 'GER_0_' || row AS id, CASE WHEN k % 4 = 0 THEN '' ELSE p_name END AS name, p_type AS kind, (k % 60)::DOUBLE AS power_kw FROM p""")
def equipment_from_documents(spark, sf):
    k = F.col("p_partkey")
    c = _table_cells(spark, sf, ["Gerät", "Typ", "kW"], [F.when(k % 4 == 0, "").otherwise(F.col("p_name")), F.col("p_type"), (k % 60).cast("string")])
    return ET.equipment_from_documents(ET.document_rows(c)).select("file_id", F.col("row").cast("long").alias("row"), "id", "name", "kind", "power_kw")


@query(f"""WITH {DOC_PART} SELECT file_id, row, 'TERM_0_' || row AS id, p_name AS text, 'KW ' || (k % 52) AS due FROM p WHERE k % 7 <> 0""")
def milestones_from_documents(spark, sf):
    k = F.col("p_partkey")
    c = _table_cells(spark, sf, ["Aufgabe", "Termin"], [F.when(k % 7 == 0, "").otherwise(F.col("p_name")), F.concat(F.lit("KW "), (k % 52).cast("string"))])
    return ET.milestones_from_documents(ET.document_rows(c)).select("file_id", F.col("row").cast("long").alias("row"), "id", "text", "due")


@query(f"""WITH {DOC_PART} SELECT file_id, row, p_brand AS last_wins, p_type AS second, 2 AS width FROM p""")
def raw_document_rows(spark, sf):
    """Two equal headers: the last column wins; a blank header has its placeholder."""
    c = _table_cells(spark, sf, ["A", "", "A"], [F.col("p_name"), F.col("p_type"), F.col("p_brand")])
    v = F.col("values")
    return ET.raw_document_rows(ET.document_rows(c)).select(
        "file_id", F.col("row").cast("long").alias("row"), v["A"].alias("last_wins"), v["Spalte_2"].alias("second"), F.size(v).cast("long").alias("width"))


def tokens(spark, sf):
    """Words of conversation turns laid out on a page: one band per turn, from right to left."""
    c = S.read(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "w"))
    return c.select(F.col("conv_id").alias("file_id"), F.lit(1).alias("page"), F.col("w").alias("text"), (F.lit(10_000_000) - F.col("i")).alias("left"),
                    (F.col("turn") * 20 + F.col("i") % 20 - 40).cast("int").alias("top"), F.lit(5).alias("width"))


@query("""WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, unnest(range(0, len(string_split(text, ' ')))) AS i FROM conversations)
  SELECT conv_id AS file_id, (turn - 2)::BIGINT AS band, count(*) AS tokens, string_agg(w, ' ' ORDER BY i DESC) AS line FROM w WHERE trim(w) <> '' GROUP BY ALL""")
def layout_lines(spark, sf):
    """Reading order: by band, then by left edge; negative heights fall into their own band."""
    return ET.layout_lines(tokens(spark, sf)).select("file_id", "band", "tokens", "line")


@query("""WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM conversations), b AS (SELECT conv_id, turn, count(*) AS n FROM w WHERE trim(w) <> '' GROUP BY ALL)
  SELECT conv_id AS file_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS row, n AS width FROM b WHERE n >= 2""")
def layout_table_rows(spark, sf):
    rows = ET.layout_rows(tokens(spark, sf))
    return rows.select("file_id", F.col("row").cast("long").alias("row"), F.size("values").cast("long").alias("width"))


@query("""WITH p AS (SELECT p_partkey // 100 AS page, p_partkey % 100 + 1 AS row, * FROM part)
  SELECT page AS table_idx, row, 'Raum_' || replace(p_name, ' ', '_') || '_' || page || '_' || row AS id, replace(p_name, ' ', '_') AS name, ((p_partkey % 60) || '.5')::DOUBLE AS area_m2 FROM p""")
def spaces_from_layout(spark, sf):
    """A table found in layout tokens, one table per page."""
    k = F.col("p_partkey")
    part = S.read(spark, sf, "part").withColumn("page", F.floor(k / 100).cast("int")).withColumn("row", (k % 100 + 1).cast("int"))
    body = F.array(F.struct(F.replace("p_name", F.lit(" "), F.lit("_")).alias("text"), F.lit(10).alias("left")),
                   F.struct(F.concat((k % 60).cast("string"), F.lit(",5")).alias("text"), F.lit(200).alias("left")))
    head = F.array(F.struct(F.lit("Raum").alias("text"), F.lit(10).alias("left")), F.struct(F.lit("Fläche").alias("text"), F.lit(200).alias("left")))
    t = part.select("page", F.col("row"), F.inline(body)).unionByName(part.select("page").distinct().select("page", F.lit(0).alias("row"), F.inline(head)))
    t = t.select(F.lit(1).cast("long").alias("file_id"), "page", "text", "left", (F.col("row") * 40 + 5).alias("top"), F.lit(9).alias("width"))
    return ET.spaces_from_documents(ET.layout_rows(t)).select(F.col("table_idx").cast("long").alias("table_idx"), F.col("row").cast("long").alias("row"), "id", "name", "area_m2")


# --- building models --------------------------------------------------------------------------


def model_objects(spark, sf):
    """Customers are spaces, their segments zones, order priorities storeys, suppliers systems, parts equipment."""
    def obj(df, file_id, schema, guid, cls, name, long_name=None, object_type=None, system_type=None, psets=None):
        none = F.lit(None).cast("string")
        pick = lambda c: none if c is None else c
        return df.select(file_id.cast("long").alias("file_id"), schema.alias("schema"), guid.alias("guid"), cls.alias("class"), pick(name).alias("name"),
                         pick(long_name).alias("long_name"), pick(object_type).alias("object_type"), pick(system_type).alias("system_type"),
                         (F.lit(None) if psets is None else psets).cast("map<string,map<string,string>>").alias("psets"))

    c, s, p, n = (S.read(spark, sf, t) for t in ("customer", "supplier", "part", "nation"))
    key = F.col("c_custkey")
    space_sets = F.create_map(
        F.lit("Pset_SpaceCommon"), F.create_map(F.lit("Usage"), F.col("c_mktsegment"), F.lit("Level"), F.lit("EG")),
        F.lit("Mengen"), F.create_map(F.lit("NetFloorArea"), F.when(key % 3 != 0, (key % 50).cast("string")).otherwise("0"), F.lit("GrossFloorArea"), (key % 60).cast("string"),
                                      F.lit("Height"), F.lit("2.5")))
    schema = F.lit("IFC4")
    spaces = obj(c, F.col("c_nationkey"), schema, F.concat(F.lit("C"), key.cast("string")), F.lit("IfcSpace"), F.col("c_name"),
                 F.when(key % 2 == 0, F.concat(F.lit("Zimmer "), key.cast("string"))), psets=space_sets)
    zones = obj(c.select("c_nationkey", "c_mktsegment").distinct(), F.col("c_nationkey"), schema, F.concat(F.lit("Z"), F.col("c_mktsegment")), F.lit("IfcZone"),
                F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    storeys = obj(n, F.col("n_nationkey"), schema, F.lit("ST"), F.lit("IfcBuildingStorey"), F.col("n_name"))
    k = F.col("s_suppkey")
    systems = obj(s, F.col("s_nationkey"), schema, F.concat(F.lit("S"), k.cast("string")), F.lit("IfcSystem"), F.col("s_name"),
                  system_type=F.when(k % 3 == 0, "HVAC supply").when(k % 3 == 1, "Sanitär").otherwise("Electrical"),
                  psets=F.create_map(F.lit("P"), F.create_map(F.lit("Power"), k.cast("string"), F.lit("AirFlowRate"), F.concat(k.cast("string"), F.lit("0")))))
    q = F.col("p_partkey")
    cls = (F.when(q % 4 == 0, "IfcPump").when(q % 4 == 1, "IfcMechanicalEquipment").when(q % 4 == 2, "IfcFlowTerminal").otherwise("IfcWall"))
    parts = obj(p, F.lit(100) + q % 3, F.when(q % 3 == 0, "IFC2X3 TC1").when(q % 3 == 1, "IFC4"), F.concat(F.lit("E"), q.cast("string")), cls, F.col("p_name"),
                object_type=F.when(q % 5 != 0, F.col("p_type")),
                psets=F.create_map(F.lit("Pset_MechanicalEquipment"), F.create_map(F.lit("Power"), F.lit("0"), F.lit("TotalPower"), (q % 80).cast("string")),
                                   F.lit("Pset_FlowTerminal"), F.create_map(F.lit("FlowRate"), (q % 90).cast("string"))))
    out = spaces
    for df in (zones, storeys, systems, parts):
        out = out.unionByName(df)
    return out


#: Pairs of system and space that one task makes, about.
RELATIONS_DEALT = 500_000


def model_relations(spark, sf, dealt=None):
    """Relations of the model. dealt: a supplier serves that many customers at most, so that a written model grows as its tables do."""
    c = S.read(spark, sf, "customer")
    key = F.col("c_custkey")
    space = F.concat(F.lit("C"), key.cast("string"))

    def rel(df, cls, order, a, b):
        return df.select(F.col("c_nationkey").cast("long").alias("file_id"), order.cast("int").alias("rel_order"), F.lit(cls).alias("rel_class"),
                         a.alias("relating_guid"), b.alias("related_guid"))

    zone = rel(c, "IfcRelAssignsToGroup", key * 2, F.concat(F.lit("Z"), F.col("c_mktsegment")), space)
    storey = rel(c.filter("c_custkey % 5 <> 0"), "IfcRelContainedInSpatialStructure", key, F.lit("ST"), space)
    served = S.read(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey")
    system = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    if dealt is not None:
        serves = rel(served.join(c.withColumn("s_suppkey", F.floor(key / dealt)), ["c_nationkey", "s_suppkey"]), "IfcRelServicesBuildings", key, system, space)
        return zone.unionByName(storey).unionByName(serves).unionByName(serves.filter("rel_order % 2 = 0"))
    # the relations of a space lie together, some RELATIONS_DEALT of them in a task
    tasks = max(1, c.count() * served.count() // 25 // RELATIONS_DEALT)
    spaces = c.select(F.col("c_nationkey").cast("long").alias("file_id"), key.cast("int").alias("rel_order"), space.alias("related_guid")).repartition(
        tasks, "file_id", "related_guid")
    pairs = spaces.join(F.broadcast(served.select(F.col("c_nationkey").cast("long").alias("file_id"), system.alias("relating_guid"))), "file_id")
    # every other relation is there twice
    serves = pairs.withColumn("_twice", F.explode(F.when(F.col("rel_order") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return zone.unionByName(storey).unionByName(serves.select("file_id", "rel_order", F.lit("IfcRelServicesBuildings").alias("rel_class"), "relating_guid", "related_guid"))


@query("""SELECT c_nationkey::BIGINT AS file_id, 'Raum_C' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Zimmer ' || c_custkey ELSE c_name END AS name, c_name AS number, c_mktsegment AS usage,
  CASE WHEN c_custkey % 5 <> 0 THEN n_name ELSE 'EG' END AS storey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE 'ZBUILDING' END AS zone,
  coalesce(CASE WHEN c_custkey % 3 <> 0 THEN nullif(c_custkey % 50, 0)::DOUBLE END, nullif(c_custkey % 60, 0)::DOUBLE) AS area_m2, 2.5::DOUBLE AS height_m
  FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def spaces_from_model(spark, sf):
    out = EM.spaces_from_model(model_objects(spark, sf), model_relations(spark, sf))
    return out.select("file_id", "id", "name", "number", "usage", "storey", "zone", "area_m2", "height_m")


@query("""SELECT s_nationkey::BIGINT AS file_id, 'ANL_S' || s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'HVAC supply' ELSE 'Sanitär' END AS kind, s_name AS name,
  nullif(s_suppkey, 0)::DOUBLE AS power_kw, nullif(s_suppkey * 10, 0)::DOUBLE AS flow_m3h FROM supplier WHERE s_suppkey % 3 < 2""")
def systems_from_model(spark, sf):
    return EM.systems_from_model(model_objects(spark, sf)).select("file_id", "id", "kind", "name", "power_kw", "flow_m3h")


@query("""SELECT 100 + p_partkey % 3 AS file_id, 'GER_E' || p_partkey AS id, coalesce(CASE WHEN p_partkey % 5 <> 0 THEN p_type END, p_name) AS kind,
  CASE WHEN p_partkey % 4 < 2 THEN nullif(p_partkey % 80, 0)::DOUBLE END AS power_kw, CASE WHEN p_partkey % 4 = 2 THEN nullif(p_partkey % 90, 0)::DOUBLE END AS flow_m3h FROM part
  WHERE p_partkey % 4 = 2 OR (p_partkey % 4 = 0 AND p_partkey % 3 <> 1) OR (p_partkey % 4 = 1 AND p_partkey % 3 = 1)""")
def equipment_from_model(spark, sf):
    """Old schema: its own classes; new schema: one class; no schema: old classes, as there are some."""
    return EM.equipment_from_model(model_objects(spark, sf)).select("file_id", "id", "kind", "power_kw", "flow_m3h")


@query("""SELECT c_nationkey::BIGINT AS file_id, 'ANL_S' || s_suppkey AS system_id, 'Raum_C' || c_custkey AS space_id FROM supplier JOIN customer ON c_nationkey = s_nationkey WHERE s_suppkey % 3 < 2""")
def served_spaces(spark, sf):
    o, r = model_objects(spark, sf), model_relations(spark, sf)
    return EM.served_spaces(r, EM.systems_from_model(o), EM.spaces_from_model(o, r)).select("file_id", "system_id", "space_id")

"""The given tables in the roles of the project model, in Spark and as SQL text.

The tables hold no planning data, so columns take over roles: parts are spaces,
suppliers are systems, order lines are equipment, documents are files of paragraphs.
Frequent syllables of the invented prose are replaced by words of the vocabulary, so
that the keyword rules have something to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.schema import source

WORDS = [
    ("the ", "muss "), ("and ", "soll "), ("ing ", "temperatur "), ("of ", "termin "), ("for ", "haftung "),
    ("with ", "recht "), ("es ", "raum "), ("und ", "erforderlich "), ("der ", "sollte "), ("que ", "energie "),
    ("les ", "projektierung "), ("in ", "sia 104 "), ("to ", "phase 3 "), ("die ", "kosten "), ("is ", "vorprojekt "),
]


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def worded(c: str) -> Column:
    out = F.col(c)
    for old, new in WORDS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def worded_sql(c: str) -> str:
    for old, new in WORDS:
        c = f"replace({c}, '{old}', '{new}')"
    return c


# --- texts ------------------------------------------------------------------------


def docs(spark, sf) -> DataFrame:
    return read(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "lang", "source", worded("text").alias("text"))


DOCS = f"docs AS (SELECT doc_id AS file_id, lang, source, {worded_sql('text')} AS text FROM documents)"


def lines(spark, sf) -> DataFrame:
    return docs(spark, sf).select("file_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("para_idx", "text"))


LINES = DOCS + """, lines AS (
  SELECT file_id, lang, source, i - 1 AS para_idx, l[i] AS text
  FROM (SELECT file_id, lang, source, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT file_id, lang, source, string_split(text, chr(10)) AS l FROM docs)))"""


def paragraphs(spark, sf) -> DataFrame:
    i = F.col("para_idx")
    style = (F.when(i % 7 == 0, F.when(i % 2 == 0, "Heading 2").otherwise("Überschrift 1"))
             .when(i % 5 == 1, "List Bullet").otherwise("Normal"))
    return lines(spark, sf).select("file_id", "para_idx", style.alias("style"), "text")


PARAGRAPHS = LINES + """, paragraphs AS (
  SELECT file_id, para_idx, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text,
    CASE WHEN para_idx % 7 = 0 THEN CASE WHEN para_idx % 2 = 0 THEN 'Heading 2' ELSE 'Überschrift 1' END
         WHEN para_idx % 5 = 1 THEN 'List Bullet' ELSE 'Normal' END AS style
  FROM lines)"""


def passages(spark, sf) -> DataFrame:
    """Turns of conversations as passages of a project; the role is the file."""
    return read(spark, sf, "conversations").select(
        F.col("conv_id").alias("project_id"), F.col("turn").alias("pos"), F.concat(F.col("role"), F.lit(".docx")).alias("file"),
        F.when(F.col("turn") % 3 != 2, F.col("turn").cast("int")).alias("para"), worded("text").alias("content"))


PASSAGES = f"""passages AS (
  SELECT conv_id AS project_id, turn AS pos, role || '.docx' AS file,
    CASE WHEN turn % 3 <> 2 THEN turn END AS para, {worded_sql('text')} AS content FROM conversations),
  corpus AS (
  SELECT *, '[Datei: ' || file || CASE WHEN para IS NOT NULL THEN ', Absatz ' || (para + 1) ELSE '' END || ']' || chr(10) || content AS marked
  FROM passages WHERE content <> '')"""


# --- entities -------------------------------------------------------------------------

def one_source(file: Column, file_id: Column) -> Column:
    return F.array(source(file=file, file_id=file_id))


def spaces(spark, sf, id_column: str = "p_partkey", projects: int = 25) -> DataFrame:
    """area may be zero or negative, height may be out of range, volume may be off."""
    part = read(spark, sf, "part")
    area, height = F.col("p_retailprice") - 901.0, (F.col("p_size") - 2).cast("double")
    return part.select(
        (F.col("p_partkey") % projects).alias("project_id"), F.col("p_partkey").alias("pos"),
        F.concat(F.lit("R"), F.col(id_column).cast("string")).alias("id"), F.col("p_name").alias("name"),
        F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.col("p_brand")).alias("number"),
        F.when(F.col("p_partkey") % 17 != 0, area).alias("area_m2"),
        (area * height + (F.col("p_partkey") % 3)).alias("volume_m3"), height.alias("height_m"),
        F.col("p_type").alias("usage"), F.lit(None).cast("string").alias("storey"), F.lit(None).cast("string").alias("zone"), F.lit(None).cast("string").alias("guid"),
        F.array(F.concat(F.lit("S"), (F.col("p_partkey") % 120).cast("string"))).alias("system_ids"),
        F.array(F.concat(F.lit("G"), F.col("p_partkey").cast("string")), F.lit(None).cast("string")).alias("equipment_ids"),
        one_source(F.col("p_type"), F.col("p_partkey") % 7).alias("sources"))


def spaces_sql(id_column: str = "p_partkey", projects: int = 25) -> str:
    return f"""spaces AS (
  SELECT p_partkey % {projects} AS project_id, p_partkey AS pos, 'R' || {id_column} AS id, p_name AS name,
    CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_brand END AS number,
    CASE WHEN p_partkey % 17 <> 0 THEN p_retailprice - 901.0::DOUBLE END AS area_m2,
    (p_retailprice - 901.0::DOUBLE) * (p_size - 2)::DOUBLE + (p_partkey % 3) AS volume_m3,
    (p_size - 2)::DOUBLE AS height_m, p_type AS usage,
    ['S' || (p_partkey % 120)] AS system_ids, ['G' || p_partkey, NULL] AS equipment_ids, p_type AS file
  FROM part)"""


def systems(spark, sf, id_column: str = "s_suppkey", projects: int = 25) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf, "supplier").select(
        (k % projects).alias("project_id"), k.alias("pos"), F.concat(F.lit("S"), F.col(id_column).cast("string")).alias("id"),
        F.when(k % 9 != 0, F.concat(F.lit("Typ "), F.col("s_nationkey").cast("string"))).alias("kind"), F.col("s_name").alias("name"),
        (F.col("s_acctbal") * 1.25).alias("power_kw"), (F.col("s_acctbal") - 100.0).alias("flow_m3h"),
        F.array(F.concat(F.lit("R"), k.cast("string")), F.concat(F.lit("R"), (k * 40).cast("string"))).alias("space_ids"),
        F.array(F.concat(F.lit("G"), k.cast("string"))).alias("equipment_ids"),
        F.lit(None).cast("string").alias("guid"), F.lit(None).cast("string").alias("system_guid"),
        one_source(F.lit("anlagen.xlsx"), k % 7).alias("sources"))


def systems_sql(id_column: str = "s_suppkey", projects: int = 25) -> str:
    return f"""systems AS (
  SELECT s_suppkey % {projects} AS project_id, s_suppkey AS pos, 'S' || {id_column} AS id,
    CASE WHEN s_suppkey % 9 <> 0 THEN 'Typ ' || s_nationkey END AS kind, s_name AS name,
    s_acctbal * 1.25::DOUBLE AS power_kw, s_acctbal - 100.0::DOUBLE AS flow_m3h,
    ['R' || s_suppkey, 'R' || (s_suppkey * 40)] AS space_ids, ['G' || s_suppkey] AS equipment_ids
  FROM supplier)"""


def equipment(spark, sf, projects: int = 2) -> DataFrame:
    """Order lines; some point nowhere, some to a missing system or space."""
    k, n = F.col("l_suppkey"), F.col("l_linenumber")
    return read(spark, sf, "lineitem").select(
        (k % projects).alias("project_id"), (F.col("l_orderkey") * 8 + n).alias("pos"),
        F.concat_ws("-", F.lit("G"), F.col("l_orderkey").cast("string"), n.cast("string")).alias("id"),
        F.col("l_returnflag").alias("kind"), F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("name"),
        (F.col("l_quantity") - 3.0).alias("power_kw"),
        F.when(n == 7, F.lit("")).when(n != 6, F.concat(F.lit("S"), k.cast("string"))).alias("system_id"),
        F.when(n < 7, F.concat(F.lit("R"), F.col("l_partkey").cast("string"))).alias("space_id"),
        one_source(F.col("l_linestatus"), F.col("l_orderkey") % 7).alias("sources"))


def equipment_sql(projects: int = 2) -> str:
    return f"""equipment AS (
  SELECT l_suppkey % {projects} AS project_id, l_orderkey * 8 + l_linenumber AS pos,
    'G-' || l_orderkey || '-' || l_linenumber AS id, l_returnflag AS kind, l_quantity - 3.0::DOUBLE AS power_kw,
    CASE WHEN l_linenumber = 7 THEN '' WHEN l_linenumber <> 6 THEN 'S' || l_suppkey END AS system_id,
    CASE WHEN l_linenumber < 7 THEN 'R' || l_partkey END AS space_id, l_linestatus AS file
  FROM lineitem)"""


PHASE_SQL = ("CASE k % 5 WHEN 0 THEN 'SIA 103 - Projektierung' WHEN 1 THEN 'SIA 104 - Vorprojekt' "
             "WHEN 2 THEN 'Phase SIA 105 - Bauprojekt (neu)' WHEN 3 THEN '' END")


def phase(k: Column) -> Column:
    m = k % 5
    return (F.when(m == 0, "SIA 103 - Projektierung").when(m == 1, "SIA 104 - Vorprojekt")
            .when(m == 2, "Phase SIA 105 - Bauprojekt (neu)").when(m == 3, ""))


SERVICE_WORDS = ["Projektanalyse", "Kostenplanung", "Vergabe", "Bauprojekt", "Raumanalyse", "Sonstiges"]


def services(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    word = F.element_at(F.array(*[F.lit(w) for w in SERVICE_WORDS]), (F.pmod(k, F.lit(6)) + 1).cast("int"))
    return read(spark, sf, "part").select(
        (k % 25).alias("project_id"), k.alias("pos"), F.concat(F.lit("L"), k.cast("string")).alias("id"),
        F.concat_ws(" ", word, "p_name").alias("text"), phase(k).alias("phase"), F.col("p_type").alias("category"))


SERVICES = f"""services AS (
  SELECT k % 25 AS project_id, k AS pos, 'L' || k AS id,
    {SERVICE_WORDS!r}[(k % 6) + 1] || ' ' || p_name AS text, {PHASE_SQL} AS phase, p_type AS category
  FROM (SELECT p_partkey AS k, p_name, p_type FROM part))"""


def milestones(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(
        (F.col("o_custkey") % 25).alias("project_id"), k.alias("pos"), F.concat(F.lit("T"), k.cast("string")).alias("id"),
        F.col("o_orderpriority").alias("text"), F.when(k % 6 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("due"),
        F.col("o_orderstatus").alias("category"),
        F.when(k % 4 == 0, "").when(k % 4 < 3, F.concat(F.lit("L"), (F.col("o_custkey") * 2).cast("string"))).alias("service_id"),
        phase(k).alias("phase"), one_source(F.lit("termine.xlsx"), k % 7).alias("sources"))


MILESTONES = f"""milestones AS (
  SELECT o_custkey % 25 AS project_id, k AS pos, 'T' || k AS id, o_orderpriority AS text,
    CASE WHEN k % 6 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS due, o_orderstatus AS category,
    CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 < 3 THEN 'L' || (o_custkey * 2) END AS service_id, {PHASE_SQL} AS phase
  FROM (SELECT *, o_orderkey AS k FROM orders))"""


def projects(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf, "customer").select(
        k.alias("id"), F.when(k % 13 != 0, F.col("c_name")).alias("name"),
        F.when(k % 4 == 0, F.concat(F.lit("Neubau\nProjektnummer: 2026-"), k.cast("string"), F.lit("-MWI: Etappe\nEnde")))
        .when(k % 4 == 1, F.concat(F.lit("Umbau 2026-01-"), F.upper(F.substring("c_mktsegment", 1, 3)), F.lit(" Nord")))
        .when(k % 4 == 2, "projektnummer: : leer 2026-02-ABC").alias("description"),
        F.when(k % 5 != 0, F.col("c_mktsegment")).otherwise("").alias("location"),
        F.when(k % 3 == 0, "offertreif").when(k % 3 == 1, "created").otherwise("validated").alias("status"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(k.cast("int") % 400)).alias("created_at"))


PROJECTS = """projects AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 13 <> 0 THEN c_name END AS name,
    CASE c_custkey % 4 WHEN 0 THEN 'Neubau' || chr(10) || 'Projektnummer: 2026-' || c_custkey || '-MWI: Etappe' || chr(10) || 'Ende'
      WHEN 1 THEN 'Umbau 2026-01-' || upper(substr(c_mktsegment, 1, 3)) || ' Nord' WHEN 2 THEN 'projektnummer: : leer 2026-02-ABC' END AS description,
    CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment ELSE '' END AS location,
    CASE c_custkey % 3 WHEN 0 THEN 'offertreif' WHEN 1 THEN 'created' ELSE 'validated' END AS status
  FROM customer)"""


def file_register(spark, sf) -> DataFrame:
    """Documents as files of the projects of their source, some not processed, some failed."""
    k = F.col("doc_id")
    number = F.regexp_extract("source", r"(\d+)", 1).cast("long")
    ext = F.element_at(F.array(*[F.lit(e) for e in FILE_ENDINGS]), (k % len(FILE_ENDINGS) + 1).cast("int"))
    stem = F.element_at(F.array(*[F.lit(e) for e in FILE_STEMS]), (F.pmod(k, F.lit(len(FILE_STEMS))) + 1).cast("int"))
    return read(spark, sf, "documents").select(
        k.alias("file_id"), number.alias("project_id"), F.concat(stem, k.cast("string"), ext).alias("name"),
        F.col("n_chars").alias("size"),
        F.when(k % 17 == 0, "image/png").when(k % 17 == 1, "text/plain").alias("mime"),
        ((number < 8) | (k % 3 != 0)).alias("processed"),
        F.when((number > 12) & (k % 5 == 0), "kaputt").otherwise("").alias("error"))


FILE_ENDINGS = [".pdf", ".PDF", ".xlsx", ".docx", ".ifc", ".png", ".txt", ".zip", ".csv", ""]
FILE_STEMS = ["Grundriss_RevB_", "raumliste v1.2 ", "Heizung_R3_", "Terminplan ", "Leistungsaufstellung_", "x_",
              "Beton Plan revision 7 ", "Zuluft-Geraete_", "notiz", "Brief_Rev_2.1_"]
FILES = f"""files AS (
  SELECT doc_id AS file_id, regexp_extract(source, '(\\d+)', 1)::BIGINT AS project_id,
    {FILE_STEMS!r}[doc_id % {len(FILE_STEMS)} + 1] || doc_id || {FILE_ENDINGS!r}[doc_id % {len(FILE_ENDINGS)} + 1] AS name,
    n_chars AS size, CASE doc_id % 17 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/plain' END AS mime,
    regexp_extract(source, '(\\d+)', 1)::BIGINT < 8 OR doc_id % 3 <> 0 AS processed,
    CASE WHEN regexp_extract(source, '(\\d+)', 1)::BIGINT > 12 AND doc_id % 5 = 0 THEN 'kaputt' ELSE '' END AS error
  FROM documents)"""

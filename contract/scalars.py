"""Scalar functions and predicates over whole tables."""

from pyspark.sql import functions as F

from contract import query
from contract import standins as S
from plumbline.functions import predicates as P
from plumbline.functions import text as X
from plumbline.functions import vocabulary as V
from plumbline.plans import lifecycle as L

NULLIF = "nullif({}, '')"


def label_sql(c: str, rules: dict, default: str = "NULL") -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains(lower({c}), '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in rules.items())
    return f"CASE {whens} ELSE {default} END"


def any_sql(c: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + ")"


EXT = "lower(regexp_extract(name, '[^./](\\.[^./]*)$', 1))"
TYPE_SQL = "CASE " + " ".join(f"WHEN ext = '{k}' THEN '{v}'" for k, v in V.FILE_TYPE_BY_EXTENSION.items()) + " " + " ".join(
    f"WHEN mime = '{k}' THEN '{v}'" for k, v in V.FILE_TYPE_BY_MIME.items()) + " ELSE 'Unknown' END"
REVISION_SQL = "coalesce(" + ", ".join(NULLIF.format(f"regexp_extract(name, '{p}', 1)") for p in V.REVISION_PATTERNS) + ")"
CLASSIFIED = f"""WITH {S.FILES}, e AS (SELECT *, {EXT} AS ext FROM files),
  classified AS (SELECT *, {TYPE_SQL} AS file_type, {label_sql('name', V.DOCUMENT_TYPES)} AS document_type,
    {label_sql('name', V.DISCIPLINES)} AS discipline, {REVISION_SQL} AS revision FROM e)"""


@query(CLASSIFIED + " SELECT file_id, ext AS extension, file_type, document_type, discipline, revision FROM classified")
def file_classification(spark, sf):
    return L.classify_files(S.file_register(spark, sf)).select(
        "file_id", "extension", "file_type", "document_type", "discipline", "revision")


@query(CLASSIFIED + """ SELECT file_id, r AS route, CASE WHEN r IS NULL THEN 'Dateityp ' || file_type || ' wird noch nicht unterstützt' END AS error
  FROM (SELECT *, CASE file_type WHEN 'Excel' THEN 'table' WHEN 'Word' THEN 'document' WHEN 'PDF' THEN
      CASE WHEN contains(document_type, 'plan') OR contains(document_type, 'grundriss') OR contains(document_type, 'schnitt') THEN 'plan' ELSE 'page' END
      WHEN 'IFC' THEN 'model' WHEN 'Image' THEN 'scan' END AS r FROM classified)""")
def file_routing(spark, sf):
    return L.route_files(L.classify_files(S.file_register(spark, sf)).drop("error")).select("file_id", "route", "error")


NUMBER_TEXT = "CASE p_partkey % 8 WHEN 0 THEN p_size || ',5 m²' WHEN 1 THEN '1.' || p_size || ',5' WHEN 2 THEN p_size || '''234' " \
    "WHEN 3 THEN 'ca. ' || p_size WHEN 4 THEN '-' || p_size WHEN 5 THEN ' ' || p_size || '. ' WHEN 6 THEN '.' || p_size ELSE p_name END"


def _number_text():
    k, s = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    return (F.when(k == 0, F.concat(s, F.lit(",5 m²"))).when(k == 1, F.concat(F.lit("1."), s, F.lit(",5")))
            .when(k == 2, F.concat(s, F.lit("'234"))).when(k == 3, F.concat(F.lit("ca. "), s)).when(k == 4, F.concat(F.lit("-"), s))
            .when(k == 5, F.concat(F.lit(" "), s, F.lit(". "))).when(k == 6, F.concat(F.lit("."), s)).otherwise(F.col("p_name")))


@query(f"""WITH t AS (SELECT p_partkey, {NUMBER_TEXT} AS v FROM part),
  u AS (SELECT *, regexp_extract(replace(v, ',', '.'), '[0-9.]+', 0) AS run, replace(trim(v), ',', '.') AS whole FROM t)
  SELECT p_partkey, TRY_CAST(nullif(run, '') AS DOUBLE) AS tolerant,
    CASE WHEN regexp_matches(whole, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(whole AS DOUBLE) END AS strict FROM u""")
def number_parsing(spark, sf):
    t = S.read(spark, sf, "part").select("p_partkey", _number_text().alias("v"))
    return t.select("p_partkey", X.tolerant_number("v").alias("tolerant"), X.strict_number("v").alias("strict"))


@query("""WITH n AS (SELECT p_partkey, p_partkey % 18278 AS z FROM part)
  SELECT p_partkey, CASE WHEN z >= 702 THEN chr((65 + (z - 702) // 676)::INT) ELSE '' END
    || CASE WHEN z >= 26 THEN chr((65 + ((z - 26) // 26) % 26)::INT) ELSE '' END || chr((65 + z % 26)::INT) || p_partkey AS cell FROM n""")
def cell_references(spark, sf):
    return S.read(spark, sf, "part").select("p_partkey", X.cell_reference(F.col("p_partkey") % 18278 + 1, "p_partkey").alias("cell"))


@query(f"""WITH {S.PROJECTS}, m AS (SELECT id, description AS d, regexp_matches(description, '(?i)Projektnummer:\\s*([^\\n\\r]+)') AS has,
    regexp_extract(description, '(?i)Projektnummer:\\s*([^\\n\\r]+)', 1) AS rest, location FROM projects)
  SELECT id, nullif(CASE WHEN has THEN trim(split_part(rest, ':', 1)) ELSE regexp_extract(d, '\\d{{4}}-\\d{{2}}-[A-Z]+', 0) END, '') AS number,
    trim(coalesce(regexp_extract(d, 'Projektnummer:\\s*(.+)', 1), '')) AS sort_number,
    regexp_replace('Angebot: ' || location || '/neu?.docx', '[/\\\\:*?"<>|]', '_', 'g') AS file_name FROM m""")
def project_numbers(spark, sf):
    return S.projects(spark, sf).select(
        "id", X.project_number("description").alias("number"), X.project_number_line("description").alias("sort_number"),
        X.safe_file_name(F.concat(F.lit("Angebot: "), "location", F.lit("/neu?.docx"))).alias("file_name"))


@query(f"""WITH {S.LINES}, m AS (SELECT file_id, para_idx, lower(text) AS t FROM lines)
  SELECT file_id, para_idx, {label_sql('t', V.PRIORITY_WORDS, "'mittel'")} AS priority, {label_sql('t', V.REQUIREMENT_CATEGORIES, "'allgemein'")} AS category,
    coalesce({label_sql('t', V.PHASE_WORDS)}, 'SIA ' || coalesce(nullif(regexp_extract(t, 'sia\\s*(\\d+)', 1), ''), nullif(regexp_extract(t, 'phase\\s*(\\d+)', 1), ''))) AS phase
  FROM m""")
def line_labels(spark, sf):
    """Priority, category and phase of every line of every document."""
    return S.lines(spark, sf).select(
        "file_id", F.col("para_idx").cast("long").alias("para_idx"), X.requirement_priority("text").alias("priority"),
        X.requirement_category("text").alias("category"), X.phase_of("text").alias("phase"))


RATED = """rated AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'ROT ' WHEN '2-HIGH' THEN 'sehr high' WHEN '3-MEDIUM' THEN 'orange'
  WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'Low gruen' END AS r FROM orders), l AS (SELECT o_orderkey, lower(trim(coalesce(r, ''))) AS r FROM rated)"""


@query(f"""WITH {RATED} SELECT o_orderkey,
  CASE WHEN r IN ('rot', 'orange', 'grün') THEN r WHEN contains(r, 'rot') THEN 'rot' WHEN contains(r, 'orange') THEN 'orange'
    WHEN contains(r, 'grün') OR contains(r, 'gruen') THEN 'grün' ELSE 'orange' END AS rating,
  CASE WHEN r IN ('hoch', 'mittel', 'niedrig') THEN r WHEN contains(r, 'hoch') OR contains(r, 'high') THEN 'hoch'
    WHEN contains(r, 'niedrig') OR contains(r, 'low') THEN 'niedrig' ELSE 'mittel' END AS priority FROM l""")
def rating_normalisation(spark, sf):
    p = F.col("o_orderpriority")
    r = (F.when(p == "1-URGENT", "ROT ").when(p == "2-HIGH", "sehr high").when(p == "3-MEDIUM", "orange")
         .when(p != "4-NOT SPECIFIED", "Low gruen"))
    return S.read(spark, sf, "orders").select("o_orderkey", X.rating(r).alias("rating"), X.priority(r).alias("priority"))


@query("""WITH b AS (SELECT doc_id, regexp_replace(substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 400), '\\s+', ' ', 'g') AS t,
    length(text) AS n FROM documents)
  SELECT doc_id, upper(lang) || ' ' || source AS label, substr(text, 1, 50) || '...' AS teaser, (length(text) + length(lang)) // 4 AS tokens FROM documents""")
def teasers_and_tokens(spark, sf):
    return S.read(spark, sf, "documents").select(
        "doc_id", F.concat_ws(" ", F.upper("lang"), "source").alias("label"), X.teaser("text").alias("teaser"),
        X.estimated_tokens(F.col("text"), F.col("lang")).alias("tokens"))


PLAN = f"""plan AS (SELECT page_id AS file_id, 1 AS page, url || ' R.' || page_id || ' Raum ' || (page_id % 50) || 'A Fläche: ' || (page_id % 90) || ',5 m² lüa '
  || (page_id % 7) || ' WP Zuluft ' || (page_id % 9) || '.25 HK heizkörper ' || (page_id % 30) || ',75 m2' AS text FROM pages)"""


def plan_pages(spark, sf):
    k = F.col("page_id")
    return S.read(spark, sf, "pages").select(
        k.alias("file_id"), F.lit(1).alias("page"),
        F.concat("url", F.lit(" R."), k, F.lit(" Raum "), k % 50, F.lit("A Fläche: "), k % 90, F.lit(",5 m² lüa "), k % 7,
                 F.lit(" WP Zuluft "), k % 9, F.lit(".25 HK heizkörper "), k % 30, F.lit(",75 m2")).alias("text"))


@query(f"""WITH {PLAN}, hits AS (SELECT file_id, unnest(list_distinct(flatten([{', '.join(f"regexp_extract_all(text, '(?i){p}', 1)" for p in V.SPACE_LABEL_PATTERNS)}]))) AS number FROM plan)
  SELECT file_id, number, 'Raum_' || replace(number, '.', '_') AS id, 'Raum ' || number AS name FROM hits""")
def plan_space_labels(spark, sf):
    from plumbline.plans.extract_text import plan_spaces
    return plan_spaces(plan_pages(spark, sf)).select("file_id", "number", "id", "name")


@query(f"""WITH {PLAN}, hits AS (SELECT file_id, unnest(list_concat(regexp_extract_all(text, '(?i)(LÜA|Lüftungsanlage|Ventilation)\\s*(\\d+)?', 1),
      regexp_extract_all(text, '(?i)(HK|Heizungsanlage|Heating)\\s*(\\d+)?', 1), regexp_extract_all(text, '(?i)(WP|Wärmepumpe|Heat Pump)\\s*(\\d+)?', 1))) AS kind,
    unnest(list_concat(regexp_extract_all(text, '(?i)(LÜA|Lüftungsanlage|Ventilation)\\s*(\\d+)?', 2),
      regexp_extract_all(text, '(?i)(HK|Heizungsanlage|Heating)\\s*(\\d+)?', 2), regexp_extract_all(text, '(?i)(WP|Wärmepumpe|Heat Pump)\\s*(\\d+)?', 2))) AS n FROM plan)
  SELECT file_id, 'ANL_' || replace(kind, ' ', '_') || '_' || coalesce(nullif(n, ''), '1') AS id, kind, trim(kind || ' ' || coalesce(n, '')) AS name FROM hits""")
def plan_system_labels(spark, sf):
    from plumbline.plans.extract_text import plan_systems
    return plan_systems(plan_pages(spark, sf)).select("file_id", "id", "kind", "name")


SYMBOLS_SQL = " UNION ALL ".join(
    f"SELECT file_id, '{entity}' AS entity, '{kind}' AS kind, unnest(regexp_extract_all(text, '(?i){p}', 0)) AS name, "
    f"unnest(range(1, len(regexp_extract_all(text, '(?i){p}', 0)) + 1)) AS nth FROM plan" for kind, (entity, p) in V.PLAN_SYMBOLS.items())


@query(f"WITH {PLAN}, hits AS ({SYMBOLS_SQL}) SELECT file_id, entity, kind, name, count(*) AS n FROM hits GROUP BY ALL")
def plan_symbol_counts(spark, sf):
    from plumbline.plans.extract_text import plan_symbols
    return plan_symbols(plan_pages(spark, sf)).groupBy("file_id", "entity", "kind", "name").agg(F.count(F.lit(1)).alias("n"))


PLACES_SQL = " UNION ALL ".join(
    f"SELECT file_id, '{entity}' AS entity, '{kind}' AS kind, regexp_extract_all(text, '(?i){p}', 0) AS found, string_split_regex(text, '(?i){p}') AS between, "
    f"unnest(range(1, len(regexp_extract_all(text, '(?i){p}', 0)) + 1)) AS nth FROM plan" for kind, (entity, p) in V.PLAN_SYMBOLS.items())


@query(f"""WITH {PLAN}, hits AS ({PLACES_SQL}) SELECT file_id, entity, kind, found[nth] AS name,
  (length(array_to_string(between[1:nth], '')) + coalesce(length(array_to_string(found[1:nth - 1], '')), 0))::BIGINT AS position FROM hits""")
def plan_symbol_places(spark, sf):
    """Every symbol of every page with its place."""
    from plumbline.plans.extract_text import plan_symbols
    return plan_symbols(plan_pages(spark, sf)).select("file_id", "entity", "kind", "name", F.col("position").cast("long").alias("position"))


@query(f"""WITH {PLAN}, areas AS (
    SELECT file_id, (file_id % 50) || 'A' AS number, (file_id % 90) || '.5' AS area, strpos(text, (file_id % 90) || ',5 m²') AS place FROM plan UNION ALL
    SELECT file_id, (file_id % 50) || 'A', (file_id % 90) || '.5', strpos(text, 'Fläche: ') FROM plan UNION ALL
    SELECT file_id, (file_id % 30)::VARCHAR, (file_id % 30) || '.75', strpos(text, (file_id % 30) || ',75 m2') FROM plan)
  SELECT file_id, number, area::DOUBLE AS area_m2, (place - 1)::BIGINT AS position FROM areas""")
def plan_all_areas(spark, sf):
    """Every area of every page with the label before it: `Fläche:` and the unit each find the first, and `r 7` in `heizkörper 7` is a label."""
    from plumbline.plans.extract_text import plan_areas
    return plan_areas(plan_pages(spark, sf)).select("file_id", "number", "area_m2", F.col("position").cast("long").alias("position"))


@query(f"""WITH {S.LINES} SELECT file_id, para_idx, {any_sql('text', V.REQUIREMENT_WORDS)} AS required, length(text) >= 20 AS long_enough,
  lower(text) IN ('gesamt', 'summe', 'total') AS total_row FROM lines""")
def line_predicates(spark, sf):
    return S.lines(spark, sf).select(
        "file_id", F.col("para_idx").cast("long").alias("para_idx"), P.contains_any("text", V.REQUIREMENT_WORDS).alias("required"),
        P.long_enough("text", V.PARAGRAPH_MIN_CHARS).alias("long_enough"), P.is_total_row("text", V.TOTAL_ROW_NAMES).alias("total_row"))


@query(f"""WITH {S.PASSAGES}, m AS (SELECT project_id, pos, regexp_extract(marked, '\\[Datei: ([^\\]]+)\\]', 1) AS body FROM corpus)
  SELECT project_id, pos, trim(split_part(body, ', Absatz', 1)) AS file, TRY_CAST(nullif(trim(split_part(body, ', Absatz', 2)), '') AS BIGINT) AS para FROM m""")
def source_markers(spark, sf):
    """Markers written and read back."""
    marked = S.passages(spark, sf).filter(P.has_text("content")).select(
        "project_id", "pos", F.regexp_extract(X.source_marker(F.col("file"), F.col("para")), X.MARKER, 1).alias("body"))
    return marked.select("project_id", "pos", X.marker_file(F.col("body")).alias("file"),
                         X.marker_para(F.col("body")).cast("long").alias("para"))


@query("""SELECT event_id, nullif(regexp_extract(event_type || ': ' || (event_id % 130) || '%', '(\\d+)%', 1), '')::BIGINT AS percent,
  greatest(0.0, least(100.0, value * 100.0 / 50.0))::DOUBLE AS share, (props->>'k')::BIGINT AS k FROM events""")
def log_progress(spark, sf):
    return S.read(spark, sf, "events").select(
        "event_id", X.percent(F.concat("event_type", F.lit(": "), F.col("event_id") % 130, F.lit("%"))).cast("long").alias("percent"),
        X.percent_of(F.col("value"), F.lit(50.0)).alias("share"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""WITH t AS (SELECT doc_id, lang, [s FOR s IN list_transform(string_split_regex(t, '[.!?]+\\s+'), lambda x: trim(x)) IF s <> ''] AS s FROM (
    SELECT doc_id, lang, CASE WHEN length(w) <= 400 THEN w WHEN length(regexp_extract(substr(w, 1, 400), '(?s)^.*[.!?]', 0)) - 1 > 280
      THEN regexp_extract(substr(w, 1, 400), '(?s)^.*[.!?]', 0) ELSE substr(w, 1, 400) || '...' END AS t
    FROM (SELECT doc_id, lang, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS w FROM documents)))
  SELECT doc_id, len(s) > 0 AS has_points, len(s) AS sentences FROM t""")
def overview_points(spark, sf):
    """Overview bullets of every document: never more than five, never empty where there is text."""
    d = S.read(spark, sf, "documents")
    whole = X.strip(F.col("text"))
    head = F.substring(whole, 1, 400)
    upto = F.length(F.regexp_extract(head, r"(?s)\A.*[.!?]", 0))
    cut = F.when(F.length(whole) <= 400, whole).otherwise(
        F.when(upto - 1 > 280, F.left(head, upto)).otherwise(F.concat(head, F.lit("..."))))
    sentences = F.filter(F.transform(F.split(cut, r"[.!?]+\s+"), X.strip), lambda s: s != "")
    points = X.overview_bullets("text")
    return d.select("doc_id", ((F.size(points) > 0) & (F.size(points) <= 5)).alias("has_points"), F.size(sentences).cast("long").alias("sentences"))

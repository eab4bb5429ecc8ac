"""Validation rules on the given tables."""

from pyspark.sql import functions as F

from contract import query
from contract import standins as S
from plumbline.plans import reports as R
from plumbline.plans import validate as V

ISSUE_COLS = ["project_id", "rule_id", "severity", "entity_id", "pos"]


def _issues(df):
    return df.select("project_id", "rule_id", "severity", "entity_id", F.col("pos").cast("long").alias("pos"),
                     F.concat_ws("|", "source_files").alias("files"))


def _issues_with_text(df):
    return df.select(*ISSUE_COLS[:4], F.col("pos").cast("long").alias("pos"), F.concat_ws("|", "source_files").alias("files"), "text", "advice")


def _first_sql(rows: str, key: str, field: str, rule: str) -> str:
    return f"""SELECT s.project_id, '{rule}' AS rule_id, 'kritisch' AS severity, s.id AS entity_id, s.pos,
      CASE WHEN f.ff = s.file THEN s.file ELSE f.ff || '|' || s.file END AS files
    FROM {rows} s JOIN (SELECT project_id, {key} AS k, min(pos) AS fp, arg_min(coalesce({field}, 0), pos) AS fv, arg_min(file, pos) AS ff
      FROM {rows} GROUP BY ALL) f ON s.project_id = f.project_id AND s.{key} = f.k
    WHERE s.pos > f.fp AND f.fv <> 0 AND coalesce(s.{field}, 0) <> 0 AND abs(f.fv - s.{field}) > 0.1"""


@query(f"WITH {S.spaces_sql('p_name')} " + _first_sql("spaces", "id", "area_m2", "V01"))
def space_area_contradictions_by_id(spark, sf):
    return _issues(V.space_area_by_id(S.spaces(spark, sf, "p_name")))


@query(f"WITH {S.spaces_sql()}, named AS (SELECT * REPLACE (lower(number) AS number) FROM spaces WHERE number <> '') "
       + _first_sql("named", "number", "area_m2", "V02"))
def space_area_contradictions_by_number(spark, sf):
    return _issues(V.space_area_by_number(S.spaces(spark, sf)))


@query(f"""WITH {S.spaces_sql()} SELECT project_id, 'V03' AS rule_id, 'warnung' AS severity, id AS entity_id, pos, file AS files
  FROM spaces WHERE area_m2 <> 0 AND height_m <> 0 AND volume_m3 <> 0 AND abs(volume_m3 - area_m2 * height_m) > 0.5""")
def space_volume_mismatch(spark, sf):
    return _issues(V.space_volume(S.spaces(spark, sf)))


@query(f"WITH {S.systems_sql('s_nationkey', 5)}, rows AS (SELECT *, 'anlagen.xlsx' AS file FROM systems) "
       + _first_sql("rows", "id", "power_kw", "V04"))
def system_power_contradictions(spark, sf):
    return _issues(V.system_power(S.systems(spark, sf, "s_nationkey", 5)))


@query(f"""WITH {S.equipment_sql()}, {S.spaces_sql(projects=2)}, {S.systems_sql(projects=2)},
  live_systems AS (SELECT DISTINCT project_id, id FROM systems WHERE power_kw > 0),
  live_spaces AS (SELECT DISTINCT project_id, id FROM spaces WHERE height_m > 0),
  j AS (SELECT e.*, s.id IS NOT NULL AS has_system, r.id IS NOT NULL AS has_space FROM equipment e
    LEFT JOIN live_systems s ON e.project_id = s.project_id AND e.system_id = s.id
    LEFT JOIN live_spaces r ON e.project_id = r.project_id AND e.space_id = r.id),
  c AS (SELECT *, CASE WHEN coalesce(system_id, '') = '' AND coalesce(space_id, '') = '' THEN 'V05'
      WHEN coalesce(system_id, '') <> '' AND NOT has_system THEN 'V06'
      WHEN coalesce(space_id, '') <> '' AND NOT has_space THEN 'V07' END AS rule_id FROM j)
  SELECT project_id, rule_id, CASE rule_id WHEN 'V05' THEN 'warnung' ELSE 'kritisch' END AS severity, id AS entity_id, pos,
    file AS files FROM c WHERE rule_id IS NOT NULL""")
def equipment_reference_check(spark, sf):
    return _issues(V.equipment_references(
        S.equipment(spark, sf), S.systems(spark, sf, projects=2).filter("power_kw > 0"),
        S.spaces(spark, sf, projects=2).filter("height_m > 0")))


def _dangling_sql(rows, field, targets, rule, file):
    noun = {"spaces": "Raum", "systems": "Anlage"}[rows]
    missing, target = {"spaces": ("existierenden", "Raum"), "equipment": ("existierendes", "Gerät"), "systems": ("existierende", "Anlage")}[targets]
    return f"""SELECT l.project_id, '{rule}' AS rule_id, 'kritisch' AS severity, l.id AS entity_id, l.pos, {file} AS files,
      concat('{noun} ', coalesce(l.id, 'None'), ' referenziert nicht {missing} {target} ', coalesce(l.ref, 'None')) AS text,
      concat('Bitte {target} ', coalesce(l.ref, 'None'), ' prüfen oder {noun} korrigieren') AS advice
    FROM (SELECT *, unnest({field}) AS ref FROM {rows}) l
    WHERE NOT EXISTS (SELECT 1 FROM {targets} t WHERE t.project_id = l.project_id AND t.id IS NOT DISTINCT FROM l.ref)"""


@query(f"""WITH {S.spaces_sql()}, {S.systems_sql()}, equipment AS (SELECT project_id, 'G' || pos AS id FROM spaces WHERE pos % 5 <> 0)
  {_dangling_sql('systems', 'space_ids', 'spaces', 'V08', "'anlagen.xlsx'")} UNION ALL
  {_dangling_sql('systems', 'equipment_ids', 'equipment', 'V09', "'anlagen.xlsx'")} UNION ALL
  {_dangling_sql('spaces', 'system_ids', 'systems', 'V10', 'l.file')} UNION ALL
  {_dangling_sql('spaces', 'equipment_ids', 'equipment', 'V11', 'l.file')}""")
def list_reference_check(spark, sf):
    spaces, systems = S.spaces(spark, sf), S.systems(spark, sf)
    equipment = spaces.filter("pos % 5 <> 0").select("project_id", F.concat(F.lit("G"), F.col("pos").cast("string")).alias("id"))
    return _issues_with_text(
        V.dangling(systems, "space_ids", spaces, "V08", "Anlage ", "Raum ")
        .unionByName(V.dangling(systems, "equipment_ids", equipment, "V09", "Anlage ", "Gerät "))
        .unionByName(V.dangling(spaces, "system_ids", systems, "V10", "Raum ", "Anlage "))
        .unionByName(V.dangling(spaces, "equipment_ids", equipment, "V11", "Raum ", "Gerät ")))


@query(f"""WITH {S.MILESTONES}, {S.SERVICES} SELECT m.project_id, 'V12' AS rule_id, 'warnung' AS severity, m.id AS entity_id, m.pos,
  'termine.xlsx' AS files FROM milestones m WHERE coalesce(m.service_id, '') <> ''
  AND NOT EXISTS (SELECT 1 FROM services s WHERE s.project_id = m.project_id AND s.id = m.service_id)""")
def milestone_reference_check(spark, sf):
    return _issues(V.milestone_services(S.milestones(spark, sf), S.services(spark, sf)))


@query(f"""WITH {S.spaces_sql()}, {S.systems_sql()}, {S.equipment_sql()}, hits AS (
  SELECT project_id, 'V13' AS rule_id, 'kritisch' AS severity, id AS entity_id, pos, file AS files FROM spaces WHERE area_m2 <= 0 UNION ALL
  SELECT project_id, 'V14', 'hinweis', id, pos, file FROM spaces WHERE area_m2 > 10000 UNION ALL
  SELECT project_id, 'V15', 'kritisch', id, pos, file FROM spaces WHERE volume_m3 <= 0 UNION ALL
  SELECT project_id, 'V16', 'kritisch', id, pos, file FROM spaces WHERE height_m <= 0 UNION ALL
  SELECT project_id, 'V17', 'hinweis', id, pos, file FROM spaces WHERE height_m > 10 UNION ALL
  SELECT project_id, 'V18', 'kritisch', id, pos, 'anlagen.xlsx' FROM systems WHERE power_kw < 0 UNION ALL
  SELECT project_id, 'V19', 'hinweis', id, pos, 'anlagen.xlsx' FROM systems WHERE power_kw > 10000 UNION ALL
  SELECT project_id, 'V20', 'kritisch', id, pos, 'anlagen.xlsx' FROM systems WHERE flow_m3h < 0 UNION ALL
  SELECT project_id, 'V21', 'kritisch', id, pos, file FROM equipment WHERE power_kw < 0) SELECT * FROM hits""")
def plausibility_ranges(spark, sf):
    return _issues(V.space_ranges(S.spaces(spark, sf)).unionByName(V.system_ranges(S.systems(spark, sf))).unionByName(
        V.equipment_ranges(S.equipment(spark, sf))))


@query(f"""WITH {S.PROJECTS}, {S.spaces_sql(projects=1000)}, {S.systems_sql()} , hits AS (
  SELECT id AS project_id, 'V22' AS rule_id, 'kritisch' AS severity, NULL::VARCHAR AS entity_id, 0::BIGINT AS pos, '' AS files FROM projects WHERE coalesce(name, '') = '' UNION ALL
  SELECT id, 'V22', 'kritisch', NULL, 0, '' FROM projects WHERE coalesce(location, '') = '' UNION ALL
  SELECT id, 'V23', 'kritisch', NULL, 0, '' FROM projects WHERE id NOT IN (SELECT project_id FROM spaces) UNION ALL
  SELECT project_id, 'V24', 'kritisch', id, pos, file FROM spaces WHERE area_m2 IS NULL UNION ALL
  SELECT project_id, 'V24', 'kritisch', id, pos, file FROM spaces WHERE name IS NULL UNION ALL
  SELECT project_id, 'V25', 'warnung', id, pos, 'anlagen.xlsx' FROM systems WHERE kind IS NULL) SELECT * FROM hits""")
def specification_check(spark, sf):
    projects, spaces = S.projects(spark, sf), S.spaces(spark, sf, projects=1000)
    return _issues(
        V.project_fields(projects, ["name", "standort"]).unionByName(V.too_few(projects, spaces, 1))
        .unionByName(V.required_fields(spaces, ["id", "name", "flaeche_m2"], "V24", "kritisch", "Raum "))
        .unionByName(V.required_fields(S.systems(spark, sf), ["typ"], "V25", "warnung", "Anlage ")))


@query(f"""WITH {S.spaces_sql()}, {S.systems_sql()}, hits AS (
  SELECT project_id, id AS entity_id, pos FROM spaces WHERE area_m2 < 1 UNION ALL
  SELECT project_id, id, pos FROM spaces WHERE area_m2 > 10000 UNION ALL
  SELECT project_id, id, pos FROM spaces WHERE height_m < 2 UNION ALL
  SELECT project_id, id, pos FROM spaces WHERE height_m > 10 UNION ALL
  SELECT project_id, id, pos FROM systems WHERE power_kw > 10000 UNION ALL
  SELECT project_id, id, pos FROM systems WHERE flow_m3h > 100000) SELECT project_id, 'V28' AS rule_id, entity_id, pos FROM hits""")
def specification_limits(spark, sf):
    return V.spec_ranges(S.spaces(spark, sf), {"area_m2": (1.0, 10000.0), "height_m": (2.0, 10.0)}, "Raum ").unionByName(
        V.spec_ranges(S.systems(spark, sf), {"power_kw": (None, 10000.0), "flow_m3h": (None, 100000.0)}, "Anlage ")
    ).select("project_id", "rule_id", "entity_id", "pos")


@query(f"""WITH {S.SERVICES}, {S.PROJECTS}, demands(phase, demand) AS (VALUES
    ('SIA 103 - Projektierung', 'Projektanalyse'), ('SIA 103 - Projektierung', 'Raumanalyse'), ('SIA 103 - Projektierung', 'Konzeptentwicklung'),
    ('SIA 104 - Vorprojekt', 'Vorprojekt'), ('SIA 104 - Vorprojekt', 'Kostenplanung'), ('SIA 104 - Vorprojekt', 'Terminplanung'),
    ('SIA 105 - Bauprojekt', 'Bauprojekt'), ('SIA 105 - Bauprojekt', 'Ausschreibung'), ('SIA 105 - Bauprojekt', 'Vergabe'))
  SELECT p.id AS project_id, d.phase, d.demand FROM projects p, demands d
  WHERE NOT EXISTS (SELECT 1 FROM services s WHERE s.project_id = p.id AND contains(coalesce(s.phase, ''), d.phase) AND contains(s.text, d.demand))""")
def required_services_missing(spark, sf):
    """Projects without any service lack all that is demanded."""
    return V.missing_services(S.services(spark, sf), projects=S.projects(spark, sf))


def model(spark, sf):
    return {
        "projects": S.projects(spark, sf), "spaces": S.spaces(spark, sf, "p_name", 2), "systems": S.systems(spark, sf, projects=2),
        "equipment": S.equipment(spark, sf), "milestones": S.milestones(spark, sf), "services": S.services(spark, sf)}


MODEL = ", ".join([S.PROJECTS, S.spaces_sql("p_name", 2), S.systems_sql(projects=2), S.equipment_sql(), S.MILESTONES, S.SERVICES])


def _contra(rows, key, field, where="TRUE"):
    return f"""SELECT s.project_id FROM {rows} s JOIN (SELECT project_id, {key} AS k, min(pos) AS fp, arg_min(coalesce({field}, 0), pos) AS fv
    FROM {rows} WHERE {where} GROUP BY ALL) f ON s.project_id = f.project_id AND s.{key} = f.k
    WHERE {where} AND s.pos > f.fp AND f.fv <> 0 AND coalesce(s.{field}, 0) <> 0 AND abs(f.fv - s.{field}) > 0.1"""


def _lost(rows, field, targets):
    return f"""SELECT project_id FROM (SELECT *, unnest({field}) AS ref FROM {rows}) l
    WHERE NOT EXISTS (SELECT 1 FROM {targets} t WHERE t.project_id = l.project_id AND t.id IS NOT DISTINCT FROM l.ref)"""


ALL_ISSUES = f"""WITH {MODEL},
  eq AS (SELECT e.project_id, CASE WHEN coalesce(system_id, '') = '' AND coalesce(space_id, '') = '' THEN 'V05'
      WHEN coalesce(system_id, '') <> '' AND s.id IS NULL THEN 'V06' WHEN coalesce(space_id, '') <> '' AND r.id IS NULL THEN 'V07' END AS rule_id
    FROM equipment e LEFT JOIN (SELECT DISTINCT project_id, id FROM systems) s ON e.project_id = s.project_id AND e.system_id = s.id
    LEFT JOIN (SELECT DISTINCT project_id, id FROM spaces) r ON e.project_id = r.project_id AND e.space_id = r.id),
  rules(rule_id, family, severity) AS (VALUES ('V01','c','kritisch'),('V02','c','kritisch'),('V03','c','warnung'),('V04','c','kritisch'),
    ('V05','r','warnung'),('V06','r','kritisch'),('V07','r','kritisch'),('V08','r','kritisch'),('V09','r','kritisch'),('V10','r','kritisch'),
    ('V11','r','kritisch'),('V12','r','warnung'),('V13','p','kritisch'),('V14','p','hinweis'),('V15','p','kritisch'),('V16','p','kritisch'),
    ('V17','p','hinweis'),('V18','p','kritisch'),('V19','p','hinweis'),('V20','p','kritisch'),('V21','p','kritisch'),('V22','s','kritisch'),
    ('V23','s','kritisch'),('V24','s','kritisch'),('V25','s','warnung')),
  fired(rule_id, project_id) AS (
    SELECT 'V01', project_id FROM ({_contra('spaces', 'id', 'area_m2')}) UNION ALL
    SELECT 'V02', project_id FROM ({_contra('spaces', 'number', 'area_m2', "number <> ''")}) UNION ALL
    SELECT 'V03', project_id FROM spaces WHERE area_m2 <> 0 AND height_m <> 0 AND volume_m3 <> 0 AND abs(volume_m3 - area_m2 * height_m) > 0.5 UNION ALL
    SELECT 'V04', project_id FROM ({_contra('systems', 'id', 'power_kw')}) UNION ALL
    SELECT rule_id, project_id FROM eq WHERE rule_id IS NOT NULL UNION ALL
    SELECT 'V08', project_id FROM ({_lost('systems', 'space_ids', 'spaces')}) UNION ALL
    SELECT 'V09', project_id FROM ({_lost('systems', 'equipment_ids', 'equipment')}) UNION ALL
    SELECT 'V10', project_id FROM ({_lost('spaces', 'system_ids', 'systems')}) UNION ALL
    SELECT 'V11', project_id FROM ({_lost('spaces', 'equipment_ids', 'equipment')}) UNION ALL
    SELECT 'V12', project_id FROM milestones m WHERE coalesce(m.service_id, '') <> ''
      AND NOT EXISTS (SELECT 1 FROM services s WHERE s.project_id = m.project_id AND s.id = m.service_id) UNION ALL
    SELECT 'V13', project_id FROM spaces WHERE area_m2 <= 0 UNION ALL SELECT 'V14', project_id FROM spaces WHERE area_m2 > 10000 UNION ALL
    SELECT 'V15', project_id FROM spaces WHERE volume_m3 <= 0 UNION ALL SELECT 'V16', project_id FROM spaces WHERE height_m <= 0 UNION ALL
    SELECT 'V17', project_id FROM spaces WHERE height_m > 10 UNION ALL SELECT 'V18', project_id FROM systems WHERE power_kw < 0 UNION ALL
    SELECT 'V19', project_id FROM systems WHERE power_kw > 10000 UNION ALL SELECT 'V20', project_id FROM systems WHERE flow_m3h < 0 UNION ALL
    SELECT 'V21', project_id FROM equipment WHERE power_kw < 0 UNION ALL
    SELECT 'V22', id FROM projects WHERE coalesce(name, '') = '' UNION ALL SELECT 'V22', id FROM projects WHERE coalesce(location, '') = '' UNION ALL
    SELECT 'V23', id FROM projects WHERE id NOT IN (SELECT project_id FROM spaces) UNION ALL
    SELECT 'V24', project_id FROM spaces WHERE area_m2 IS NULL UNION ALL SELECT 'V25', project_id FROM systems WHERE kind IS NULL),
  routed AS (SELECT f.*, family, severity, CASE severity WHEN 'kritisch' THEN 'fehler' WHEN 'warnung' THEN 'warnungen' ELSE 'hinweise' END AS bucket
    FROM fired f JOIN rules USING (rule_id)
    WHERE CASE WHEN family = 'p' THEN severity IN ('warnung', 'hinweis') ELSE severity IN ('kritisch', 'warnung') END)"""


@query(ALL_ISSUES + " SELECT project_id, rule_id, bucket, count(*) AS issues FROM routed GROUP BY ALL")
def validation_summary(spark, sf):
    """All rules over all projects, routed, counted per project and rule."""
    issues = V.route(V.all_issues(model(spark, sf)))
    return issues.groupBy("project_id", "rule_id", "bucket").agg(F.count(F.lit(1)).alias("issues"))


@query(ALL_ISSUES.replace("WHERE CASE WHEN family = 'p' THEN severity IN ('warnung', 'hinweis') ELSE severity IN ('kritisch', 'warnung') END", "")
       + " SELECT rule_id, bucket, count(*) AS issues FROM routed GROUP BY ALL")
def validation_summary_all_routed(spark, sf):
    issues = V.route(V.all_issues(model(spark, sf)), routing="all")
    return issues.groupBy("rule_id", "bucket").agg(F.count(F.lit(1)).alias("issues"))


@query(ALL_ISSUES + """ SELECT p.id AS project_id, count(*) FILTER (bucket = 'fehler') AS fehler, count(*) FILTER (bucket = 'warnungen') AS warnungen,
  count(*) FILTER (bucket = 'hinweise') AS hinweise, count(*) FILTER (bucket = 'fehler') = 0 AS consistent,
  CASE WHEN count(*) FILTER (bucket = 'fehler') = 0 THEN 'validated' ELSE 'validation_errors' END AS status
  FROM projects p LEFT JOIN routed r ON r.project_id = p.id GROUP BY p.id""")
def project_verdicts(spark, sf):
    m = model(spark, sf)
    return V.verdicts(m["projects"], V.route(V.all_issues(m)))


@query(ALL_ISSUES + """ SELECT project_id, CASE bucket WHEN 'fehler' THEN 0 WHEN 'warnungen' THEN 1 ELSE 2 END AS bucket_order,
  CASE bucket WHEN 'fehler' THEN 'kritisch' WHEN 'warnungen' THEN 'wichtig' ELSE 'information' END AS priority, count(*) AS questions
  FROM routed GROUP BY ALL""")
def questions_from_issues(spark, sf):
    q = R.questions(V.route(V.all_issues(model(spark, sf))))
    return q.groupBy("project_id", F.col("bucket_order").cast("long").alias("bucket_order"), "priority").agg(F.count(F.lit(1)).alias("questions"))

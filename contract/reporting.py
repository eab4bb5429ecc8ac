"""Reports: risks, timeline, staffing, scope, questions, findings."""

from pyspark.sql import functions as F

from contract import query
from contract import standins as S
from contract.housekeeping import SIZE, size
from plumbline.plans import reports as R

START = "2026-03-01"
PHASES = """ph(phase_no, phase, days, off, text) AS (VALUES (1, 'SIA 103 - Projektierung', 30, 0, 'Projektanalyse, Raumanalyse, Konzeptentwicklung'),
  (2, 'SIA 104 - Vorprojekt', 60, 30, 'Vorprojekt, Kostenplanung, Terminplanung'), (3, 'SIA 105 - Bauprojekt', 90, 90, 'Bauprojekt, Ausschreibung, Vergabe'))"""


def _verdicts(spark, sf):
    """Negative quantities of the project's equipment count as its critical errors here."""
    return S.equipment(spark, sf, 25).filter("power_kw < 0").groupBy("project_id").agg(F.count(F.lit(1)).alias("fehler"))


RISKS = f"""{SIZE}, bad AS (SELECT project_id, count(*) AS n FROM equipment WHERE power_kw < 0 GROUP BY 1),
  s AS (SELECT size.*, coalesce(bad.n, 0) AS fehler FROM size LEFT JOIN bad USING (project_id)),
  risks AS (SELECT project_id, 1 AS risk_no, 'Datenqualität' AS category, spaces_without_area || ' Räume ohne Flächenangabe' AS text, 'hoch' AS likelihood, 'mittel' AS impact,
      'Fehlende Flächenangaben ergänzen' AS action, 'HOCH' AS level FROM s WHERE spaces_without_area > 0 UNION ALL
    SELECT project_id, 2, 'Projektkomplexität', 'Hohe Anzahl von Räumen (' || spaces || ')', 'mittel', 'hoch', 'Projekt in Phasen aufteilen, zusätzliche Ressourcen einplanen', 'HOCH' FROM s WHERE spaces > 100 UNION ALL
    SELECT project_id, 3, 'Projektkomplexität', 'Hohe Anzahl von Anlagen (' || systems || ')', 'mittel', 'hoch', 'Anlagen-Koordination intensivieren', 'HOCH' FROM s WHERE systems > 20 UNION ALL
    SELECT project_id, 4, 'Datenqualität', fehler || ' kritische Validierungsfehler gefunden', 'hoch', 'hoch', 'Validierungsfehler beheben bevor mit Offerte fortgefahren wird', 'KRITISCH' FROM s WHERE fehler > 0)"""


@query(f"WITH {RISKS} SELECT *, substr(text, 1, 50) || '...' AS teaser FROM risks")
def risk_register(spark, sf):
    r = R.threshold_risks(size(spark, sf), _verdicts(spark, sf))
    return r.withColumn("risk_no", F.col("risk_no").cast("long"))


@query(f"WITH {RISKS} SELECT project_id, category, action FROM risks WHERE action <> ''")
def recommended_actions(spark, sf):
    return R.actions(R.threshold_risks(size(spark, sf), _verdicts(spark, sf)))


@query("""WITH m(l, i, level) AS (VALUES ('hoch','hoch','KRITISCH'),('hoch','mittel','HOCH'),('hoch','niedrig','MITTEL'),('mittel','hoch','HOCH'),('mittel','mittel','MITTEL'),
    ('mittel','niedrig','NIEDRIG'),('niedrig','hoch','MITTEL'),('niedrig','mittel','NIEDRIG'),('niedrig','niedrig','NIEDRIG')),
  r AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'hoch' WHEN 'N' THEN 'mittel' ELSE 'niedrig' END AS l,
    CASE l_linenumber % 4 WHEN 0 THEN 'hoch' WHEN 1 THEN 'mittel' WHEN 2 THEN 'niedrig' ELSE 'keine' END AS i FROM lineitem)
  SELECT l_orderkey, l_linenumber, coalesce(level, 'UNBEKANNT') AS level FROM r LEFT JOIN m USING (l, i)""")
def risk_levels(spark, sf):
    f, n = F.col("l_returnflag"), F.col("l_linenumber") % 4
    likelihood = F.when(f == "A", "hoch").when(f == "N", "mittel").otherwise("niedrig")
    impact = F.when(n == 0, "hoch").when(n == 1, "mittel").when(n == 2, "niedrig").otherwise("keine")
    return S.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R.risk_level(likelihood, impact).alias("level"))


@query(f"""WITH {PHASES}, {S.SERVICES}, {S.MILESTONES}, {S.PROJECTS}, x AS (
    SELECT id AS project_id, 'phase' AS item_kind, 0 AS pos, NULL::VARCHAR AS item, NULL::VARCHAR AS due, ph.* FROM projects, ph UNION ALL
    SELECT s.project_id, 'service', s.pos, s.text, NULL, ph.* FROM services s, ph WHERE contains(coalesce(s.phase, ''), ph.phase) UNION ALL
    SELECT m.project_id, 'milestone', m.pos, m.text, coalesce(m.due, '-'), ph.* FROM milestones m, ph WHERE contains(coalesce(m.phase, ''), ph.phase))
  SELECT project_id, item_kind, pos, item AS text, due, phase_no, phase, days, strftime(DATE '{START}' + off, '%d.%m.%Y') AS starts,
    strftime(DATE '{START}' + off + days, '%d.%m.%Y') AS ends FROM x""")
def phase_timeline(spark, sf):
    from plumbline.functions.text import german_date
    t = R.timeline(S.projects(spark, sf), S.services(spark, sf), S.milestones(spark, sf), START)
    return t.withColumns({"starts": german_date("starts"), "ends": german_date("ends"), "phase_no": F.col("phase_no").cast("long"),
                          "days": F.col("days").cast("long")})


@query(f"""WITH {SIZE}, t AS (SELECT *, (2 + greatest(0, floor((spaces - 10) / 20)) + greatest(0, floor((systems - 5) / 5)))::BIGINT AS team FROM size)
  SELECT project_id, spaces, systems, equipment, team, 1::BIGINT AS leads, greatest(1, team - 1) AS engineers, greatest(1, team // 2) AS drafters FROM t""")
def staffing(spark, sf):
    return R.staffing(size(spark, sf))


@query("""WITH r(role, task, level) AS (VALUES ('Projektleiter', 'Projektkoordination', 'R'), ('Projektleiter', 'Kostenplanung', 'A'), ('Projektleiter', 'Terminplanung', 'A'),
    ('Projektleiter', 'Qualitätssicherung', 'A'), ('HLKS-Ingenieur', 'Planung', 'R'), ('HLKS-Ingenieur', 'Berechnungen', 'R'), ('HLKS-Ingenieur', 'Ausschreibung', 'C'),
    ('HLKS-Ingenieur', 'Abnahme', 'C'), ('CAD-Zeichner', 'Planerstellung', 'R'), ('CAD-Zeichner', 'Planprüfung', 'C'))
  SELECT c_custkey AS project_id, r.* FROM customer, r""")
def responsibility_matrix(spark, sf):
    return R.responsibilities(S.projects(spark, sf))


@query(f"""WITH {PHASES}, {SIZE}, {S.SERVICES}, {S.PROJECTS}, n AS (SELECT project_id, phase_no, count(*) AS services FROM services s, ph WHERE contains(coalesce(s.phase, ''), ph.phase) GROUP BY ALL)
  SELECT p.id AS project_id, p.name, coalesce(nullif(p.location, ''), '-') AS location, ph.phase_no, ph.phase, ph.text AS default_text, coalesce(n.services, 0) AS services,
    coalesce(z.spaces, 0) AS spaces, coalesce(z.systems, 0) AS systems, coalesce(z.equipment, 0) AS equipment
  FROM projects p CROSS JOIN ph LEFT JOIN n ON n.project_id = p.id AND n.phase_no = ph.phase_no LEFT JOIN size z ON z.project_id = p.id WHERE p.status = 'offertreif'""")
def scope_summary(spark, sf):
    """Only projects that are ready for an offer."""
    out = R.scope(R.ready_for_offer(S.projects(spark, sf)), S.services(spark, sf), size(spark, sf))
    return out.withColumn("phase_no", F.col("phase_no").cast("long"))


@query(f"""WITH {PHASES}, {S.SERVICES} SELECT project_id, phase_no, ph.phase, pos, s.text FROM services s, ph WHERE contains(coalesce(s.phase, ''), ph.phase)""")
def services_by_phase(spark, sf):
    return R.scope_services(S.services(spark, sf)).withColumn("phase_no", F.col("phase_no").cast("long"))


@query("""WITH q AS (SELECT o_custkey AS project_id, o_orderkey AS pos, CASE WHEN o_orderstatus = 'P' THEN 'Sonstiges' ELSE o_orderstatus END AS category, o_orderpriority AS question FROM orders)
  SELECT *, min(pos) OVER (PARTITION BY project_id, category) AS category_pos FROM q""")
def question_list_by_category(spark, sf):
    q = S.read(spark, sf, "orders").select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("pos"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("category"), F.col("o_orderpriority").alias("question"))
    return R.question_list(q, ["project_id"])


@query("""SELECT doc_id, '[' || coalesce((CASE WHEN doc_id % 5 <> 0 THEN doc_id END)::VARCHAR, '?') || '] ' || source AS heading, upper(lang) AS rating_label, trim(text) AS quote,
  CASE WHEN coalesce(trim(text), '') = '' THEN '' WHEN doc_id % 3 = 0 AND doc_id % 4 = 0 THEN '' ELSE ' (Quelle: ' || concat_ws(', ',
    CASE WHEN doc_id % 3 <> 0 THEN source END, CASE WHEN doc_id % 4 <> 0 THEN 'Absatz ' || doc_id END) || ')' END AS citation FROM documents""")
def finding_list(spark, sf):
    k = F.col("doc_id")
    f = S.read(spark, sf, "documents").select(
        "doc_id", F.when(k % 5 != 0, k).alias("number"), F.col("source").alias("title"), F.trim("text").alias("quote"),
        F.col("lang").alias("rating"), F.when(k % 3 != 0, F.col("source")).otherwise("").alias("source_file"), F.when(k % 4 != 0, k).alias("source_para"))
    return R.finding_list(f).select("doc_id", "heading", "rating_label", "quote", "citation")


@query("""WITH v AS (SELECT o_custkey AS project_id, CASE WHEN o_orderstatus = 'F' THEN 'risiko' ELSE 'timeline' END AS report, count(*) AS version FROM orders GROUP BY ALL)
  SELECT c_custkey AS project_id, r.report, coalesce(v.version, 0) + 1 AS version, r.report || '_' || c_custkey || '_20260301_120000' AS file_name
  FROM customer CROSS JOIN (VALUES ('risiko'), ('timeline'), ('org')) r(report) LEFT JOIN v ON v.project_id = c_custkey AND v.report = r.report""")
def report_versions(spark, sf):
    v = S.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("project_id"), F.when(F.col("o_orderstatus") == "F", "risiko").otherwise("timeline").alias("report")).agg(
        F.count(F.lit(1)).alias("version"))
    return R.report_rows(S.projects(spark, sf), ["risiko", "timeline", "org"], F.lit("2026-03-01 12:00:00").cast("timestamp"), v).drop("created_at")

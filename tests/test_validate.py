"""Rules, routing, verdicts, questions and reports."""

from pyspark.sql import functions as F

from plumbline import schema
from plumbline.functions import vocabulary as V
from plumbline.plans import reports as R
from plumbline.plans import validate as Val


def make(spark, ddl, rows):
    names = [f.name for f in spark.createDataFrame([], ddl).schema.fields]
    return spark.createDataFrame([tuple({"project_id": 1, "pos": i, "sources": [], **r}.get(n) for n in names) for i, r in enumerate(rows)], ddl)


def src(name):
    return [{"file": name}]


def spaces(spark, rows):
    return make(spark, schema.SPACE, rows)


def ids(df):
    return sorted((r.rule_id, r.entity_id) for r in df.collect())


def test_contradictions_compare_with_the_first_row(spark):
    s = spaces(spark, [{"id": "a", "area_m2": 20.0, "sources": src("x")}, {"id": "a", "area_m2": 20.05}, {"id": "a", "area_m2": 20.2, "sources": src("y")},
                       {"id": "b", "area_m2": 0.0}, {"id": "b", "area_m2": 9.0}, {"id": None, "area_m2": 1.0}, {"id": None, "area_m2": 2.0}])
    got = Val.space_area_by_id(s).collect()
    assert sorted((r.pos, r.entity_id) for r in got) == [(2, "a"), (6, None)]
    assert [r.source_files for r in got if r.pos == 2] == [["x", "y"]]


def test_numbers_are_compared_without_case_and_without_empty_ones(spark):
    s = spaces(spark, [{"id": "a", "number": "N1", "area_m2": 1.0}, {"id": "b", "number": "n1", "area_m2": 2.0},
                       {"id": "c", "number": "", "area_m2": 1.0}, {"id": "d", "number": "", "area_m2": 2.0}])
    assert ids(Val.space_area_by_number(s)) == [("V02", "b")]


def test_volume(spark):
    s = spaces(spark, [{"id": "a", "area_m2": 10.0, "height_m": 2.0, "volume_m3": 20.5}, {"id": "b", "area_m2": 10.0, "height_m": 2.0, "volume_m3": 20.6},
                       {"id": "c", "area_m2": 0.0, "height_m": 2.0, "volume_m3": 9.0}])
    assert ids(Val.space_volume(s)) == [("V03", "b")]


def test_equipment_gets_one_issue_only(spark):
    e = make(spark, schema.EQUIPMENT, [
        {"id": "none", "system_id": "", "space_id": None}, {"id": "both", "system_id": "S9", "space_id": "R9"}, {"id": "space", "system_id": "S1", "space_id": "R9"},
        {"id": "fine", "system_id": "S1", "space_id": "R1"}, {"id": "half", "system_id": None, "space_id": "R1"}, {"id": "other", "project_id": 2, "system_id": "S1", "space_id": None}])
    y, s = make(spark, schema.SYSTEM, [{"id": "S1"}]), spaces(spark, [{"id": "R1"}])
    assert ids(Val.equipment_references(e, y, s)) == [("V05", "none"), ("V06", "both"), ("V06", "other"), ("V07", "space")]


def test_list_references_one_issue_per_element(spark):
    y = make(spark, schema.SYSTEM, [{"id": "S", "space_ids": ["R1", "x", "x", None]}, {"id": "T", "space_ids": None}])
    s = spaces(spark, [{"id": "R1"}])
    assert ids(Val.dangling(y, "space_ids", s, "V08", "Anlage ", "Raum ")) == [("V08", "S")] * 3
    with_null = spaces(spark, [{"id": "R1"}, {"id": None}])
    assert ids(Val.dangling(y, "space_ids", with_null, "V08", "Anlage ", "Raum ")) == [("V08", "S")] * 2


def test_ranges_and_routing(spark):
    s = spaces(spark, [{"id": "neg", "area_m2": -1.0, "height_m": 11.0}, {"id": "big", "area_m2": 10000.5, "volume_m3": 0.0, "height_m": 0.0}])
    issues = Val.space_ranges(s)
    assert ids(issues) == [("V13", "neg"), ("V14", "big"), ("V15", "big"), ("V16", "big"), ("V17", "neg")]
    # critical plausibility issues fall out of the default routing
    assert ids(Val.route(issues)) == [("V14", "big"), ("V17", "neg")]
    assert len(ids(Val.route(issues, "all"))) == 5


def test_specification(spark):
    p = spark.createDataFrame([(1, "A", None, "", "x", None), (2, "B", None, "Bern", "x", None)], schema.PROJECT)
    assert sorted(r.project_id for r in Val.project_fields(p, ["name", "standort"]).collect()) == [1]
    s = spaces(spark, [{"id": "a", "name": ""}])
    assert sorted(r.project_id for r in Val.too_few(p, s, 1).collect()) == [2]
    # empty text passes, null does not
    assert len(Val.required_fields(s, ["id", "name", "flaeche_m2"], "V24", "kritisch", "Raum ").collect()) == 1


def full_model(spark):
    return {
        "projects": spark.createDataFrame([(1, "A", None, "Bern", "offertreif", None), (2, "B", None, "Chur", "created", None)], schema.PROJECT),
        "spaces": spaces(spark, [{"id": "R1", "name": "r", "area_m2": 20.0}, {"id": "R1", "name": "r", "area_m2": 30.0}, {"id": "R3", "name": "x", "project_id": 2, "area_m2": -1.0}]),
        "systems": make(spark, schema.SYSTEM, [{"id": "S1", "kind": "L"}]),
        "equipment": make(spark, schema.EQUIPMENT, [{"id": "G"}, {"id": "H", "system_id": "S1"}]),
        "milestones": make(spark, schema.MILESTONE, [{"id": "T", "text": "Start", "service_id": "L9", "phase": "SIA 104 - Vorprojekt"}]),
        "services": make(spark, schema.SERVICE, [{"id": "L", "text": "Projektanalyse gross", "phase": "SIA 103 - Projektierung"}])}


def test_all_rules_verdicts_and_questions(spark):
    m = full_model(spark)
    routed = Val.route(Val.all_issues(m))
    assert ids(routed) == [("V01", "R1"), ("V05", "G"), ("V12", "T")]
    v = {r.project_id: (r.fehler, r.warnungen, r.consistent, r.status) for r in Val.verdicts(m["projects"], routed).collect()}
    assert v == {1: (1, 2, False, "validation_errors"), 2: (0, 0, True, "validated")}
    q = R.questions(routed).orderBy("bucket_order", "pos", "question").collect()
    assert [(r.priority, r.entity_id) for r in q] == [("kritisch", "R1"), ("wichtig", "G"), ("wichtig", "T")]
    missing = {(r.phase, r.demand) for r in Val.missing_services(m["services"]).collect()}
    assert len(missing) == 8 and ("SIA 103 - Projektierung", "Projektanalyse") not in missing
    everyone = m["projects"].select("id").unionByName(spark.createDataFrame([(77,)], "id long"))
    assert Val.missing_services(m["services"], projects=everyone).filter("project_id = 77").count() == 9


def test_rows_without_reference_id_texts(spark):
    text = Val.equipment_references(
        make(spark, schema.EQUIPMENT, [{"id": "G", "system_id": "S9", "sources": src(None)}]), make(spark, schema.SYSTEM, []), spaces(spark, [])).first()
    assert text.text == "Gerät G referenziert nicht existierende Anlage S9" and text.source_files == ["unbekannt"]


def test_risks(spark):
    size = spark.createDataFrame([(1, 101, 21, 3, 2), (2, 100, 20, 0, 0)], "project_id long, spaces long, systems long, equipment long, spaces_without_area long")
    verdicts = spark.createDataFrame([(1, 4), (2, 0)], "project_id long, fehler long")
    risks = R.threshold_risks(size, verdicts).orderBy("risk_no").collect()
    assert [(r.project_id, r.risk_no, r.level) for r in risks] == [(1, 1, "HOCH"), (1, 2, "HOCH"), (1, 3, "HOCH"), (1, 4, "KRITISCH")]
    assert risks[0].teaser == "2 Räume ohne Flächenangabe..."
    unknown = spark.range(1).select(R.risk_level(F.lit("hoch"), F.lit("keine"))).first()[0]
    assert unknown == "UNBEKANNT"


def test_timeline_staffing_scope(spark):
    m = full_model(spark)
    t = R.timeline(m["projects"], m["services"], m["milestones"], "2026-01-01").filter("project_id = 1").collect()
    frame = {r.phase_no: (str(r.starts), str(r.ends)) for r in t if r.item_kind == "phase"}
    assert frame == {1: ("2026-01-01", "2026-01-31"), 2: ("2026-01-31", "2026-04-01"), 3: ("2026-04-01", "2026-06-30")}
    assert [(r.item_kind, r.phase_no, r.due) for r in t if r.item_kind != "phase"] == [("service", 1, None), ("milestone", 2, "-")]
    size = R.project_size(m["spaces"], m["systems"], m["equipment"])
    s = R.scope(R.ready_for_offer(m["projects"]), m["services"], size).orderBy("phase_no").collect()
    assert [(r.project_id, r.services, r.spaces) for r in s] == [(1, 1, 2), (1, 0, 2), (1, 0, 2)]
    assert R.responsibilities(m["projects"]).count() == 2 * len(V.RESPONSIBILITIES)
    assert {r.project_id: r.team for r in R.staffing(size).collect()} == {1: 2, 2: 2}


def test_question_list_and_findings(spark):
    q = spark.createDataFrame([(1, 3, None, "c"), (1, 1, "B", "a"), (1, 2, None, "b"), (1, 4, "B", "d")], "project_id long, pos long, category string, question string")
    got = [(r.category, r.question) for r in R.question_list(q, ["project_id"]).orderBy("category_pos", "pos").collect()]
    assert got == [("B", "a"), ("B", "d"), ("Sonstiges", "b"), ("Sonstiges", "c")]
    f = spark.createDataFrame([(1, "T", "zitat", "rot", "a.pdf", 4), (None, "U", "zitat", "grün", None, None), (2, "V", "", "rot", "a", 1)],
                              "number int, title string, quote string, rating string, source_file string, source_para int")
    assert [(r.heading, r.citation) for r in R.finding_list(f).collect()] == [
        ("[1] T", " (Quelle: a.pdf, Absatz 4)"), ("[?] U", ""), ("[2] V", "")]

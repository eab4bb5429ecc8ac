"""Extraction from text, tables, layouts and building models on hand-written rows."""

from pyspark.sql import functions as F

from plumbline import schema
from plumbline.functions import vocabulary as V
from plumbline.plans import extract_model as EM
from plumbline.plans import extract_tables as ET
from plumbline.plans import extract_text as E


def sheet(spark, name, rows, file_id=1, start=1):
    """rows: lists of values from row `start`; numbers keep their type."""
    out = []
    for r, values in enumerate(rows, start):
        for c, v in enumerate(values, 1):
            if v is not None:
                out.append((file_id, name, r, c, str(v), "n" if isinstance(v, (int, float)) else "s"))
    return spark.createDataFrame(out, schema.CELL)


def parts(cells):
    rows = ET.sheet_rows(cells)
    return rows, ET.sheet_layout(rows)


def test_requirement_from_paragraph(spark):
    rows = [(1, 0, "Heading 1", "Lüftung"), (1, 1, "Normal", "  "), (1, 2, "Normal", "Die Temperatur muss stimmen, Vorprojekt SIA 103"),
            (1, 3, "Überschrift 3", "Energie"), (1, 4, "List Bullet", "Vorgabe: sollte 20 sein"), (1, 5, "Normal", "Ohne Bedeutung")]
    p = spark.createDataFrame(rows, schema.PARAGRAPH)
    got = {r.id: r for r in E.requirements_from_paragraphs(p).collect()}
    assert set(got) == {"REQ_0002", "REQ_0004"}
    r = got["REQ_0002"]
    assert (r.category, r.priority, r.phase, r.section) == ("technisch", "hoch", "SIA 104 - Vorprojekt", "lüftung")
    assert (got["REQ_0004"].priority, got["REQ_0004"].section) == ("niedrig", "energie")
    assert [r.id for r in E.requirements_from_lists(p).collect()] == ["REQ_LIST_0004"]
    assert sorted((r.section, r.level, r.para_idx) for r in E.sections(p).collect()) == [("energie", 3, 3), ("lüftung", 1, 0)]


def test_page_paragraphs(spark):
    long = "x" * 2500
    t = spark.createDataFrame([(1, "kurz\n\n" + "\n\n".join(["Absatz mit genug Zeichen " + str(i) for i in range(120)]) + "\n\n" + long)],
                              "file_id long, text string")
    capped = E.requirements_from_pages(t, limit=100, longest=2000).collect()
    assert len(capped) == 100 and capped[0].id == "ANF_0000"
    whole = E.requirements_from_pages(t).collect()
    assert len(whole) == 121 and max(len(r.text) for r in whole) == 2500
    assert max(len(r.text) for r in E.requirements_from_pages(t, longest=2000).collect()) == 2000


def test_page_text_skips_empty_pages(spark):
    p = spark.createDataFrame([(1, 2, "zwei"), (1, 1, "eins"), (1, 3, "")], schema.PAGE)
    assert E.page_text(p).first().text == "--- Seite 1 ---\neins\n\n--- Seite 2 ---\nzwei"


def test_plan_text(spark):
    text = "R.12 20,5 m² lüa 3 Raum 7A HK Fläche: 8.25 m"
    p = spark.createDataFrame([(1, 1, text)], schema.PAGE)
    assert {r.number for r in E.plan_spaces(p).collect()} >= {"12", "7A", "8.25"}
    assert {(r.id, r.name) for r in E.plan_systems(p).collect()} >= {("ANL_lüa_3", "lüa 3"), ("ANL_HK_1", "HK")}
    assert [(r.number, r.area_m2) for r in E.plan_areas(p).orderBy("position").collect()] == [("12", 20.5), ("7A", 8.25)]
    ids = {r.id for r in E.plan_symbols(p).collect()}
    assert f"GERAET_heizkoerper_1_{text.index('HK')}" in ids


def test_needs_scan(spark):
    d = spark.createDataFrame([("kurz",), ("x" * 50,), (None,)], "t string")
    assert [r[0] for r in d.select(E.needs_scan("t")).collect()] == [True, False, True]


def test_spaces_from_sheet(spark):
    cells = sheet(spark, "Raumliste", [
        [None, None, None, None],
        ["Raum Nr", "Fläche m²", "Volumen", "Bezeichnung"],
        ["alt", "12,5 m²", 30, "Büro 1"],
        ["alt", "1.234,5", -2.5, "Summe"],
        ["alt", "ca. 20", None, "Lager"],
        ["nur alt", 7, None, None]])
    rows, layout = parts(cells)
    got = {r.id: r for r in ET.spaces_from_sheets(rows, layout).collect()}
    # two headers fit the name role: the last column wins, so the row without it is no space
    assert set(got) == {"Raum_Büro_1", "Raum_Lager"}
    assert (got["Raum_Büro_1"].area_m2, got["Raum_Büro_1"].volume_m3, got["Raum_Büro_1"].row) == (12.5, 30.0, 3)
    assert got["Raum_Lager"].area_m2 is None


def test_table_kind_by_name_then_by_text(spark):
    cells = sheet(spark, "Blatt", [["Datum", "Abgabe"]], 1).unionByName(sheet(spark, "LV", [["Raum"]], 2)).unionByName(
        sheet(spark, "Leer", [["x"]], 3)).unionByName(sheet(spark, "Blatt2", [["Typ", "Raum"]], 4))
    kinds = {r.file_id: r.kind for r in parts(cells)[1].collect()}
    assert kinds == {1: "terminplan", 2: "leistungsverzeichnis", 3: None, 4: "raumliste"}


def test_equipment_names_fall_back_to_kind_and_back(spark):
    cells = sheet(spark, "Geräte", [["Typ", "Name", "kW"], ["Pumpe", None, 2], [None, "P 2", "3,5"], [None, None, 9]])
    got = sorted((r.id, r.kind, r.name, r.power_kw) for r in ET.equipment_from_sheets(*parts(cells)).collect())
    assert got == [("GER_P_2_3", "P 2", "P 2", 3.5), ("GER_Pumpe_2", "Pumpe", "Pumpe", 2.0)]


def test_milestones_and_services(spark):
    m = sheet(spark, "Terminplan", [["Aufgabe", "Datum", "Art"], ["Start", "KW 3", None], [None, "x", None]])
    got = [(r.id, r.text, r.due, r.category) for r in ET.milestones_from_sheets(*parts(m)).collect()]
    assert got == [("TERM_0002", "Start", "KW 3", "Meilenstein")]
    s = sheet(spark, "LV", [["Position", "Einheit", "Menge"], ["Plan", "h", "ca 4"], ["Bau", "Stk", 2]])
    got = sorted((r.text, r.unit, r.quantity) for r in ET.services_from_sheets(*parts(s)).collect())
    assert got == [("Bau", "Stk", 2.0), ("Plan", "h", 4.0)]
    a = sheet(spark, "Anlagen", [["Anlage", "Volumenstrom", "kW"], ["A1", "1'200", 5]])
    assert [(r.name, r.kind, r.flow_m3h, r.power_kw) for r in ET.systems_from_sheets(*parts(a)).collect()] == [("A1", "A1", 1.0, 5.0)]


def test_raw_table(spark):
    cells = sheet(spark, "T", [["A", None, "A"], ["1", "2", "3"], [None, None, None], [None, "5", None]]).unionByName(
        sheet(spark, "U", [["nur", "Kopf"]], 2))
    rows, layout = parts(cells)
    raw = {(r.file_id, r.row): r["values"] for r in ET.raw_rows(rows, layout).collect()}
    assert raw == {(1, 2): {"A": "3", "Spalte_2": "2"}, (1, 4): {"A": "", "Spalte_2": "5"}, (2, 1): {"nur": "nur", "Kopf": "Kopf"}}
    s = {r.file_id: (r.row_count, r.column_count) for r in ET.raw_table_summary(ET.raw_rows(rows, layout), layout).collect()}
    assert s == {1: (2, 3), 2: (1, 2)}


def test_raw_table_stops_after_100_empty_rows(spark):
    near = sheet(spark, "S", [["H"]]).unionByName(sheet(spark, "S", [["a"]], start=2)).unionByName(
        sheet(spark, "S", [["b"]], start=102)).unionByName(sheet(spark, "S", [["c"]], start=203))
    rows, layout = parts(near)
    assert sorted(r.row for r in ET.raw_rows(rows, layout).collect()) == [2, 102, 203]
    assert sorted(r.row for r in ET.raw_rows(rows, layout, empty_stop=100).collect()) == [2, 102]
    assert [r.cell for r in ET.loose_cells_after_stop(near.withColumn("value", F.concat("value", F.lit("xx"))), rows, layout).collect()] == ["A203"]


def test_formula_flag_and_headers(spark):
    cells = sheet(spark, "F", [["Kopf"], ["1"]]).withColumn("dtype", F.when(F.col("row") == 2, "f").otherwise("s"))
    layout = parts(cells)[1]
    assert layout.first().has_formulas is True
    assert layout.select(ET.header_list(F.col("header_cells"), F.col("max_col")).alias("h")).first().h == ["Kopf"]


def test_document_tables(spark):
    def table(rows, idx):
        return [(1, idx, r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row)]
    cells = spark.createDataFrame(
        table([["Raum", "Fläche", "Nutzung"], [" Büro 1 ", "12,5", "Büro"], ["Lager", "ca. 9", ""], ["kurz", "1"]], 0)
        + table([["Gerät", "Typ", "kW"], ["", "Pumpe", "2"], ["", "", "1"]], 1)
        + table([["Aufgabe", "Datum"], ["Start", "KW 3"], ["", "KW 4"]], 2), schema.TABLE_CELL)
    rows = ET.document_rows(cells)
    spaces = sorted((r.id, r.name, r.area_m2) for r in ET.spaces_from_documents(rows).collect())
    assert spaces == [("Raum_Büro_1_0_1", "Büro 1", 12.5), ("Raum_Lager_0_2", "Lager", None)]
    assert [(r.id, r.name, r.kind, r.power_kw) for r in ET.equipment_from_documents(rows).collect()] == [("GER_1_1", "", "Pumpe", 2.0)]
    assert [(r.id, r.due) for r in ET.milestones_from_documents(rows).collect()] == [("TERM_2_1", "KW 3")]
    assert ET.raw_document_rows(rows).filter("table_idx = 0").count() == 3


def test_layout_tokens(spark):
    t = [("Raum", 10, 5), ("Fläche", 200, 8), ("einzeln", 10, 25), ("B2", 12, 41), ("9,5", 210, 55), ("8", 220, -3), ("oben", 1, -19)]
    tokens = spark.createDataFrame([(1, 1, w, left, top, 9) for w, left, top in t], schema.TOKEN)
    lines = {r.band: r.line for r in ET.layout_lines(tokens).collect()}
    assert lines == {-1: "oben 8", 0: "Raum Fläche", 1: "einzeln", 2: "B2 9,5"}
    rows = ET.layout_rows(tokens.filter("top >= 0"))
    assert [(r.row, r["values"]) for r in rows.orderBy("row").collect()] == [(0, ["Raum", "Fläche"]), (1, ["B2", "9,5"])]
    assert [(r.name, r.area_m2) for r in ET.spaces_from_documents(rows).collect()] == [("B2", 9.5)]


def model(spark):
    sets = {"Pset_SpaceCommon": {"Usage": "Büro", "Level": "EG"}, "Q": {"NetFloorArea": "0", "GrossFloorArea": "20", "Height": "2.5"}}
    o = [
        (1, "IFC4", "s1", "IfcSpace", "101", "Büro", None, None, sets), (1, "IFC4", "s2", "IfcSpace", "102", None, None, None, None),
        (1, "IFC4", "z", "IfcZone", None, None, None, None, None), (1, "IFC4", "z2", "IfcZone", "Nord", None, None, None, None),
        (1, "IFC4", "st", "IfcBuildingStorey", "1. OG", None, None, None, None),
        (1, "IFC4", "y", "IfcSystem", "Zuluft", None, None, "HVAC", {"P": {"TotalPower": "0", "Power": "3"}}),
        (1, "IFC4", "y2", "IfcSystem", "Strom", None, None, "Electrical", None),
        (1, "IFC4", "e", "IfcMechanicalEquipment", "WP", None, None, None, {"Pset_MechanicalEquipment": {"Power": "", "TotalPower": "7"}}),
        (1, "IFC4", "e2", "IfcPump", "P", None, None, None, None),
        (1, "IFC4", "t", "IfcFlowTerminal", None, None, None, None, {"Pset_FlowTerminal": {"AirFlowRate": "50"}}),
        (2, "IFC2X3", "p", "IfcPump", "P", None, None, None, None), (2, "IFC2X3", "p", "IfcPump", "P", None, None, None, None),
        (2, "IFC2X3", "m", "IfcMechanicalEquipment", "M", None, None, None, None),
        (3, None, "m3", "IfcMechanicalEquipment", "M", None, None, None, None),
        (4, None, "p4", "IfcFan", "F", None, None, None, None), (4, None, "m4", "IfcMechanicalEquipment", "M", None, None, None, None)]
    r = [(1, 5, "IfcRelAssignsToGroup", "z2", "s1"), (1, 3, "IfcRelAssignsToGroup", "z", "s1"), (1, 1, "IfcRelAssignsToGroup", "y", "s1"),
         (1, 1, "IfcRelContainedInSpatialStructure", "st", "s2"),
         (1, 1, "IfcRelServicesBuildings", "y", "s1"), (1, 2, "IfcRelServicesBuildings", "y", "s1"), (1, 3, "IfcRelServicesBuildings", "y2", "s1")]
    return spark.createDataFrame(o, schema.MODEL_OBJECT), spark.createDataFrame(r, schema.MODEL_RELATION)


def test_building_model(spark):
    o, r = model(spark)
    s = {x.guid: x for x in EM.spaces_from_model(o, r).collect()}
    assert (s["s1"].area_m2, s["s1"].height_m, s["s1"].zone, s["s1"].storey, s["s1"].usage) == (20.0, 2.5, "z", "EG", "Büro")
    assert (s["s2"].name, s["s2"].storey, s["s2"].area_m2) == ("102", "1. OG", None)
    y = EM.systems_from_model(o).collect()
    assert [(x.id, x.power_kw) for x in y] == [("ANL_y", 3.0)]
    e = {(x.file_id, x.guid): x for x in EM.equipment_from_model(o).collect()}
    assert set(e) == {(1, "e"), (1, "t"), (2, "p"), (3, "m3"), (4, "p4")}
    assert (e[(1, "e")].power_kw, e[(1, "t")].flow_m3h, e[(1, "t")].kind) == (7.0, 50.0, "Flow Terminal")
    served = EM.served_spaces(r, EM.systems_from_model(o), EM.spaces_from_model(o, r)).collect()
    assert [(x.system_id, x.space_id) for x in served] == [("ANL_y", "Raum_s1")]


def test_rows_far_below_the_header_count(spark):
    cells = spark.createDataFrame(
        [(1, "Raum", 1, 1, "Raum", "s"), (1, "Raum", V.SHEET_ROW_LIMIT + 1, 1, "drin", "s"), (1, "Raum", V.SHEET_ROW_LIMIT + 2, 1, "draussen", "s")], schema.CELL)
    assert sorted(r.name for r in ET.spaces_from_sheets(*parts(cells)).collect()) == ["draussen", "drin"]
    rows, layout = parts(cells)
    assert ET.raw_rows(rows, layout).count() == 2 and ET.raw_rows(rows, layout, row_limit=V.SHEET_ROW_LIMIT - 1).count() == 1
    assert ET.loose_cells(cells, layout).count() == 0 and ET.loose_cells(cells, layout, row_limit=V.SHEET_ROW_LIMIT).count() == 1


def test_each_supplier_serves_all_customers_of_its_nation(spark, tmp_path):
    from contract import extraction as E
    spark.createDataFrame([(k, f"Customer {k}", k % 2, "BUILDING") for k in range(40)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(3)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    served = E.model_relations(spark, str(tmp_path)).filter("rel_class = 'IfcRelServicesBuildings'").select("relating_guid", "related_guid").distinct()
    assert {tuple(r) for r in served.collect()} == {(f"S{s}", f"C{c}") for s in range(3) for c in range(40) if s % 2 == c % 2}


def test_served_spaces_are_collapsed_where_the_relations_lie(spark, tmp_path):
    """Ids that several objects share, null ids and repeated relations count once, and no relation is sorted or shuffled for a join."""
    import re
    from contract import extraction as E
    rel = spark.createDataFrame([(1, n, "IfcRelServicesBuildings", a, b) for n, (a, b) in enumerate(
        [("y1", "s1"), ("y1", "s1"), ("y2", "s1"), ("y1", "s2"), ("y3", "s3"), ("y3", "s4"), ("y3", "s5"), (None, "s1"), ("y1", None), ("y9", "s1")])],
        "file_id long, rel_order int, rel_class string, relating_guid string, related_guid string")
    systems = spark.createDataFrame([(1, "Y", "y1"), (1, "Y", "y2"), (1, "Z", "y3"), (1, "N", None)], "file_id long, id string, guid string")
    spaces = spark.createDataFrame([(1, "S", "s1"), (1, "S", "s2"), (1, None, "s3"), (1, None, "s4"), (1, "T", "s5"), (2, "S", "s1")], "file_id long, id string, guid string")
    served = EM.served_spaces(rel, systems, spaces).collect()
    assert {(x.file_id, x.system_id, x.space_id, x.rel_order) for x in served} == {(1, "Y", "S", 0), (1, "Z", None, 4), (1, "Z", "T", 6)} and len(served) == 3
    spark.createDataFrame([(k, f"Customer {k}", k % 2, "BUILDING") for k in range(40)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(3)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    relations = E.model_relations(spark, str(tmp_path))
    assert relations.filter("rel_class = 'IfcRelServicesBuildings'").count() == 60 + 40
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = EM.served_spaces(relations, systems, spaces)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert not re.search(r"SortMergeJoin \[file_id#\d+L?, rela(ting|ted)_guid", plan)

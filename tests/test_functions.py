"""Scalar functions, one row per quirk."""

from pyspark.sql import functions as F

from plumbline.functions import predicates as P
from plumbline.functions import text as X
from plumbline.functions import vocabulary as V
from plumbline.plans import extract_text as E


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("x")).collect()]


def test_tolerant_number(spark):
    got = apply(spark, X.tolerant_number, ["12,5 m²", "1.234,5", "1'234", "ca. 20", "-5", "5.", ".5", "", None])
    assert got == [12.5, None, 1.0, None, 5.0, 5.0, 0.5, None, None]


def test_strict_number(spark):
    got = apply(spark, X.strict_number, [" 12,5 ", "12 m", "5d", "1e3", ".5", "5.", "-2", "nan", ""])
    assert got == [12.5, None, None, 1000.0, 0.5, 5.0, -2.0, None, None]


def test_column_letters(spark):
    got = apply(spark, X.column_letters, [1, 26, 27, 52, 702, 703, 18278], "int")
    assert got == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "ZZZ"]


def test_strip_takes_all_white_space(spark):
    assert apply(spark, X.strip, ["\t a b \n", "", None]) == ["a b", "", None]


def test_revision(spark):
    got = apply(spark, X.revision, ["PlanXYZ_RevB.pdf", "v1.2.pdf", "Revision 3", "a_r4", "R5_x", "plan.pdf"])
    assert got == ["B.", "1.2", "3", "r4", "R5", None]


def test_document_type_takes_the_first_rule(spark):
    got = apply(spark, X.document_type, ["Raumliste Grundriss.xlsx", "GRUNDRISS.pdf", "Brief Terminplan", "x"])
    assert got == ["raumliste", "grundrissplan", "terminplan", None]


def test_file_type_falls_back_to_mime(spark):
    df = spark.createDataFrame([(".PDF", None), (".x", "image/png"), (".x", "text/plain"), (".zip", "image/png")], "e string, m string")
    assert [r[0] for r in df.select(X.file_type("e", "m")).collect()] == ["PDF", "Image", "Unknown", "ZIP"]


def test_phase_words_win_over_numbers(spark):
    got = apply(spark, X.phase_of, ["Vorprojekt SIA 103", "sia 104", "Phase 3", "nichts", "Bauprojekt und Projektierung"])
    assert got == ["SIA 104 - Vorprojekt", "SIA 104", "SIA 3", None, "SIA 103 - Projektierung"]


def test_project_number(spark):
    got = apply(spark, X.project_number, [
        "Projektnummer: 2026-01-MWI", "projektnummer:\n 2026-02-AB: Rest", "Umbau 2026-03-XYZ.", "Projektnummer: : x 2026-01-AB", None])
    assert got == ["2026-01-MWI", "2026-02-AB", "2026-03-XYZ", None, None]


def test_ratings_and_priorities(spark):
    assert apply(spark, X.rating, ["ROT", "gruen", "hoch", None, "eher grün"]) == ["rot", "grün", "orange", "orange", "grün"]
    assert apply(spark, X.priority, ["Hoch", "very high", "LOW", "", None]) == ["hoch", "hoch", "niedrig", "mittel", "mittel"]


def test_without_fence(spark):
    assert apply(spark, X.without_fence, ['```json\n{"a": 1}\n```', "```\n{}", " {} ", "```"]) == ['{"a": 1}', "{}", "{}", ""]


def test_labels_in_plan_text(spark):
    got = apply(spark, X.system_labels, ["lüa 3 und Wärmepumpe"])[0]
    assert [(r["name"], r["number"]) for r in got] == [("lüa", "3"), ("Wärmepumpe", "")]
    assert apply(spark, X.space_labels, ["R.12 Raum 7A r 12"])[0] == ["12", "7A"]
    assert apply(spark, X.area_values, ["20,5 m² und Fläche: 3.25"])[0] == [20.5, 3.25]


def test_markers(spark):
    df = spark.createDataFrame([("a.docx", 4), ("b.docx", None), (None, 0)], "f string, p int")
    marks = [r[0] for r in df.select(X.source_marker(F.col("f"), F.col("p"))).collect()]
    assert marks == ["[Datei: a.docx, Absatz 5]", "[Datei: b.docx]", "[Datei: Unbekannte Datei, Absatz 1]"]
    body = F.col("v")
    assert apply(spark, X.marker_file, ["a.docx, Absatz 5", "b.docx"]) == ["a.docx", "b.docx"]
    assert apply(spark, X.marker_para, ["a.docx, Absatz 5", "b.docx", "c, Absatz x"]) == [5, None, None]
    assert body is not None


def test_team_size(spark):
    df = spark.createDataFrame([(9, 4), (30, 10), (50, 5), (0, 0)], "s long, a long")
    assert [r[0] for r in df.select(X.team_size(F.col("s"), F.col("a"))).collect()] == [2, 4, 4, 2]
    assert [r[0] for r in df.select(X.drafters(F.col("s")))  .collect()] == [4, 15, 25, 1]


def test_overview_bullets(spark):
    long = "Ein ziemlich langer Satz mit genug Zeichen darin. " * 12
    got = apply(spark, X.overview_bullets, ["- a\n* b\n3) c", long, None, "Kurz. Knapp. Ein Satz mit mehr als dreissig Zeichen hier."])
    assert got[0] == ["a", "b", "c"]
    assert len(got[1]) == 5 and all(len(p) <= 200 for p in got[1])
    assert got[2] == []
    assert got[3] == ["Kurz Knapp", "Ein Satz mit mehr als dreissig Zeichen hier."]


def test_truth(spark):
    assert apply(spark, P.has_number, [0.0, None, 2.0], "double") == [False, False, True]
    assert apply(spark, P.has_text, ["", None, "x"]) == [False, False, True]
    assert apply(spark, lambda c: P.contains_any(c, ["muss"]), ["Das MUSS", None, "x"]) == [True, False, False]


def test_image_format(spark):
    got = apply(spark, X.image_format, [b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"GIF89a", b"BMxx", b"??"], "binary")
    assert got == ["jpeg", "png", "gif", "bmp", "unknown"]


def test_file_name_and_teaser(spark):
    assert apply(spark, X.safe_file_name, ['a/b\\c:d*e?f"g<h>i|j']) == ["a_b_c_d_e_f_g_h_i_j"]
    assert apply(spark, X.teaser, ["kurz"]) == ["kurz..."]


def test_positions_of_matches(spark):
    import re
    texts = ["Zuluft und ZA, za LA", "", "Abluft", "xZAZAx"]
    pattern = V.PLAN_SYMBOLS["lueftungsauslass"][1]
    got = apply(spark, lambda c: E.matches_with_position(c, pattern), texts)
    for text, rows in zip(texts, got):
        assert [(r["match"], r["position"]) for r in rows] == [(m.group(0), m.start()) for m in re.finditer(pattern, text, re.I)]

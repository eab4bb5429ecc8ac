"""Corpus, units, answers, attribution, history."""

import json

from pyspark.sql import functions as F

from plumbline.plans import review as R

PASSAGE = "project_id long, pos long, file string, para int, content string"


def corpus(spark):
    return R.corpus(spark.createDataFrame([
        (1, 0, "a.docx", 0, "Die Haftung ist offen\nund der Termin auch"), (1, 1, "b.docx", None, "Nichts davon"), (1, 2, "a.docx", 4, "Kosten und Recht"),
        (1, 3, None, None, ""), (2, 0, "c.docx", 1, "Norm")], PASSAGE))


def test_corpus_and_units(spark):
    c = corpus(spark)
    whole = {r.project_id: r.text for r in R.corpus_text(c).collect()}
    assert whole[1] == ("[Datei: a.docx, Absatz 1]\nDie Haftung ist offen\nund der Termin auch\n\n[Datei: b.docx]\nNichts davon\n\n"
                        "[Datei: a.docx, Absatz 5]\nKosten und Recht")
    docs = {(r.project_id, r.file): r.text for r in R.document_text(c).collect()}
    assert docs[(1, "a.docx")].count("[Datei:") == 2
    runs = [(r.pos, r.run, r.is_last) for r in R.document_runs(c).filter("project_id = 1").orderBy("pos").collect()]
    assert runs == [(0, 1, False), (1, 2, True), (2, 3, True)]
    cats = {(r.project_id, r.category): r.text for r in R.category_text(c).collect()}
    assert cats == {(1, "Haftung"): "Die Haftung ist offen", (1, "Termine"): "und der Termin auch", (1, "Honorierung"): "Kosten und Recht",
                    (1, "Rechte"): "Kosten und Recht", (1, "Rechtliches"): "Kosten und Recht", (2, "Rechtliches"): "Norm"}
    units = R.work_units(c)
    assert {r["pass"]: r["count"] for r in units.groupBy("pass").count().collect()} == {"document": 3, "category": 6, "whole": 2}
    budget = R.token_budget(units, ["project_id"], F.lit("abcd"), F.col("text"), limit=10).filter("project_id = 2").first()
    assert (budget.units, budget.units_over) == (3, 0)


def test_fallback_only_where_there_is_no_text(spark):
    alt = spark.createDataFrame([(1, 0, "x", None, "nein"), (3, 0, "y", 0, "ja")], PASSAGE)
    c = R.corpus(spark.createDataFrame([(1, 0, "a", None, "t")], PASSAGE), alt)
    assert sorted(r.marked for r in c.collect()) == ["[Datei: a]\nt", "[Datei: y, Absatz 1]\nja"]


def test_a_failing_unit_does_not_stop_the_others(spark):
    def analyser(unit, text):
        if unit == "b.docx":
            raise ValueError("kaputt")
        return text.upper()

    units = R.document_text(corpus(spark)).select("project_id", F.lit("document").alias("pass"), F.col("file").alias("unit"), "part", "text")
    got = {r.unit: (r.response is not None, r.error is not None) for r in R.analyse(units, analyser).collect()}
    assert got == {"a.docx": (True, False), "b.docx": (False, True), "c.docx": (True, False)}


def test_findings_from_answers(spark):
    point = {"titel": " T ", "zitat": "q", "risiko_rating": "ROT", "nummer": 7, "quelle_paragraph": 3}
    good = json.dumps({"allgemeine_einschaetzung": " gut ", "kritische_punkte": [point, {"titel": "", "zitat": "x"}, "text", {"titel": "U", "risiko_rating": "hoch"}]})
    a = spark.createDataFrame([("u", 1, f"```json\n{good}\n```"), ("u", 2, "kein json"), ("u", 3, "[1]"), ("u", 4, '{"kritische_punkte": []}')],
                              "unit string, pos long, response string")
    got = R.numbered(R.findings_from_answers(a), ["pos"]).orderBy("item_idx").collect()
    assert [(r.number, r.title, r.quote, r.rating, r.source_para) for r in got] == [(7, "T", "q", "rot", 3), (2, "U", "", "orange", None)]
    assert sorted(r.pos for r in R.bad_answers(a).collect()) == [2, 3]
    assert [r.assessment for r in R.overall_assessment(a, ["unit"], "pos").collect()] == ["gut"]
    q = json.dumps({"zusammenfassung": "z", "fragen": [{"frage": "Was?", "prioritaet": "High"}, {"frage": " "}]})
    b = spark.createDataFrame([("u", 1, q)], "unit string, pos long, response string")
    assert [(r.question, r.priority) for r in R.questions_from_answers(b).collect()] == [("Was?", "hoch")]


def test_attribution(spark):
    c = corpus(spark)
    quotes = [(0, "HAFTUNG ist", ""), (1, "vorne Nichts davon hinten", None), (2, "auch\n\n[datei: b", ""), (3, "gibt es nicht", ""), (4, "", ""), (5, "Kosten", "schon.pdf")]
    f = spark.createDataFrame([(1, i, q, s, None) for i, q, s in quotes], "project_id long, pos long, quote string, source_file string, source_para int")
    got = {r.pos: (r.source_file, r.source_para) for r in R.attribute(f, c).collect()}
    assert got == {0: ("a.docx", 1), 1: ("b.docx", None), 2: ("a.docx", 1), 3: (None, None), 4: ("a.docx", 1), 5: ("schon.pdf", None)}


def test_text_after_a_marker_ends_at_2000_characters(spark):
    long = "x" * 1990 + "ENDE" + "y" * 50
    c = R.corpus(spark.createDataFrame([(1, 0, "a", None, long), (1, 9, "b", None, "zwei")], PASSAGE))
    w = {r.pos: r.window for r in R.after_marker(c).collect()}
    assert w[0] == ("\n" + long)[:2000] and w[9] == "\nzwei"
    many = R.corpus(spark.createDataFrame([(1, i * 3, "f", None, str(i % 10)) for i in range(400)], PASSAGE))
    full = "\n\n".join(r.marked for r in many.orderBy("pos").collect())
    windows = {r.pos: r.window for r in R.after_marker(many, chars=60, width=5).collect()}
    at = 0
    for r in many.orderBy("pos").collect():
        start = at + len(r.marked) - len(r.content) - 1
        assert windows[r.pos] == full[start:start + 60]
        at += len(r.marked) + 2


def test_history(spark):
    r = spark.createDataFrame([(1, i, f"2026-01-{i:02d} 00:00:00") for i in range(1, 13)], "project_id long, review_id long, t string").select(
        "project_id", "review_id", F.col("t").cast("timestamp").alias("created_at"))
    assert sorted(x.review_id for x in R.review_history(r).collect()) == list(range(3, 13))
    assert R.latest_review(r).first().review_id == 12

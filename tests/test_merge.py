"""Survivorship, conflicts, lineage and the whole merge."""

from pyspark.sql import functions as F

from plumbline import schema
from plumbline.plans import merge as M


def spaces(spark, rows):
    names = [f.name for f in spark.createDataFrame([], schema.SPACE).schema.fields]
    return spark.createDataFrame(
        [tuple({"project_id": 1, "pos": i, "sources": [{"file": f"f{i}", "file_id": i}], **r}.get(n) for n in names) for i, r in enumerate(rows)], schema.SPACE)


def test_near_names_merge_and_keep_the_first_value(spark):
    s = spaces(spark, [
        {"id": "a", "name": "Büro 1", "area_m2": 20.0, "usage": None}, {"id": "b", "name": "Büro 2", "area_m2": 21.0, "usage": "Büro"},
        {"id": "c", "name": "Lager", "area_m2": None}, {"id": "c", "name": "Ganz anders", "area_m2": 5.0}, {"id": "d", "name": "Büro 3", "area_m2": 20.005},
        {"id": "e", "name": "Büro 4", "area_m2": 19.0}])
    out = M.merge_entities("spaces", s)
    merged = {r.id: r for r in out["merged"].collect()}
    assert {k: r.members for k, r in merged.items()} == {"a": 4, "c": 2}
    assert (merged["a"].area_m2, merged["a"].usage, merged["c"].area_m2, merged["c"].name) == (20.0, "Büro", 5.0, "Lager")
    # 0.005 is within tolerance; of the two real conflicts the last one stays
    c = out["conflicts"].collect()
    assert [(r.field, r.old, r.new, r.old_sources[0].file, r.new_sources[0].file) for r in c] == [("area_m2", 20.0, 19.0, "f0", "f5")]
    lines = out["lineage"].orderBy("pos", "member_pos").collect()
    assert [(r.pos, r.source.file) for r in lines] == [(0, "f0"), (0, "f1"), (0, "f4"), (0, "f5"), (2, "f2"), (2, "f3")]


def test_merge_again_changes_nothing_but_lineage(spark):
    s = spaces(spark, [{"id": "a", "name": "Büro", "area_m2": 1.0}, {"id": "b", "name": "Keller", "number": "K"}, {"id": "x", "name": "Dach", "number": "k"}])
    batch = s.withColumn("file_id", F.lit(9).cast("long"))
    both = M.in_arrival_order(s, batch).select(*s.columns)
    once, twice = M.merge_entities("spaces", s), M.merge_entities("spaces", both)
    key = lambda d: sorted((r.id, r.name, r.area_m2) for r in d["merged"].collect())
    assert key(once) == key(twice) == [("a", "Büro", 1.0), ("b", "Keller", None)]
    assert once["lineage"].count() * 2 == twice["lineage"].count() == 6


def test_equipment_with_two_empty_names_of_one_kind_merges(spark):
    rows = [(1, 0, "a", "Pumpe", "", None, None, None, None, "g1", []), (1, 1, "b", "pumpe", "", None, None, None, None, "g2", []),
            (1, 2, "c", "", "", None, None, None, None, "g3", []), (1, 3, "d", "", "", None, None, None, None, "g4", [])]
    e = spark.createDataFrame(rows, schema.EQUIPMENT)
    assert {r.pos: r.leader for r in M.equipment_clusters(e).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_milestones_need_the_same_date(spark):
    rows = [(1, 0, "a", "Abgabe Vorprojekt", None, None, None, None, [{"file": "x"}]), (1, 1, "b", "Abgabe Vorprojekt", "2026", None, None, None, [{"file": "y"}]),
            (1, 2, "c", "abgabe vorprojekt", None, None, None, None, [{"file": "z"}]), (1, 3, "d", None, None, None, None, None, [])]
    m = spark.createDataFrame(rows, schema.MILESTONE)
    out = M.merge_entities("milestones", m)
    assert sorted(r.id for r in out["merged"].collect()) == ["a", "b", "d"]
    assert sorted((r.pos, r.source.file) for r in out["lineage"].collect()) == [(0, "x"), (0, "z"), (1, "y")]


def test_system_links_are_distinct(spark):
    rows = [(1, 0, "S", "L", "Anlage", None, None, ["R1", "R2"], None, None, None, []), (1, 1, "S", "L", "x", None, None, ["R2", "R3"], ["G"], None, None, [])]
    out = M.merge_entities("systems", spark.createDataFrame(rows, schema.SYSTEM))
    assert sorted(r.linked_id for r in out["space_links"].collect()) == ["R1", "R2", "R3"]
    assert [r.linked_id for r in out["equipment_links"].collect()] == ["G"]


def test_requirements_pass_through(spark):
    r = spark.createDataFrame([(1, 0, "q", "t", "c", "p", None, None, None, [{"file": "x"}]), (1, 1, "q", "t", "c", "p", None, None, None, [])], schema.REQUIREMENT)
    out = M.merge_entities("requirements", r)
    assert out["merged"].count() == 2 and out["lineage"].count() == 1


def test_files_maps_and_texts(spark):
    known = spark.createDataFrame([(1, "a.pdf", 1)], "project_id long, name string, file_id long")
    new = spark.createDataFrame([(1, "a.pdf", 2), (1, "b.pdf", 4), (1, "b.pdf", 3), (2, "a.pdf", 5)], "project_id long, name string, file_id long")
    assert sorted((r.project_id, r["name"], r.file_id) for r in M.register_files(known, new).collect()) == [(1, "a.pdf", 1), (1, "b.pdf", 3), (2, "a.pdf", 5)]
    m = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3"})], "x map<string,string>, y map<string,string>")
    assert m.select(M.overlay_maps(F.col("x"), F.col("y")).alias("m")).first().m == {"a": "1", "b": None, "c": "3"}
    assert m.select(M.union_ids(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c"))).alias("u")).first().u == ["a", "b", "c"]
    base = spark.createDataFrame([([{"file": None, "file_id": 3}], {"file": "f", "file_id": 9})],
                                 "s array<struct<file:string,file_id:long>>, b struct<file:string,file_id:long>")
    got = base.select(M.overlay_source(F.col("s"), F.col("b"), ["file", "file_id"]).alias("o")).first().o
    assert [(x.file, x.file_id) for x in got] == [("f", 3)]
    texts = spark.createDataFrame([(1, "a"), (1, "  ")], "project_id long, content string")
    lists = spark.createDataFrame([(1, ["x", "", "y"])], "project_id long, contents array<string>")
    none = spark.createDataFrame([], "project_id long, entry int, content string")
    assert sorted(r.content for r in M.append_passages(none, texts, lists).collect()) == ["a", "x", "y"]


def test_lone_ids_collapse_without_merging_unnamed_rows(spark):
    """Ids of their own neither match nor stop equal names; rows without a name keep to their id; null ids are equal."""
    rows = [(1, 0, "a", "Fan", "x"), (1, 1, "b", "fan", "x"), (1, 2, "c", "", ""), (1, 3, "d", "", ""),
            (1, 4, None, "Pump", "y"), (1, 5, None, "Boiler", "z"), (1, 6, "e", "Valve", "w"), (2, 7, "a", "Fan", "x"),
            (1, 8, "e", "Damper", "v")]
    e = spark.createDataFrame(rows, "project_id long, pos long, id string, name string, kind string").withColumn("guid", F.lit(None).cast("string"))
    got = {r.pos: r.leader for r in M.equipment_clusters(e).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 6}

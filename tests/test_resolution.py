"""Incremental merge in batches equals one pass over all rows; a batch that is run again changes nothing."""

import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline import schema
from plumbline.plans import merge as M
from plumbline.streaming import resolution as R

KINDS = ["spaces", "systems", "equipment", "milestones"]
BASE = ["büro", "sitzungszimmer", "lager", "technik", "wc", "korridor nord", "labor", "x", ""]


def entity_rows(kind, n, seed):
    rnd = random.Random(seed)
    fields = [f.name for f in R._fields(schema.ENTITIES[kind])]
    for i in range(n):
        name = rnd.choice(BASE) + rnd.choice(["", f" {rnd.randint(1, 30)}"])
        row = {"project_id": rnd.choice([0, 1, 1, 1, 2]), "pos": i, "id": rnd.choice([None, *[f"id{rnd.randint(0, 90)}"] * 30]), "name": name, "text": name + " abgabe des plans",
               "guid": rnd.choice([None, "", f"g{rnd.randint(0, 60)}"]), "system_guid": rnd.choice([None, f"s{rnd.randint(0, 90)}"]), "number": rnd.choice([None, "", f"N{rnd.randint(0, 80)}"]),
               "kind": rnd.choice([None, "a", "B", ""]), "due": rnd.choice([None, "2026", "2027"]), "area_m2": rnd.choice([None, 10.0, 10.005, 12.0]), "height_m": rnd.choice([None, 2.5, 3.0]),
               "power_kw": rnd.choice([None, 5.0]), "space_ids": rnd.choice([None, ["R1", f"R{i % 5}"]]), "equipment_ids": [], "sources": [{"file": f"{kind}{i}", "file_id": i}]}
        yield tuple(row.get(f) for f in fields)


@pytest.fixture(scope="module")
def batches(spark):
    out = {}
    for kind in [*KINDS, "requirements"]:
        rows = list(entity_rows(kind, 150, kind))
        cut = [rows[:60], rows[60:110], rows[110:]]
        out[kind] = [spark.createDataFrame(r, schema.ENTITIES[kind]).repartition(3).withColumn("file_id", F.col("pos") % 3) for r in cut]
    return out


def in_order(kind, parts):
    """All rows with the positions that the batches get: batch by batch, by file, by place in the file."""
    df = None
    for part in parts:
        df = M.in_arrival_order(df, part)
    return df.drop("file_id").select(*R._types(kind))


def rows_of(df):
    return Counter(repr(r) for r in df.select(*sorted(df.columns)).collect())


def state(spark, out, upto=None):
    return {(kind, name): rows_of(df) for kind in [*KINDS, "requirements"] for name, df in R.merged_model(spark, out, kind, upto).items()}


@pytest.fixture(scope="module")
def model(spark, batches, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("model"))
    for k in range(3):
        R.merge_batch(spark, out, k, {kind: parts[k] for kind, parts in batches.items()})
    return out


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("n", [1, 3])
def test_batches_equal_one_pass(spark, batches, model, kind, n):
    want = M.merge_entities(kind, in_order(kind, batches[kind][:n]))
    got = R.merged_model(spark, model, kind, upto=n - 1)
    assert len({r.leader for r in got["clusters"].collect()}) < got["clusters"].count()
    for name in {"merged", "lineage", "clusters", "conflicts"} & set(want):
        assert rows_of(got[name]) == rows_of(want[name].select(*got[name].columns)), name
    if kind == "systems":
        for field in ("space", "equipment"):
            assert rows_of(got["links"].filter(f"field = '{field}_ids'").drop("field")) == rows_of(want[f"{field}_links"])


def test_kinds_without_rules_are_appended(spark, batches, model):
    got = R.merged_model(spark, model, "requirements")
    assert rows_of(got["merged"]) == rows_of(in_order("requirements", batches["requirements"]))
    assert got["lineage"].count() == 150


def test_a_repeated_batch_changes_nothing(spark, batches, model):
    before = state(spark, model)
    for k in (1, 2, 0):
        R.merge_batch(spark, model, k, {kind: batches[kind][k] for kind in ("spaces", "milestones", "requirements")})
    assert state(spark, model) == before
    versions = {r.project_id: r.version for r in R.project_versions(spark, model).collect()}
    assert versions == {0: 3, 1: 3, 2: 3}
    assert set(R.project_versions(spark, model, upto=0).toPandas()["version"]) == {1}


def test_a_batch_reads_the_buckets_of_its_projects_only(spark, model):
    one = spark.createDataFrame([(1,)], "project_id long")
    buckets = R._buckets_of(one)
    index = R._Tables(spark, model, "spaces", 3, buckets).read("index")
    assert len(buckets) == 1 and index.count() > 0
    assert all(f"/bucket={buckets[0]}/" in f for f in index.inputFiles() if index.count()) or "PartitionFilters" in index._jdf.queryExecution().toString()
    assert {r.project_id for r in index.select("project_id").distinct().collect()} == {1}


def test_empty_batches_and_rows_without_project(spark, tmp_path):
    rows = spark.createDataFrame(list(entity_rows("spaces", 5, 1)), schema.SPACE).withColumn("file_id", F.lit(0).cast("long"))
    out = str(tmp_path)
    R.merge_batch(spark, out, 0, {"spaces": rows.limit(0)})
    assert R.merged_model(spark, out, "spaces")["merged"].count() == 0
    R.merge_batch(spark, out, 1, {"spaces": rows.withColumn("project_id", F.when(F.col("pos") > 2, 7))})
    assert R.merged_model(spark, out, "spaces")["clusters"].count() == 2


def test_model_stream(spark, batches, tmp_path):
    """Files of all kinds arrive while the stream is down; each start goes on from the checkpoint."""
    drop, out, check = (str(tmp_path / x) for x in ("drop", "out", "check"))
    for k in range(3):
        parts = None
        for kind in ("systems", "milestones"):
            part = batches[kind][k].withColumn("entity", F.lit(kind))
            parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
        parts.write.mode("append").parquet(drop)
        stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1000).parquet(drop)
        R.model_stream(stream, out, check, ("systems", "milestones")).awaitTermination()
    for kind in ("systems", "milestones"):
        want = M.merge_entities(kind, in_order(kind, batches[kind]))
        got = R.merged_model(spark, out, kind)
        assert rows_of(got["merged"]) == rows_of(want["merged"].select(*got["merged"].columns))
    assert {r.version for r in R.project_versions(spark, out, ("systems",)).collect()} == {3}


def test_kinds_of_a_batch_are_merged_side_by_side(spark, batches, tmp_path, monkeypatch):
    """Each kind waits for the other: one after the other they would never meet."""
    meet, place = threading.Barrier(2, timeout=40), R._positions
    monkeypatch.setattr(R, "_positions", lambda *given: (meet.wait(), place(*given))[1])
    R.merge_batch(spark, str(tmp_path), 0, {kind: batches[kind][0] for kind in ("milestones", "requirements")})
    assert R.merged_model(spark, str(tmp_path), "milestones")["clusters"].count() == 60
    assert R.merged_model(spark, str(tmp_path), "requirements")["merged"].count() == 60

"""Ordered operators against plain loops, with stretches small enough to be crossed."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import ordered as O


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = []
    for key in ("a", "b", None):
        pos = 0
        for _ in range(120):
            pos += rnd.choice([1, 1, 1, 2, 7, 40])
            out.append((key, pos, rnd.choice([None, "x", "y", "z"])))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, pos long, v string").repartition(5)


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("width,levels", [(4, 1), (4, 2), (3, 3), (65536, 2)])
def test_fill_down(df, rows, width, levels):
    spec = (F.last(F.col("v"), ignorenulls=True), F.max_by(F.col("v"), F.when(F.col("v").isNotNull(), F.col("pos"))), "last",
            F.coalesce(F.col("_in_last"), F.col("_carry_last")))
    got = {(r.k, r.pos): r.last for r in O.with_carry(df, ["k"], "pos", {"last": spec}, width, levels).collect()}
    for key, g in groups(rows).items():
        last = None
        for _, pos, v in g:
            last = v if v is not None else last
            assert got[(key, pos)] == last


@pytest.mark.parametrize("width", [2, 5, 65536])
def test_renumber_and_previous(df, rows, width):
    n = {(r.k, r.pos): r.n for r in O.renumber(df, ["k"], "pos", "n", width).collect()}
    before = {(r.k, r.pos): r.b for r in O.previous(df, ["k"], "pos", F.col("pos"), "b", width).collect()}
    for key, g in groups(rows).items():
        for i, (_, pos, _) in enumerate(g):
            assert n[(key, pos)] == i + 1
            assert before[(key, pos)] == (g[i - 1][1] if i else None)


def test_islands(df, rows):
    known = [r for r in rows if r[2] is not None]
    got = {(r.k, r.pos): r.run for r in O.islands(df.filter("v is not null"), ["k"], "pos", "v", "run", 4).collect()}
    for key, g in groups(known).items():
        run, last = 0, object()
        for _, pos, v in g:
            run += v != last
            last = v
            assert got[(key, pos)] == run


@pytest.mark.parametrize("limit", [5, 30, 100])
def test_stop_after_gap(df, rows, limit):
    got = {(r.k, r.pos) for r in O.stop_after_gap(df.filter("k is not null"), ["k"], "pos", F.lit(1), limit, 8).collect()}
    for key, g in groups(rows).items():
        if key is None:
            continue
        want, last = set(), 0
        for _, pos, _ in g:
            if pos - last - 1 >= limit:
                break
            want.add((key, pos))
            last = pos
        assert {x for x in got if x[0] == key} == want


def test_stop_is_at_exactly_the_limit(spark):
    d = spark.createDataFrame([("s", 2), ("s", 102), ("t", 2), ("t", 103)], "k string, pos long")
    got = sorted((r.k, r.pos) for r in O.stop_after_gap(d, ["k"], "pos", F.lit(2), 100).collect())
    assert got == [("s", 2), ("s", 102), ("t", 2)]


def test_compared_with_first_uses_the_first_row(spark):
    d = spark.createDataFrame([(1, 0, 20.0), (1, 1, 20.05), (1, 2, 20.2), (2, 0, 1.0)], "k long, pos long, v double")
    got = {(r.pos, r.first.v) for r in O.compared_with_first(d, ["k"], "pos", ["v"]).collect()}
    assert got == {(1, 20.0), (2, 20.0)}


def test_joined_text_in_parts(spark):
    d = spark.createDataFrame([("a", i, str(i)) for i in range(25)], "k string, pos long, t string").repartition(7)
    whole = O.joined_text(d, ["k"], "pos", F.col("t"), ",").collect()
    assert [(r.part, r.text) for r in whole] == [(0, ",".join(map(str, range(25))))]
    far = d.withColumn("pos", F.col("pos") * F.lit(1 << 40))
    assert [(r.part, r.text) for r in O.joined_text(far, ["k"], "pos", F.col("t"), ",").collect()] == [(0, whole[0].text)]
    parts = O.joined_text(d, ["k"], "pos", F.col("t"), ",", rows_per_part=10).orderBy("part").collect()
    assert [r.part for r in parts] == [0, 1, 2]
    assert ",".join(r.text for r in parts) == whole[0].text


def test_keep_first_and_newest(spark):
    d = spark.createDataFrame([("a", 3, "late"), ("a", 1, "early"), ("b", 2, "only")], "k string, pos long, v string")
    assert sorted(r.v for r in O.keep_first(d, ["k"], "pos").collect()) == ["early", "only"]
    many = spark.createDataFrame([("p", i) for i in range(12)], "k string, at long")
    assert sorted(r.at for r in O.newest(many, ["k"], [F.desc("at")], 10).collect()) == list(range(2, 12))

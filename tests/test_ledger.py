"""A review that breaks off and goes on, and the as-of join of two tables."""

import os
import random
from collections import Counter

import pytest

from plumbline.operators import ordered as O
from plumbline.plans import review as R

UNIT = "project_id long, pass string, unit string, part long, text string"


def rows(n):
    return [(i % 3, "document", f"u{i}", 0, f"text {i}") for i in range(n)] + [(9, "document", "u0", 0, "text 0"), (9, "document", None, 0, None)]


def asker(log, bad=(), breaks=None):
    """Answers with the length, notes each unit it is asked for, fails for some, and kills its worker at one."""
    log = str(log)

    def ask(pairs):
        if breaks and any(u == breaks for u, _ in pairs):
            os._exit(1)
        if any(u in bad for u, _ in pairs):
            raise ValueError("no answer")
        for u, _ in pairs:
            open(f"{log}/{u}-{random.random()}", "w").close()
        return [str(len(t or "")) for _, t in pairs]

    return ask


def asked(log):
    return Counter(f.rsplit("-", 1)[0] for f in os.listdir(log))


def test_units_are_asked_once_over_broken_runs(spark, tmp_path):
    units, ledger, log = spark.createDataFrame(rows(60), UNIT), str(tmp_path / "ledger"), tmp_path / "log"
    log.mkdir()
    with pytest.raises(Exception):
        R.analyse_with_ledger(units, asker(log, breaks="u59"), ledger, 4, 10).collect()
    answered = {r.key for r in spark.read.parquet(ledger).collect()} if os.path.exists(ledger) else set()
    got = R.analyse_with_ledger(units, asker(log, bad={"u7", "u8"}), ledger, 4, 10).collect()
    assert Counter((r.project_id, r.unit, r.response, r.error is not None) for r in got) == Counter(
        (p, u, None if u in ("u7", "u8") else str(len(t or "")), u in ("u7", "u8")) for p, _, u, _, t in rows(60))
    assert len(answered) < 61 and sum(n > 1 for n in asked(log).values()) <= 30  # only units of the wave that broke were asked again
    before = asked(log)
    again = asker(log, bad={"u8"})
    got = R.analyse_with_ledger(units, again, ledger, 4, 10).collect()
    assert [r.unit for r in got if r.error] == ["u8"]
    assert asked(log) - before == Counter({"u7": 1})
    assert R.analyse_with_ledger(units.limit(0), again, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("width", [4, 65_536])
def test_as_of_join_with_a_hot_group(spark, width):
    r = random.Random(1)
    left = [(i, r.choice([0, 0, 0, 1, 2, None]), r.choice([None, *range(200)]), "x") for i in range(300)]
    right = [(r.choice([0, 0, 0, 1, 3, None]), r.choice([None, *range(200)]), k) for k in range(150)]
    got = O.as_of(spark.createDataFrame(left, "id long, g long, at long, name string"), spark.createDataFrame(right, "g long, at long, v long"), ["g"], "at", {"v": "last", "at": "since"}, "v", width)
    assert got.columns == ["id", "g", "at", "name", "last", "since"]
    for x in got.collect():
        hits = [(t, v) for g, t, v in right if None not in (x.g, x["at"], t) and g == x.g and t <= x["at"]]
        assert (x.since, x.last) == (max(hits) if hits else (None, None))
    assert got.count() == 300

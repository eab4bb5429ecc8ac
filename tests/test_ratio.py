"""The batch string ratio equals the library's on any strings."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import ratio as R
from plumbline.operators import similarity as Sim


def library(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def changed(rnd, s, signs):
    s = list(s)
    for _ in range(rnd.randint(0, 6)):
        k = rnd.randrange(len(s) + 1)
        kind = rnd.random()
        if kind < 0.4 and s:
            s[k % len(s)] = rnd.choice(signs)
        elif kind < 0.7:
            s.insert(k, rnd.choice(signs))
        elif s:
            del s[k % len(s)]
    return "".join(s)


@pytest.mark.parametrize("signs,least,most,n", [
    ("ab", 0, 12, 30_000), ("abcdefgh ", 3, 40, 20_000), ("abcdefghijklmnopqrstuvwxyzäöü\U0001f600 ", 8, 30, 50_000), ("abc d", 150, 420, 300)])
def test_ratios_equal_the_library(signs, least, most, n):
    rnd = random.Random(n)
    first = ["".join(rnd.choices(signs, k=rnd.randint(least, most))) for _ in range(n)]
    second = [changed(rnd, a, signs) if rnd.random() < 0.7 else rnd.choice(first) for a in first]
    assert R.ratios(first, second).tolist() == [library(a, b) for a, b in zip(first, second, strict=True)]


def test_ratios_with_little_room(monkeypatch):
    monkeypatch.setattr(R, "ROOM", 50)
    first, second = ["büro 1", "", "a", "", "x" * 250, "abcabc"], ["büro 21", "", "", "b", "y" + "x" * 199, "cabcab"]
    assert R.ratios(first, second).tolist() == [library(a, b) for a, b in zip(first, second, strict=True)]
    assert R.ratios([], []).tolist() == []


def test_common_characters_bound_the_ratio(spark):
    rnd = random.Random(3)
    rows = [("".join(rnd.choices("aabc[.*ä ", k=rnd.randint(0, 9))), "".join(rnd.choices("aabc[.*ä ", k=rnd.randint(0, 9)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", Sim.common_characters(F.col("a"), F.col("b")).alias("n")).collect():
        assert r.n == sum(min(r.a.count(c), r.b.count(c)) for c in set(r.a))
        assert 2 * r.n >= library(r.a, r.b) * (len(r.a) + len(r.b)) - 1e-9 or not r.a + r.b

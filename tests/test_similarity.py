"""Blocking loses nothing, and the parallel clustering equals the sequential one."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import similarity as Sim
from plumbline.operators.containment import contained
from plumbline.plans import merge as M
from plumbline.plans import review as R


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


@pytest.fixture(scope="module")
def names():
    rnd = random.Random(11)
    base = ["büro", "sitzungszimmer", "lager", "technik", "wc", "korridor nord", "labor a", "x", "ab", "aab"]
    out = set()
    while len(out) < 220:
        n = rnd.choice(base)
        if rnd.random() < 0.6:
            n += " " + str(rnd.randint(1, 40))
        if rnd.random() < 0.4:
            k = rnd.randrange(len(n))
            n = n[:k] + rnd.choice("abcxyz ") + n[k + 1:]
        out.add(n)
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.9])
def test_blocks_hold_every_pair_above_the_threshold(spark, names, threshold):
    df = spark.createDataFrame([(1, n) for n in names], "p long, name string")
    blocks = Sim.name_blocks(df, ["p"], "name", "name", threshold).collect()
    by_token = {}
    for r in blocks:
        by_token.setdefault(r.token, set()).add(r.name)
        assert r.size == len(r["name"])
    near = {(a, b) for group in by_token.values() for a in group for b in group}
    for a in names:
        for b in names:
            if a != b and ratio(a, b) > threshold:
                assert (a, b) in near
                assert min(len(a), len(b)) > Sim.name_size_ratio(threshold) * max(len(a), len(b)) - 1e-9
    assert len(near) < len(names) ** 2


def test_ratio_is_called_new_old(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("", ""), ("a", None)], "a string, b string")
    got = [r[0] for r in df.select(Sim.seq_ratio("a", "b")).collect()]
    assert got == [ratio("tide", "diet"), ratio("diet", "tide"), 1.0, None]
    above = [r[0] for r in df.select(Sim.ratio_above(F.col("a"), F.col("b"), 0.4)).collect()]
    assert above == [ratio("tide", "diet") > 0.4, ratio("diet", "tide") > 0.4, True, False]


def sequential(rows, match):
    out, leaders = {}, {}
    for r in sorted(rows, key=lambda r: r["pos"]):
        led = leaders.setdefault(r["project_id"], [])
        for old in led:
            if match(r, old):
                out[r["pos"]] = old["pos"]
                break
        else:
            led.append(r)
            out[r["pos"]] = r["pos"]
    return out


@pytest.fixture(scope="module")
def entities(spark, names):
    rnd = random.Random(5)
    pool = rnd.sample(names, 80) + [""]
    rows = [{
        "project_id": i % 2, "pos": i, "id": f"id{rnd.randint(0, 250)}", "guid": rnd.choice([None, "", f"g{rnd.randint(0, 60)}"]),
        "name": rnd.choice(pool), "number": rnd.choice([None, "", f"N{rnd.randint(0, 80)}"]), "kind": rnd.choice(["a", "B", ""]),
        "due": rnd.choice([None, "2020"]), "system_guid": rnd.choice([None, f"s{rnd.randint(0, 90)}"]),
    } for i in range(240)]
    ddl = ("project_id long, pos long, id string, guid string, name string, number string, kind string, due string, system_guid string")
    return rows, spark.createDataFrame([tuple(r.values()) for r in rows], ddl).repartition(4)


def low(x):
    return (x or "").lower()


def base_match(n, o):
    return n["id"] == o["id"] or bool(n["guid"] and n["guid"] == o["guid"])


def named(n, o, t):
    return bool(n["name"] and o["name"]) and ratio(low(n["name"]), low(o["name"])) > t


MATCHES = {
    "spaces": lambda n, o: base_match(n, o) or bool(n["number"] and low(n["number"]) == low(o["number"])) or named(n, o, 0.8),
    "systems": lambda n, o: base_match(n, o) or bool(n["system_guid"] and n["system_guid"] == o["system_guid"]) or named(n, o, 0.8),
    "equipment": lambda n, o: base_match(n, o) or bool(n["name"] and low(n["name"]) == low(o["name"])) or (
        bool(n["kind"]) and low(n["kind"]) == low(o["kind"]) and ratio(low(n["name"]), low(o["name"])) > 0.7),
    "milestones": lambda n, o: named(n, o, 0.9) and n["due"] == o["due"],
}


@pytest.mark.parametrize("kind", list(MATCHES))
def test_clusters_equal_the_sequential_pass(entities, kind):
    rows, df = entities
    if kind == "milestones":
        df = df.withColumnRenamed("name", "text")
    got = {r.pos: r.leader for r in M.CLUSTERS[kind](df).collect()}
    assert got == sequential(rows, MATCHES[kind])


def test_small_heads_take_more_rounds_with_the_same_result(spark, names):
    rows = [{"project_id": 1, "pos": i, "name": n} for i, n in enumerate(random.Random(2).sample(names, 120))]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "project_id long, pos long, name string")
    blocks = Sim.name_blocks(df, ["project_id"], "pos", "name", 0.8)
    led = Sim.greedy_leaders(df, blocks, ["project_id"], "pos", ["name"],
                             lambda n, o: Sim.ratio_above(n("name"), o("name"), 0.8), Sim.name_size_ratio(0.8), heads=2)
    want = sequential(rows, lambda n, o: ratio(n["name"], o["name"]) > 0.8)
    assert {r.pos: r.leader for r in led.collect()} == want


def test_earliest_similar(spark, names):
    rnd = random.Random(9)
    old = [(1, n, i) for i, n in enumerate(rnd.sample(names, 60))]
    new = [(1, n, i) for i, n in enumerate(rnd.sample(names, 60))]
    ddl = "p long, name string, pos long"
    got = {r["name"]: r.pos for r in Sim.earliest_similar(
        spark.createDataFrame(new, ddl), spark.createDataFrame(old, ddl), ["p"], "name", "pos", 0.8).collect()}
    want = {}
    for _, n, _ in new:
        hits = [pos for _, o, pos in old if ratio(n, o) > 0.8]
        if hits:
            want[n] = min(hits)
    assert got == want


def test_overlap_of_0_8_is_kept_and_0_9_is_dropped(spark):
    rows = [(1, 0, "a b c d e"), (1, 1, "a b c d x"), (1, 2, "k l m n o p q r s t"), (1, 3, "k l m n o p q r s u"),
            (1, 4, ""), (1, 5, " "), (1, 6, "A B C D E")]
    df = spark.createDataFrame(rows, "p long, pos long, quote string")
    got = [(r.pos, r.number) for r in R.distinct_findings(df, ["p"]).orderBy("pos").collect()]
    assert got == [(0, 1), (1, 2), (2, 3), (4, 4)]


def test_distinct_findings_equal_the_loop(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(150):
        words = rnd.sample(vocab, rnd.randint(1, 14))
        if rows and rnd.random() < 0.5:
            words = rnd.choice(rows)[2].split()
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        rows.append((1, i, " ".join(words)))
    kept = []
    for _, i, q in rows:
        w = set(q.split())
        if not any(q == k or len(w & set(k.split())) / max(len(w), len(set(k.split()))) > 0.8 for _, k in kept):
            kept.append((i, q))
    df = spark.createDataFrame(rows, "p long, pos long, quote string")
    assert sorted(r.pos for r in R.distinct_findings(df, ["p"]).collect()) == [i for i, _ in kept]


def test_contained_equals_brute_force(spark):
    rnd = random.Random(8)
    words = ["haftung", "haft", "die", "der", "norm", "a", "termin", "x y", "\t"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 8))) for _ in range(60)]
    needles = set()
    while len(needles) < 60:
        t = rnd.choice(texts)
        if not t:
            continue
        a = rnd.randrange(len(t))
        needles.add(t[a:a + rnd.randint(1, 25)])
    needles = sorted(needles) + ["fehlt hier ganz", " ", "af"]
    n = spark.createDataFrame([(i, s) for i, s in enumerate(needles)], "needle_id long, needle string")
    t = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "text_id long, text string")
    got = {(r.needle_id, r.text_id) for r in contained(n, t).collect()}
    assert got == {(i, j) for i, a in enumerate(needles) for j, b in enumerate(texts) if a in b}


def test_word_blocks_and_sketches_lose_no_pair(spark):
    """Rows with a partner above 0.8 are found inside the blocks; bags that only share rare words are ruled out there."""
    random.seed(5)
    bags = []
    for k in range(120):
        words = random.sample([f"w{i}" for i in range(400)], random.randint(1, 60))
        bags.append(words)
        if k % 3 == 0:  # a near copy on either side of the threshold
            gone = random.randint(0, max(1, len(words) // 4))
            bags.append(words[gone:] + [f"n{k}_{i}" for i in range(random.randint(0, gone))] or ["n"])
    bags += [["rare", *(f"{side}{i}" for i in range(40))] for side in "ab"]
    rows = spark.createDataFrame([(k // 60, k, b) for k, b in enumerate(bags)] + [(0, 1000, [])], "g long, pos long, w array<string>")
    order = Sim.word_order(rows, "w")
    blocks = Sim.word_blocks(rows, ["g"], "pos", "w", order)
    found = {r.pos for r in Sim.may_match(blocks, ["g"], "pos", Sim.words_near).collect()}

    def overlap(x, y):
        return len(set(x) & set(y)) / max(len(x), len(y))

    wanted = {k for k, x in enumerate(bags) for j, y in enumerate(bags) if k != j and k // 60 == j // 60 and overlap(x, y) > 0.8}
    assert wanted and wanted <= found
    # the last two share a rare word, so a block, and nothing else
    assert not {len(bags) - 1, len(bags) - 2} & found
    other = np.zeros(Sim.ORDER_BUCKETS, np.uint8)  # no order loses a pair
    assert wanted <= {r.pos for r in Sim.may_match(Sim.word_blocks(rows, ["g"], "pos", "w", other), ["g"], "pos", Sim.words_near).collect()}
    assert blocks.filter(F.col("pos") == 1000).isEmpty()


def test_wide_sketches_and_parts_lose_no_pair(spark, monkeypatch):
    """Large bags, whose short sketches are full, are told apart by the wide ones; blocks made in parts find what one part finds."""
    random.seed(6)
    bags = []
    for k in range(30):
        words = random.sample([f"w{i}" for i in range(9000)], random.choice([20, 33, 60, 260, 1500, 2100]))
        gone = random.randint(0, len(words) // 6)
        bags += [words, words[gone:] + [f"n{k}_{i}" for i in range(random.randint(0, gone))]]
    bags += [["rare", *(f"{side}{i}" for i in range(3000))] for side in "ab"]
    rows = spark.createDataFrame([(1, k, b) for k, b in enumerate(bags)], "g long, pos long, w array<string>")
    signed = Sim.word_signatures(rows, ["g"], "pos", "w", Sim.word_order(rows, "w")).persist()
    assert {1, 2, 64, 128} <= {len(r._wide) for r in signed.collect()}
    old = signed.select(*[F.col(c).alias(f"_o{c}") for c in signed.columns])
    both = signed.join(old, F.col("pos") < F.col("_opos"))
    wide = {(r.pos, r._opos) for r in both.filter(Sim.words_near_wide(F.col, lambda c: F.col(f"_o{c}"))).collect()}
    short = {(r.pos, r._opos) for r in both.filter(Sim.words_near(F.col, lambda c: F.col(f"_o{c}"))).collect()}
    wanted = {(k, j) for j, y in enumerate(bags) for k, x in enumerate(bags[:j]) if len(set(x) & set(y)) > 0.8 * max(len(x), len(y))}
    assert wanted and wanted <= wide
    assert (60, 61) in short and (60, 61) not in wide
    blocks = signed.select("g", "pos", "size", F.explode("_tokens").alias("token"), *Sim.SKETCH)
    one = {r.pos for r in Sim.may_match(blocks, ["g"], "pos", Sim.words_near).collect()}
    monkeypatch.setattr(Sim, "BLOCK_ROWS", signed.agg(F.sum(F.size("_tokens"))).first()[0] // 3)
    assert {r.pos for r in Sim.signatures_match(signed, ["g"], "pos").collect()} == one
    signed.unpersist()


def test_shuffles_of_a_step_go_with_it(spark):
    """A written step leaves no shuffle files, and the session's setting is as before."""
    from plumbline.session import SHUFFLE_CLEANUP, cut_lineage

    before = spark.conf.get(SHUFFLE_CLEANUP)
    asked = []
    table = cut_lineage(spark.range(50).mapInArrow(lambda batches: batches, "id long"))
    write = type(table.write).parquet

    def seen(self, path):
        asked.append(spark.conf.get(SHUFFLE_CLEANUP))
        return write(self, path)

    type(table.write).parquet = seen
    try:
        assert cut_lineage(table.groupBy("id").count()).count() == 50
    finally:
        type(table.write).parquet = write
    assert asked == ["true"] and spark.conf.get(SHUFFLE_CLEANUP) == before


def test_distinct_findings_equal_the_sequential_pass(spark):
    """Near copies, equal and empty quotes, and rows without a key, against a loop."""
    random.seed(9)
    quotes = []
    for k in range(60):
        words = random.sample([f"w{i}" for i in range(80)], random.randint(0, 25))
        quotes += [" ".join(words)] + [" ".join([*words[random.randint(0, 4):], f"n{k}"]) for _ in range(k % 4)] + [" ".join(words).upper()] * (k % 5 == 0)
    data = [(f"g{k % 2}", k, q) for k, q in enumerate(quotes)] + [("g0", 900, None), ("g1", 901, ""), ("g0", 902, " "), (None, 903, "a b"), ("g0", None, "a b")]
    out = R.distinct_findings(spark.createDataFrame(data, "g string, pos long, quote string"), ["g"])
    want = []
    for g in ("g0", "g1"):
        kept = []
        for _, pos, q in sorted((r for r in data if r[0] == g and r[1] is not None), key=lambda r: r[1]):
            q = (q or "").lower().strip()
            bag = set(q.split())
            if not any(q == p or (bag and other and len(bag & other) / max(len(bag), len(other)) > 0.8) for p, other in kept):
                kept.append((q, bag))
                want.append((g, pos, len(kept)))
    assert sorted((r.g, r.pos, r.number) for r in out.collect()) == sorted(want)


def test_a_family_is_not_compared_pair_by_pair(spark):
    """One block holds families that each have one leader: rows are compared with leaders, and with few others."""
    compared = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def same(x, y):
        compared.add(1)
        return x == y

    rows = [(1, i, (i + 1).bit_length()) for i in range(2000)]
    df = spark.createDataFrame(rows, "project_id long, pos long, family int")
    blocks = df.select("project_id", "pos", F.lit(1).alias("size"), F.lit("all").alias("token"))
    led = Sim.greedy_leaders(df, blocks, ["project_id"], "pos", ["family"], lambda n, o: same(n("family"), o("family")))
    assert {r.pos: r.leader for r in led.collect()} == {i: (1 << f - 1) - 1 for _, i, f in rows}
    assert compared.value < 20 * len(rows)

"""The corpus operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import common, lines, mixing, pages, pieces, quality, sharding, simhash, tokens, toxicity, vectors

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, slot long, ids int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon".split()


def prose(seed, n=60):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns named like results."""
    shared = "A shared line of text\n  a SHARED line of text \nshort"
    rows = [(1, prose(1), "en", "a"), (2, prose(1), "en", "a"), (2, prose(1), "en", "a"), (3, None, None, None), (None, "", "de", None),
            (None, prose(5), None, "b"), (4, "", "en", "b"), (5, shared + "\n" + prose(2), "en", "a"), (6, shared, "fr", "b"), (7, "\n\n", "fr", "b"),
            (8, prose(3, 9000), "en", "a"), (9, "ÄÖ ß 日本 \U0001f600 ▁ x y  z\t", "de", "a"), (10, prose(1) + " extra", "en", "a")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", 1, 2) for r in rows], DOCS).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_statistics_and_verdicts(spark, odd, none):
    def brute(text):
        w = words(text)
        grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        in_twice = {i + k for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for k in range(8)}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            dup += bool(words(line)) and line in seen
            seen.add(line)
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(in_twice)

    docs = odd.unionByName(odd.select("*").where("doc_id = 5").withColumn("text", F.lit("a b# c d e f g h i a b# c d e f g h\nq\nq\n" * 2))).persist()
    got = quality.quality_verdicts(docs).collect()
    want = Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, *[r[s] for s in quality.STATS]) for r in got) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    assert all(r.kept is (not r.base_failed) for r in got)  # too few rows for an estimate
    assert quality.quality_verdicts(none).count() == 0


def test_outliers_are_rejected_by_the_estimate(spark):
    rows = [(i, prose(i, 80), "en", "a") for i in range(300)] + [(900 + i, " ".join(w.upper() + "!!" for w in prose(i, 80).split()), "en", "a") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality.quality_verdicts(docs).collect()}
    assert all(got[i] for i in range(300)) and not any(got[900 + i] for i in range(30))
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == list(range(300))
    assert abs(quality.chi2_quantile(0.95, 5) - 11.0705) < 1e-3


def test_vectors_against_all_pairs(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 8))
    x = np.repeat(base, 6, axis=0) + r.normal(size=(240, 8)) * 0.12
    rows = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(x)]
    rows += [(1000, rows[7][1], 0), (1001, None, 0), (1002, [0.0] * 8, 0), (1003, [float("nan")] * 8, 0), (1004, [1.0, None] + [0.0] * 6, 0), (1005, [1.0, 2.0], 0),
             (1006, [2.0, 4.0], 0), (None, rows[7][1], 0), (1007, [], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit(1))
    got = vectors.near_duplicate_vectors(table, cells=9).collect()
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    links = defaultdict(set)
    for a, (i, u) in enumerate(good):
        for b, (j, v) in enumerate(good):
            if a != b and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.95:
                links[a].add(b)
    root = common.roots(*np.array([(a, b) for a in links for b in links[a]]).T, len(good))
    first = defaultdict(lambda: None)
    for a, (i, _) in enumerate(good):
        if i is not None and (first[root[a]] is None or i < first[root[a]]):
            first[root[a]] = i
    want = Counter((i, len(links[a]), first[root[a]]) for a, (i, _) in enumerate(good))
    want.update((i, 0, i) for i in (1001, 1002, 1003, 1004, 1007))
    assert Counter((x.vec_id, x.n_links, x.component_id) for x in got) == want
    assert all(x.kept == (x.vec_id == x.component_id) for x in got)
    assert vectors.near_duplicate_vectors(table.limit(0)).count() == 0


def test_vectors_near_few_dimensions_lose_no_links(spark):
    r = np.random.default_rng(5)
    x = (r.normal(size=(1200, 4)) @ r.normal(size=(4, 256)) + 0.01 * r.normal(size=(1200, 256))).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {g.vec_id: (g.n_links, g.component_id) for g in vectors.near_duplicate_vectors(table, cells=128).collect()}
    root = common.roots(*np.nonzero(linked), len(x))
    assert got == {i: (int(linked[i].sum()), int(root[i])) for i in range(len(x))}


def test_vectors_are_placed_once_and_compared_chunk_by_chunk(spark, monkeypatch):
    """Spread vectors, whose cells rule out little, are not copied; chunks smaller than cells and lengths outside the sample lose no link."""
    r = np.random.default_rng(11)
    x = r.normal(size=(300, 64)).astype(np.float32)
    x = np.r_[x, x[:60] + 0.1 * r.normal(size=(60, 64)).astype(np.float32)]
    short = np.repeat(r.normal(size=(4, 3)), 3, axis=0).astype(np.float32) * (1 + np.arange(12))[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate([*x, *short])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    known = spark.createDataFrame([(i, v, 1) for i, v in rows[:360]], "vid long, vec array<float>, times long")
    fitted = vectors.fit_cells(known, 20)
    assert vectors.assign_cells(known, fitted).count() == 360
    fit = vectors.fit_cells
    monkeypatch.setattr(vectors, "fit_cells", lambda v, k: fit(v.where(F.size("vec") == 64), 4))
    monkeypatch.setattr(vectors, "CHUNK", 4 * 64 * 60)
    got = {g.vec_id: (g.n_links, g.component_id) for g in vectors.near_duplicate_vectors(table).collect()}
    want = {}
    for part, first in ((x, 0), (short, 360)):
        unit = part.astype(float) / np.linalg.norm(part.astype(float), axis=1, keepdims=True)
        linked = (unit @ unit.T >= 0.95) & ~np.eye(len(part), dtype=bool)
        root = common.roots(*np.nonzero(linked), len(part))
        want |= {first + i: (int(linked[i].sum()), first + int(root[i])) for i in range(len(part))}
    assert got == want and sum(n > 0 for n, _ in got.values()) > 100


def test_pieces_round_trip_and_distribution(spark, odd, none):
    docs = odd.withColumn("before", F.col("text"))
    coded = pieces.sample_pieces(docs)
    back = pieces.decode_pieces(coded).collect()
    assert len(back) == 13 and all(r.before == r.text for r in back)
    again = pieces.sample_pieces(docs.repartition(5))
    same = lambda d: Counter((r.doc_id, tuple(r.ids or ())) for r in d.collect())
    assert same(coded) == same(again) and pieces.sample_pieces(none).count() == 0
    other = pieces.sample_pieces(docs, seed="other")
    assert same(coded) != same(other)
    lattice = pieces.Lattice(pieces.default_model(), 1.0)
    vocab = {p.decode(): i for i, p in enumerate(lattice.bytes_of) if p and not lattice.byte_id.tolist().count(i)}

    def cuts(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in vocab:
                yield from ((vocab[s[:k]], *rest) for rest in cuts(s[k:]))

    weight = {c: np.exp(sum(lattice.weight[i] for i in c)) for c in cuts(" then")}
    n = 20_000
    ids, counts = lattice.encode(["then"] * n, np.random.default_rng(0).integers(0, 2**63, n).astype(np.uint64))
    ends = np.cumsum(counts)
    got = Counter(tuple(ids[e - c:e].tolist()) for e, c in zip(ends, counts, strict=True))
    assert all(abs(got[c] / n - w / sum(weight.values())) < 0.02 for c, w in weight.items())


def fingerprint(text):
    w = [x.encode() for x in words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    rows = odd.collect()
    fps = np.array([fingerprint(r.text) for r in rows], np.uint64)
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    root = common.roots(*np.nonzero(close), len(rows))
    least = {k: min((r.doc_id for r, x in zip(rows, root, strict=True) if x == k and r.doc_id is not None), default=None) for k in root}
    assert Counter((r.doc_id, np.int64(r.fp).view(np.uint64).item(), r.component_id) for r in got) == Counter(
        (r.doc_id, int(f), least[k]) for r, f, k in zip(rows, fps, root, strict=True))
    kept = simhash.one_of_each_group(odd).collect()
    assert len(kept) == len({k for k in root}) and set(kept[0].asDict()) == set(odd.columns)
    assert simhash.near_duplicates(none).count() == 0


def test_gray_index_against_all_pairs():
    r = np.random.default_rng(2)
    fps = {int(x) for x in r.integers(0, 2**63, 200)}
    for x in list(fps)[:40]:
        for _ in range(25):
            y = x
            for k in r.integers(0, 64, r.integers(0, 6)):
                y ^= 1 << int(k)
            fps.add(y)
    fps = np.array(sorted(fps), np.uint64)
    index = simhash.GrayIndex(np.zeros(len(fps), np.int64), fps)
    close = np.bitwise_count(index.fps[:, None] ^ index.fps[None, :]) <= 2
    assert (common.roots(*np.nonzero(close), len(fps)) == index.components(2, room=5000)).all()
    masks = [np.uint64(m) for m in simhash.block_masks(2)]
    assert all(any(d & m == 0 for m in masks) for d in (index.fps[:, None] ^ index.fps[None, :])[close])


def test_near_copies_of_the_pipeline_against_all_pairs(spark):
    import corpus_pipeline

    r = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    for _ in range(40):
        base = list(r.choice(vocabulary, 150))
        for edits in (0, 0, 1, 2, 3, 4, 5, 8):  # similarity from 1 down to about 0.6
            text = list(base)
            for k in r.choice(150, edits, replace=False):
                text[k] = "new" + str(r.integers(10**6))
            rows.append((i := i + 1, " ".join(text), "en", "a"))
    rows += [(900, "", "en", "a"), (901, None, "en", "a"), (902, "a b", "en", "a"), (903, "A  b", "en", "a"), (None, rows[0][1], "en", "a")]
    order = r.permutation(len(rows))
    docs = spark.createDataFrame([rows[k] for k in order], "doc_id long, text string, lang string, source string")

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}

    sets = [shingles(t) for _, t, *_ in rows]
    alike = np.array([[len(x & y) >= 0.8 * len(x | y) for y in sets] for x in sets])
    assert 40 * 7 < alike.sum() < 40 * 64
    root = common.roots(*np.nonzero(alike), len(rows))
    got = sorted(x.doc_id for x in corpus_pipeline.simhash_dedup(spark, docs, SF).collect())
    assert got == sorted(min(rows[k][0] for k in np.flatnonzero(root == g) if rows[k][0] is not None) for g in set(root))


def test_near_copies_with_repeated_or_missing_ids(spark):
    import corpus_pipeline

    near = lambda seed: [prose(seed, 90), prose(seed, 90) + " extra"]
    rows = [(1, near(1)[0]), (2, near(1)[1]), (1, near(2)[0]), (3, near(2)[1]), *((None, t) for t in near(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(x) for x in corpus_pipeline.simhash_dedup(spark, docs, SF).collect())
    assert got[1, near(1)[0]] == got[1, near(2)[0]] == 1 and sum(got.values()) == 3 and sum(n for (i, _), n in got.items() if i is None) == 1


def test_shards(spark, odd, none):
    got = sharding.longest_first_shards(odd, shards=3).collect()
    text = lambda r: (r.text or "").encode()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r.doc_id, len(text(r)) + 8, zlib.crc32(text(r))) for r in odd.collect())
    by_text = defaultdict(set)
    for r in got:
        by_text[r.text_crc32, r["size"]].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    for k in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert sharding.longest_first_shards(none).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    loads = Counter()
    for r in sharding.longest_first_shards(docs, shards=4).collect():
        loads[r.shard] += r["size"]
    assert max(loads.values()) < 1.02 * min(loads.values())
    # many small groups by classes: near the plain heap's result
    level = [0.0] * 5
    sharding.schedule(level, [(1, 900.0), (1000, 7.0), (999, 3.0), (3, 1.0)])
    assert max(level) - min(level) <= 7


def test_toxicity_is_learned_from_the_training_fold(spark, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(g.predicted == t for g, t in held) >= 0.9 * len(held)
    # labels of the held-out fold change nothing
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    assert {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, flipped).collect()} == {i: r.score for i, r in got.items()}
    assert toxicity.toxicity_scores(none, labels.limit(0)).count() == 0


def test_proven_units_outlast_hot_texts_and_a_dominant_language(spark):
    r = np.random.default_rng(6)
    mark = {"en": [f"vile{c}" for c in "abcdef"], "fr": ["affreuse", "horrible", "vilaine"]}
    rows = []
    for lang, n in (("en", 4000), ("fr", 400)):
        for k in range(n):
            toxic = k % 10 == 0
            rows.append((len(rows), " ".join([*(lang + w for w in r.choice(WORDS, 20)), *(r.choice(mark[lang], 2, replace=False) if toxic else [])]), int(toxic)))
    hot = "hot copies of one toxic text " + " ".join(f"rare{c}" for c in "abcdefgh")
    rows += [(len(rows) + k, hot, 1) for k in range(1500)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    mined, share = toxicity.mine_units(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    units = {u for u, *_ in mined}
    assert {*mark["en"], *mark["fr"]} <= units and not any(u.startswith("rare") for u in units)
    assert abs(share - (440 + 1500) / 5900) < 1e-9


def test_label_model_finds_accuracies():
    r = np.random.default_rng(0)
    y = r.random(50_000) < 0.2
    rates = [(0.6, 0.02), (0.5, 0.05), (0.7, 0.1), (0.3, 0.01)]
    v = np.array([np.where(y, r.random(len(y)) < a, r.random(len(y)) < b) for a, b in rates]).astype(float)
    model = toxicity.LabelModel.fit(v @ v.T, len(y), 0.2)
    assert np.abs(model.fires_toxic - [a for a, _ in rates]).max() < 0.06 and np.abs(model.fires_clean - [b for _, b in rates]).max() < 0.03
    twin = toxicity.LabelModel.fit((w := np.vstack([v, v[:1]])) @ w.T, len(y), 0.2)
    assert twin.damping[0] < 0.8 and twin.damping[4] < 0.8 and twin.damping[2] > 0.9


def test_token_files(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    path = str(tmp_path / "tokens")
    tokens.write_tokens(odd, path, parts=3)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.token_index(spark, path).collect())
    coder = Tokenizer.from_file(tokens.default_tokenizer())
    ids = [(r.doc_id, [*coder.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in odd.collect()]
    assert Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids) == Counter(r[1:] for r in got)
    assert [r[0] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1]]
    order = [-1 if r[1] is None else r[1] for r in got]
    assert order == sorted(order)
    assert {r.doc_id for r in tokens.read_tokens(spark, path, [5, 9]).collect()} == {5, 9}
    tokens.write_tokens(none, str(tmp_path / "empty"))
    assert tokens.token_index(spark, str(tmp_path / "empty")).count() == 0
    chars = "aAzZéÉßÿ0 9½'''\n\t\xa0\x85.,!<|srtevmld\x1c日"
    r = np.random.default_rng(4)
    texts = ["".join(r.choice(list(chars), n)) for n in r.integers(0, 30, 500)]
    flat, counts = tokens.WordCoder(tokens.default_tokenizer()).encode(texts, 1)
    ends = np.cumsum(counts)
    assert all(flat[e - c:e - 1].tolist() == coder.encode(t, add_special_tokens=False).ids for t, e, c in zip(texts, ends, counts, strict=True))


def test_line_dedup_against_a_loop(spark, odd, none):
    rows = odd.collect()
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    place = lambda i: (i is None, i or 0)
    holders = defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(r.doc_id)
    want = Counter()
    for r in rows:
        all_lines = (r.text or "").split("\n")
        kept = [x for x in all_lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or r.doc_id == min(holders[key(x)], key=place)]
        want[r.doc_id, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)] += 1
    assert Counter(tuple(r) for r in lines.line_dedup(odd, slices=3).collect()) == want
    out = lines.without_repeated_lines(odd)
    assert out.columns == odd.columns and out.where("text is null").count() == 1 and lines.line_dedup(none).count() == 0


def test_mixing_rates_and_counts(spark, odd, none):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 18_000, "big").otherwise("small").alias("source"), F.lit("t").alias("text"))
    got = mixing.mix_sources(docs, {"big": 1.0, "small": 1.0})
    counts = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert all(abs(n - 10_000) < 500 for n in counts.values())
    per = Counter(r["count"] for r in got.where("source = 'small'").groupBy("doc_id").count().collect())
    assert abs(per[5] / 2000 - 0.1755) < 0.03  # Poisson with mean 5
    far = mixing.mix_sources(docs.where("doc_id < 50"), growth=40.0).count()
    assert abs(far - 2000) < 250
    same = lambda d: Counter((r.doc_id, r._copy) for r in mixing.mix_sources(d).collect())
    assert same(odd) == same(odd.repartition(4)) and mixing.mix_sources(none).count() == 0
    assert mixing.mix_sources(docs, {"small": 1.0}).where("source = 'big'").count() == 0


def test_main_text(spark):
    marked = ("<html><head><title>t</title></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one <b>t</b>wo<br>three &nbsp;x<p>four"
              "<div class='comments'><p>nice</p></div><script>if (a<b) '</p>'</script></article><aside>side</aside><footer>f</footer></body></html>")
    assert pages.main_text(marked) == "A & B one two three x four"
    named = "<div id=top-menu>m</div><div class='post-content'>T<ul><li>a<li>b</ul></div><div class=sidebar>s</div><form>q</form>"
    assert pages.main_text(named) == "T a b" and pages.main_text("") == "" and pages.main_text("a < b <i>c</i> <!-- x") == "a < b c"
    # a site without marks: what all its pages print goes
    rows = [(i, f"http://h.example/{i}", f"<body><div><p>home | news | log</p></div><div><p>{prose(i, 12)}</p></div><div><p>all rights</p></div></body>") for i in range(12)]
    rows += [(50, None, None), (51, None, ""), (52, "http://h.example/1", rows[1][2]), (None, "x", marked), (50, None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = Counter((r.page_id, r.url, r.text) for r in pages.extract_main_text(table).collect())
    want = Counter((i, u, prose(i if i != 52 else 1, 12)) for i, u, h in rows if u and "h.example" in u)
    want.update([(50, None, ""), (51, None, ""), (None, "x", "A & B one two three x four"), (50, None, "")])
    assert got == want and pages.extract_main_text(table.limit(0)).count() == 0


@pytest.mark.parametrize("wrapper", ["div class='content has-sidebar'", "div class='layout no-sidebar'", "body class='single comments-open'", "div class=form-page",
                                     "div class=share-wrap", "div id=related-layout", "div class=ad-free", "div style='overflow:hidden'", "div data-state='hidden'",
                                     "div data-id='nav'", "section class='widget search'", "div title=\"a 'hidden' b\""])
def test_names_of_wrappers_cut_nothing(wrapper):
    tag = wrapper.split()[0]
    text = prose(4, 50)
    page = f"<nav>menu</nav><{wrapper}><article class='post has-comments'><h1>T</h1><p>{text}</p><div class=comments>nice</div></article><div class=sidebar>s</div></{tag}><footer>f</footer>"
    assert pages.main_text(page) == f"T {text}"
    several = f"<{wrapper}><article><p>{text}</p></article><article><p>two {text}</p></article></{tag}>"
    assert pages.main_text(several) == f"{text} two {text}"
    assert pages.main_text(f"<{wrapper}><p>{text}</p></{tag}><div class=sidebar>s</div>") == text
    assert pages.main_text(f"<article><p>{text}</p><div hidden>x</div><div HIDDEN=''>y</div><p aria-hidden=true>z</p></article>") == text


def test_long_comments_go():
    talk = "<ol class=comment-list><li><article class='comment byuser'><p>" + prose(9, 90) + "</p></article></ol>"
    assert pages.main_text(f"<main><article><p>a b c</p><div class=comments>{talk}</div></article></main>") == "a b c"
    assert pages.main_text(f"<article><p>a b c</p></article><div id=comments>{talk}</div>") == "a b c"


def test_connected_components(spark):
    r = np.random.default_rng(1)
    e = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {x.node: x.root for x in common.connected_components(spark.createDataFrame(e, "u long, v long")).collect()}
    nodes = np.unique([x for x in e if x[0] != x[1]])
    at = {n: k for k, n in enumerate(nodes.tolist())}
    pairs = np.array([(at[a], at[b]) for a, b in e if a != b])
    root = common.roots(pairs[:, 0], pairs[:, 1], len(nodes))
    assert got == {n: int(nodes[k]) for n, k in zip(nodes.tolist(), root, strict=True)}


def test_pipeline_stages(spark, odd):
    import corpus_pipeline

    docs, kept = odd, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).persist()
        if name != "sampled pieces":
            assert out.columns == odd.columns
        if name == "quality rules":
            kept = sorted(r.doc_id or -1 for r in out.collect())
            assert kept == [-1, 1, 2, 2, 5, 8, 10]
        if name == "simhash near-dedup":
            assert len({r.text for r in out.collect()}) == out.count()
        docs = out
    assert corpus_pipeline.run(spark, SF).count() > 0
    empty = spark.createDataFrame([], odd.schema)
    assert all(stage(spark, empty, SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_queries_and_entry(spark):
    import __spark_entry__ as entry

    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", q)[0] for q in entry.queries() if q.startswith("op")}

"""Source divergence, two-tier BPE and filter interactions against brute force, on small tables with odd rows."""

import base64
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, common, divergence, filters, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids int, raw int, part string, mask int, term string, k long"
LABELS = "doc_id long, quality int, toxic int, part string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns named like results."""
    r = random.Random(5)
    words = "Haus haus Straße été naïve WATER water a b c d e f # % * 日本 x1y2 can't".split()
    long = " ".join(r.choices(words, k=20_000))
    texts = [None, "", "  \n", long, "Haus haus HAUS", "haus Straße", "haus Straße", "ABC DEF", "a#b", " ".join(words * 3), " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)),
             "one two three", "One two three", "STRASSE \x1c\x85   x", "'s 're 'LL  \t\n y", "ÄÖ ä ö \x7f\x80"]
    rows = [(i, t, l, s) for i, t in enumerate(texts) for l, s in (("de", "a"), ("de", "b" if i % 3 else None), (None, "a"))]
    rows = [(k if k % 11 else None, t, l, s) for k, (_, t, l, s) in enumerate(rows)] + [(5, texts[4], "de", "a"), (5, texts[4], "de", "a"), (900, "", "xx", "only"), (901, "", "xx", "")]
    return spark.createDataFrame([(*x, 1, 2, 3, "p", 4, "t", 5) for x in rows], DOCS).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- source divergence ----------------------------------------------------------------------------


def brute_divergence(rows, least_docs=3, most_terms=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(l or "", s or "", term.findall((t or "").translate(fold))) for _, t, l, s in rows]
    out = []
    for lang in {l for l, _, _ in docs}:
        mine = [(s, w) for l, s, w in docs if l == lang]
        held = Counter(x for _, w in mine for x in set(w))
        kept = {x for x, n in held.items() if n >= least_docs}
        counts = {s: Counter() for s, _ in mine}
        for s, w in mine:
            counts[s].update(x for x in w if x in kept)

        def p(c, v=len(kept), kept=kept):
            n = sum(c.values())
            return {x: 1 + 10**9 * (c[x] + 1) // (n + v) for x in kept}

        price = {s: p(c) for s, c in counts.items()}
        q = p(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(o, sum((price[s][x] - price[o][x]) ** 2 // price[o][x] for x in kept)) for o in counts if o != s]
            terms = [(x, (price[s][x] - q[x]) ** 2 // q[x]) for x in kept if counts[s][x] and price[s][x] > q[x]]
            for part, found, most in (("pair", pairs, None), ("term", terms, most_terms)):
                found.sort(key=lambda f: (-f[1], f[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return Counter(out)


def test_source_divergence(spark, odd, none, monkeypatch):
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang", "source").collect()]
    want = brute_divergence(rows)
    assert Counter(map(tuple, divergence.audit_sources(odd).collect())) == want
    assert ("xx", "only", "pair", "", 0, 1) in want  # no kept terms
    assert divergence.audit_sources(none).count() == 0
    # several buckets of terms and chunks of sources
    r = random.Random(1)
    many = [(i, " ".join(r.choice("abcdefgh") * r.randint(1, 6) for _ in range(30)), "en", f"s{r.randint(0, 8)}") for i in range(120)]
    monkeypatch.setattr(divergence, "BUCKET", 7)
    monkeypatch.setattr(divergence, "CHUNK", 2)
    docs = spark.createDataFrame(many, "doc_id long, text string, lang string, source string")
    assert Counter(map(tuple, divergence.audit_sources(docs, most_terms=5).collect())) == brute_divergence(many, most_terms=5)


def test_segment_trees_share_nodes_and_price_all_pairs(monkeypatch):
    monkeypatch.setattr(divergence, "ROOM", 50)
    r = np.random.default_rng(3)
    counts = r.poisson(0.3, (6, 333))
    counts[:, 0] = r.integers(0, 10**12, 6)
    counts[5] = counts[4]
    trees = divergence.SegmentTrees(counts)
    assert trees.roots[4] == trees.roots[5]
    assert len(trees.children[0][0]) < 6 * 333 / 8  # few distinct pairs of leaves
    totals = counts.sum(axis=1) + 333
    a, b = np.triu_indices(6, 1)
    ab, ba = divergence.pair_sums(trees, totals, a, b)

    def p(g):
        return [1 + 10**9 * (int(c) + 1) // int(totals[g]) for c in counts[g]]

    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        px, py = p(x), p(y)
        assert ab[k] == sum((u - v) ** 2 // v for u, v in zip(px, py, strict=True))
        assert ba[k] == sum((u - v) ** 2 // u for u, v in zip(px, py, strict=True))


def test_shares_beyond_double_precision():
    counts = np.array([0, 1, 2**52 + 1, 10**15 - 1], np.int64)
    total = 10**15 + 7
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


# --- two-tier BPE ---------------------------------------------------------------------------------


def library():
    import public_tokenizers as P
    tiktoken = pytest.importorskip("tiktoken")
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, odd, none):
    coder = library()
    out = bpe.decode_bytes(bpe.encode_bytes(odd, keep=("doc_id", "text", "part"))).collect()
    assert Counter((r.doc_id, r.text, tuple(r.ids)) for r in out) == Counter((r.doc_id, r.text, tuple(coder.encode_ordinary(r.text or ""))) for r in odd.collect())
    assert all(bytes(r.raw) == (r.text or "").encode() for r in out)
    assert bpe.decode_bytes(bpe.encode_bytes(none)).count() == 0
    gone = bpe.decode_bytes(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first()
    assert gone.raw is None


def test_bpe_on_random_and_long_pieces(monkeypatch):
    coder, own = library(), bpe.read_coder(bpe.default_ranks(), bpe.default_pattern())
    r = random.Random(2)
    signs = "aabbcde \n'sté日本\U0001f600\x1c\x85    123!"
    texts = ["".join(r.choices(signs, k=r.randint(0, 300))) for _ in range(500)] + ["", "x" * 50_000, "abcdefghij" * 2000, " " * 999, "the" * 3000]
    for limit in (bpe.LONG, 10):  # 10: all texts are cut portion by portion
        monkeypatch.setattr(bpe, "LONG", limit)
        monkeypatch.setattr(bpe, "PORTION", 7)
        ids, sizes = own.encode(texts)
        at = 0
        for text, n in zip(texts, sizes.tolist(), strict=True):
            got = ids[at:at + n].tolist()
            assert got == coder.encode_ordinary(text)
            at += n
        raw, offsets = own.decode(ids, np.r_[0, np.cumsum(sizes)])
        assert [raw[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == texts
    assert own.encode([])[0].tolist() == []


def test_merging_side_by_side_equals_one_by_one():
    coder = bpe.read_coder(bpe.default_ranks(), bpe.default_pattern())
    coder._ready()
    r = random.Random(7)
    raws = ["".join(r.choices("etaoin shrdluäé", k=r.randint(1, 64))).encode()[:64] for _ in range(3000)]
    for widest in (64, 8, 2):
        some = [x for x in raws if len(x) <= widest] + [b"ab", b"a"]
        codes = np.frombuffer(b"".join(some), np.uint8)
        size = np.array([len(x) for x in some])
        ids, counts = bpe.merge_side_by_side(codes, np.cumsum(size) - size, size, coder.single, coder.table)
        want = [bpe.merge_bytes(x, coder.ranks, *coder.joins) for x in some]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_a_vocabulary_without_a_byte_is_refused():
    coder = bpe.TwoTierCoder([b"a", b"b", b"ab"], [0, 1, 2], r"\w+")
    assert coder.encode(["ab abab"])[0].tolist() == [2, 2, 2]
    with pytest.raises(ValueError):
        coder.encode(["abc"])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 5000])
def test_perfect_hash_is_minimal(n):
    keys = [f"key {i}".encode() for i in range(n)]
    table = bpe.PerfectHash(keys)
    assert table.lookup(keys).tolist() == list(range(n))
    others = table.lookup([b"", b"other", b"key -1"])
    assert ((others >= 0) & (others < max(n, 1))).all()


# --- filter interactions --------------------------------------------------------------------------


def brute_masks(rows):
    for doc, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = doc is not None and any(o is not None and o < doc and (u or "") == t for o, u, _ in rows)
        yield doc, source or "", [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), bool(set(t) & set("#$%&*|")), copy]


def brute_interactions(rows, good, toxic):
    masks = list(brute_masks(rows))
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in masks}:
        mine = [(d, f) for d, p, f in masks if p == part]
        for order in itertools.permutations(range(5)):
            left = mine
            for k, f in enumerate(order):
                removed, stay = [x for x in left if x[1][f]], [x for x in left if not x[1][f]]
                shapley[part, f] += len(removed)
                out[part, "".join("ABCDE"[i] for i in order), k + 1] = (
                    len(stay), len(removed), sum(x[1][f] for x in mine) - len(removed), sum(x[1][f] and sum(x[1]) == 1 for x in mine),
                    sum(x[0] in good for x in removed), sum(x[0] in toxic for x in removed))
                left = stay
    return {(*k, *v, shapley[k[0], "ABCDE".index(k[1][k[2] - 1])]) for k, v in out.items()}


def test_filter_interactions(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 1 if i % 3 == 0 else None, "x") for i in range(1, 60)] + [(5, 1, 1, "y"), (5, 0, None, "y"), (None, 1, 1, "z")], LABELS)
    rows = [tuple(r) for r in odd.select("doc_id", "text", "source").collect()]
    good = {r.doc_id for r in labels.where("quality = 1 and doc_id is not null").collect()}
    toxic = {r.doc_id for r in labels.where("toxic = 1 and doc_id is not null").collect()}
    got = filters.audit_filters(odd, labels).collect()
    assert len(got) == 600 * len({s or "" for _, _, s in rows})
    assert {tuple(r) for r in got} == brute_interactions(rows, good, toxic)
    assert filters.audit_filters(none, labels).count() == 0
    assert {r.good_lost for r in filters.audit_filters(odd, labels.limit(0)).collect()} == {0}


def test_copies_of_a_hot_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"), F.lit("s").alias("source"))
    masks = filters.failure_masks(docs)
    assert masks.where(F.col("mask").bitwiseAND(16) > 0).count() == 999


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_adjacent_swaps_visit_every_order(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for at in filters.adjacent_swaps(n):
        order[at], order[at + 1] = order[at + 1], order[at]
        seen.add(tuple(order))
    assert len(seen) == len(filters.adjacent_swaps(n)) + 1 == len(list(itertools.permutations(range(n))))


def test_diagram_is_shared_and_swaps_keep_its_weights():
    r = random.Random(4)
    weights = {m: (r.randint(0, 2),) for m in range(32)}
    diagram = filters.Diagram(weights, 5, 1)
    assert len(diagram.levels[4]) <= 9  # pairs of three weights
    for at in filters.adjacent_swaps(5):
        diagram.swap(at)
        gone = 0
        for f, kept, removed in diagram.steps():
            assert removed[0] == sum(w for m, (w,) in weights.items() if m >> f & 1 and not m & gone)
            gone |= 1 << f
            assert kept[0] == sum(w for m, (w,) in weights.items() if not m & gone)


# --- near copies ----------------------------------------------------------------------------------


def test_sketches_never_rule_out_a_similar_pair():
    r = np.random.default_rng(1)
    ruled_out, sets = 0, []
    for _ in range(400):
        n = int(r.integers(1, 400))
        shared = r.integers(0, 2**63, n).astype(np.uint64)
        a, b = (np.unique(np.r_[shared, r.integers(0, 2**63, r.integers(0, n // 2 + 1)).astype(np.uint64)]) for _ in range(2))
        both = len(np.intersect1d(a, b))
        differ = simhash.least_difference(simhash.sketch(a), simhash.sketch(b))
        assert differ <= len(a) + len(b) - 2 * both
        ruled_out += differ > (len(a) + len(b)) / 9
        assert not (differ > (len(a) + len(b)) / 9 + 1e-9 and both >= 0.8 * (len(a) + len(b) - both))
        sets += [a, b]
    assert ruled_out > 100
    kept = [simhash.brief(simhash.sketch(x)) for x in sets]
    kept[3] = None
    a, b = r.integers(0, len(sets), (2, 3000))
    got = simhash.Sketches(np.array(kept, object)).differ(a, b, room=500)
    assert got.tolist() == [simhash.least_difference(kept[x], kept[y]) for x, y in zip(a, b, strict=True)]


def test_meeting_rows_over_any_batches():
    r = np.random.default_rng(6)
    for _ in range(200):
        n = int(r.integers(1, 30))
        token = np.sort(r.integers(0, 6, n))
        subs = np.where(token == 3, 2, 1)
        key = r.integers(0, 5, n)
        sub = key % subs
        order = np.lexsort((key, sub, token))
        rows = [x[order] for x in (token, sub, subs, key)]
        buckets = {}
        for t, s, many, k in zip(*(x.tolist() for x in rows), strict=True):
            buckets.setdefault((t, s, many), set()).add(k)
        want = sorted((t, s, many, k, min(keys)) for (t, s, many), keys in buckets.items() if len(keys) > 1 or many > 1 for k in keys)
        meeting, got = simhash._Meeting(), []
        cuts = np.unique(np.r_[0, r.integers(0, n + 1, 4), n])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            got += zip(*(x.tolist() for x in meeting.add(*(x[a:b] for x in rows))), strict=True)
        assert sorted(got) == want


@pytest.mark.parametrize("room", [200_000, 40])
def test_similar_groups_against_all_pairs(spark, monkeypatch, room):
    """One hot family of near copies and texts with a common passage; with little room, common shingles are split."""
    r = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(2000)]
    base, passage = list(r.choice(vocabulary, 60)), list(r.choice(vocabulary, 60))
    rows = []
    for i in range(150):
        text = list(base)
        for k in r.choice(60, int(r.integers(0, 4)), replace=False):
            text[k] = f"new{r.integers(10**6)}"
        rows.append((i, " ".join(text)))
    rows += [(200 + i, " ".join([*passage, *r.choice(vocabulary, int(r.integers(3, 40)))])) for i in range(100)]
    rows += [(400 + i, " ".join(r.choice(vocabulary, 30))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    alike = np.array([[len(x & y) >= 0.8 * len(x | y) for y in sets] for x in sets])
    root = common.roots(*np.nonzero(alike), len(rows))
    got = {x.doc_id: x.root for x in simhash.similar_groups(docs, room=room).collect()}
    pairs = {(rows[k][0], rows[g][0]) for k, g in enumerate(root)}
    assert len(set(got.values())) == len(set(root)) and all(got[a] == got[b] for a, b in pairs)

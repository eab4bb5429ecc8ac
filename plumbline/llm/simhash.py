"""SimHash near-dedup: fingerprints of word shingles, linked through a Gray-ordered hierarchical index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import connected_components, roots, same, small_batches, unused
from plumbline.session import cut_lineage, free

FANOUT = 8
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(raw: bytes, width: int = 3, seed: int = 42) -> int:
    """Majority of the bits of the XXH64 of all shingles of `width` words, repeats included; 0 without words."""
    hashes = shingle_hashes(raw, width, seed)
    return majority(hashes) if len(hashes) else 0


def shingle_hashes(raw: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of `width` words in order, repeats included; a shorter text is one shingle."""
    words = raw.lower().split()
    if len(words) <= width:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in shingles), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, text_key, fp (the 64 bits as a long) of every row's whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x or b"", width) for x in batch.column("raw").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
                       F.encode(F.col("text").cast("string"), "UTF-8").alias("raw"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the reflected Gray sequence, where neighbours differ by one bit."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _parents(ones: np.ndarray, alls: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """OR and AND of the members of each node; start: the first child of each node."""
    return np.bitwise_or.reduceat(ones, start), np.bitwise_and.reduceat(alls, start)


class GrayIndex:
    """Nodes over runs of fingerprints in Gray order, one tree for each bucket.

    A node holds the bits that all fingerprints below it share, as a mask and a pattern. What a node shares its
    parent does not hold again: a child's residual mask are the shared bits that the parent lacks, so differences
    add up on the way down, and a pair of nodes is left as soon as the sum is over the radius.
    """

    def __init__(self, bucket: np.ndarray, fps: np.ndarray):
        order = np.lexsort((gray_rank(fps), bucket))
        self.fps, bucket = fps[order], bucket[order]
        self.order, self.levels = order, []
        ones = alls = self.fps
        while True:
            n = len(bucket)
            head = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            size = np.diff(np.r_[head, n])
            self.levels.append({"mask": ~(ones ^ alls), "pattern": alls, "start": None})
            if (size == 1).all():
                break
            at = np.arange(n) - np.repeat(head, size)
            start = np.flatnonzero(at % FANOUT == 0)
            self.levels[-1]["child_start"], self.levels[-1]["child_end"] = start, np.r_[start[1:], n]
            ones, alls = _parents(ones, alls, start)
            bucket = bucket[start]
        self.n_roots = len(bucket)

    def components(self, radius: int, room: int = 400_000) -> np.ndarray:
        """Smallest position linked to each position over pairs at most `radius` bits apart."""
        n = len(self.fps)
        root = np.arange(n)
        for a, b in self.near_pairs(radius, lambda: root, room):
            root = roots(a, b, n, root)
        return root

    def near_pairs(self, radius: int, root: Callable[[], np.ndarray], room: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of pairs at most `radius` bits apart, but for pairs of nodes whose members all have one root.

        Walks pairs of nodes from the roots down, in portions of `room` pairs. `root` is asked anew for each portion:
        where it links what was returned, a dense group costs little more than its spanning tree.
        """
        top = len(self.levels) - 1
        stack = [(top, np.arange(self.n_roots), np.arange(self.n_roots), np.zeros(self.n_roots, np.int64), np.zeros(self.n_roots, np.uint64))]
        while stack:
            level, a, b, apart, counted = stack.pop()
            if len(a) > room:
                cut = len(a) // 2
                stack.append((level, a[cut:], b[cut:], apart[cut:], counted[cut:]))
                stack.append((level, a[:cut], b[:cut], apart[:cut], counted[:cut]))
                continue
            here = self.levels[level]
            both = here["mask"][a] & here["mask"][b]
            apart = apart + np.bitwise_count((here["pattern"][a] ^ here["pattern"][b]) & both & ~counted)
            near = apart <= radius
            if level:
                near &= self._open(level, root(), a, b)
            a, b, apart, counted = a[near], b[near], apart[near], both[near]
            if not len(a):
                continue
            if level == 0:
                yield a, b
                continue
            below = self.levels[level - 1]
            first, last = below["child_start"], below["child_end"]
            na, nb = last[a] - first[a], last[b] - first[b]
            pairs = na * nb
            which = np.repeat(np.arange(len(a)), pairs)
            at = np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            x, y = first[a][which] + at // nb[which], first[b][which] + at % nb[which]
            ordered = x <= y if level > 1 else x < y
            stack.append((level - 1, x[ordered], y[ordered], apart[which][ordered], counted[which][ordered]))

    def _open(self, level: int, root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs of nodes with members that are not linked yet."""
        low = high = root
        for k in range(level):
            start = self.levels[k]["child_start"]
            low, high = np.minimum.reduceat(low, start), np.maximum.reduceat(high, start)
        return (low[a] != low[b]) | (low[a] != high[a]) | (low[b] != high[b])


def block_masks(radius: int, bits: int = 64) -> list[int]:
    """Masks such that any two fingerprints at most `radius` bits apart agree under one of them.

    The bits fall into radius + 1 blocks: one holds no difference. The other blocks are cut into radius + 1 parts
    in the same way, so each of the (radius + 1) squared masks covers a block and a part of the rest.
    """
    def cut(places: list[int]) -> list[list[int]]:
        k = radius + 1
        return [places[len(places) * i // k: len(places) * (i + 1) // k] for i in range(k)]

    masks = []
    for block in cut(list(range(bits))):
        for part in cut([p for p in range(bits) if p not in block]):
            masks.append(sum(1 << p for p in (*block, *part)))
    return masks


def fingerprint_links(fps: DataFrame, radius: int = 2, room: int = 500_000) -> DataFrame:
    """Edges (u, v) that connect just what the pairs of fingerprints at most `radius` bits apart connect.

    `fps`: distinct fingerprints, column fp. Each goes to one bucket for each block mask, by a hash shuffle; buckets
    with one member end in an aggregation before. A task sorts its buckets and indexes them in portions of about
    `room` rows, a bucket always whole: a bucket shares 35 bits or more, so its distinct members are few even in a
    corpus where a third of all texts are near copies. It returns a spanning tree of what it links, at most a row
    for each member.
    """
    small_batches(fps.sparkSession, rows=50_000)
    masks = block_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("mask", "shared"))
    keyed = keyed.select("fp", F.xxhash64("mask", "shared").alias("bucket"), "mask")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(parts, "bucket", "mask").sortWithinPartitions("bucket", "mask")

    def links(bucket: np.ndarray, mask: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        group = np.cumsum(np.r_[True, (bucket[1:] != bucket[:-1]) | (mask[1:] != mask[:-1])])
        shared = np.bincount(group)[group] > 1
        if not shared.any():
            return None
        index = GrayIndex(group[shared], fp[shared].view(np.uint64))
        root = index.components(radius)
        linked = root != np.arange(len(root))
        members = index.fps.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(members[linked]), pa.array(members[root[linked]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        count = 0

        def portion(final: bool):
            nonlocal held, count
            bucket, mask, fp = (np.concatenate(x) for x in held)
            end = len(bucket)
            if not final:
                changes = np.flatnonzero((bucket[1:] != bucket[:-1]) | (mask[1:] != mask[:-1]))
                end = int(changes[-1]) + 1 if len(changes) else 0
            held, count = [[bucket[end:]], [mask[end:]], [fp[end:]]], len(bucket) - end
            return links(bucket[:end], mask[:end], fp[:end]) if end else None

        for batch in batches:
            for store, name in zip(held, ("bucket", "mask", "fp"), strict=True):
                store.append(batch.column(name).to_numpy())
            count += batch.num_rows
            if count >= room and (out := portion(False)) is not None:
                yield out
        if count and (out := portion(True)) is not None:
            yield out

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, text_key, fp, component_id for every row of `docs`.

    Rows are linked if their fingerprints differ in at most `radius` bits; component_id is the smallest doc_id that
    links reach. Null and empty texts have fingerprint 0 and link like any other. Equal fingerprints are one node of
    the graph, so copies cost nothing. Rows without doc_id have their component's id, null if no row there has one;
    repeated rows have equal results. Other columns are not read.
    """
    prints = cut_lineage(fingerprints(docs, width), "prints")
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "nodes")
    components = cut_lineage(connected_components(fingerprint_links(nodes.select("fp"), radius)), "components")
    placed = nodes.join(components, nodes["fp"] == components["node"], "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("first_doc").alias("component_id")).withColumnRenamed("root", "r")
    named = placed.join(firsts, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return prints.join(cut_lineage(named, "named"), F.col("fp") == F.col("f")).select("doc_id", "text_key", "fp", "component_id")


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` with the smallest doc_id of their group, one row for each group; all columns stay.

    Of repeated rows with that doc_id, and of groups without any doc_id, the row with the smallest hash of all
    columns stays.
    """
    found = near_duplicates(docs, **options)
    heads = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(
        F.col("component_id").alias("_d_doc")).agg(F.min("text_key").alias("_d_key"))
    nameless = found.where("component_id is null").groupBy("fp").agg(F.min("text_key").alias("_d_key")).select(F.lit(None).cast("long").alias("_d_doc"), "_d_key")
    heads = cut_lineage(heads.where("_d_doc is not null").unionByName(nameless), "heads")
    keyed = docs.withColumn("_d_text", F.xxhash64("text"))
    kept = keyed.join(heads, same(keyed, heads, ["doc_id", "_d_text"], ["_d_doc", "_d_key"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "_d_text"]).drop("_d_text")


# --- near copies by the exact similarity of their shingles ----------------------------------------

SAMPLE = 5000  # rows that show which shingles are common; only the order and dealing of shingles depends on it, no result
MOST_COMMON = 100_000
FINEST = 16  # bits of a sketch's finest ranges
BRIEF = 128  # ranges of the sketches that go into the buckets


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted; one zero for a text without words, so such texts are alike."""
    return np.unique(shingle_hashes(raw, width)) if raw and raw.strip() else np.zeros(1, np.uint64)


def sketch(hashes: np.ndarray) -> bytes | None:
    """How many hashes of a set fall into each of about len / 2 equal ranges, a byte each; None if a byte is too small."""
    bits = min(FINEST, max(0, (len(hashes) // 2).bit_length()))
    counts = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) if bits else np.array([len(hashes)])
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def least_difference(a: bytes | None, b: bytes | None) -> int:
    """A number of hashes by which the sets of two sketches differ at least."""
    if a is None or b is None:
        return 0
    x, y = (np.frombuffer(s, np.uint8).astype(np.int64) for s in (a, b))
    size = min(len(x), len(y))
    return int(np.abs(x.reshape(size, -1).sum(1) - y.reshape(size, -1).sum(1)).sum())


def brief(counts: bytes | None) -> bytes | None:
    """The sketch with at most BRIEF ranges, neighbours added up; None if a byte is too small for that."""
    if counts is None or len(counts) <= BRIEF:
        return counts
    wide = np.frombuffer(counts, np.uint8).reshape(BRIEF, -1).sum(1)
    return wide.astype(np.uint8).tobytes() if wide.max() < 256 else None


class Sketches:
    """Sketches of many sets: by how many hashes any two of them differ at least."""

    def __init__(self, sketches: np.ndarray):
        self.size = np.fromiter((0 if s is None else len(s) for s in sketches), np.int64, len(sketches))
        self.place, self.counts, self.levels = np.zeros(len(sketches), np.int64), {}, {}
        for m in np.unique(self.size[self.size > 0]).tolist():
            rows = np.flatnonzero(self.size == m)
            self.counts[m] = rows, np.frombuffer(b"".join(sketches[rows]), np.uint8).reshape(-1, m)

    def _level(self, m: int) -> np.ndarray:
        """Counts of all sets in m ranges; those with fewer ranges are not filled."""
        if m not in self.levels:
            out = np.zeros((len(self.size), m), np.int16)
            for size, (rows, counts) in self.counts.items():
                if size >= m:
                    out[rows] = counts.reshape(len(rows), m, -1).sum(2)
            self.levels[m] = out
        return self.levels[m]

    def differ(self, a: np.ndarray, b: np.ndarray, room: int = 1 << 20) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        coarser = np.minimum(self.size[a], self.size[b])
        for m in np.unique(coarser[coarser > 0]).tolist():
            counts, on = self._level(m), np.flatnonzero(coarser == m)
            for at in range(0, len(on), max(1, room // m)):
                some = on[at:at + max(1, room // m)]
                out[some] = np.abs(counts[a[some]] - counts[b[some]]).sum(1)
        return out


def _keyed_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("text").alias("key"), F.encode(F.col("text").cast("string"), "UTF-8").alias("raw"))


def _distinct_texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """key, raw of the texts of `docs` whose hash is in `keys` (column m), copies within a task once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            new = []
            for key in batch.column("key").to_pylist():
                new.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(new, pa.bool_()))

    texts = _keyed_texts(docs)
    return texts.join(keys, texts["key"] == keys["m"], "left_semi").mapInArrow(run, "key long, raw binary")


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and how many rows hold them, by estimate, of the shingles that several of about SAMPLE rows hold."""
    every = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x or b"", width) for x in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())], ["token"])

    sample = _keyed_texts(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0)).mapInArrow(run, "token long")
    found = sample.groupBy("token").count().where("count > 2").orderBy(F.desc("count"), "token").limit(MOST_COMMON).toPandas()
    tokens, counts = found["token"].to_numpy(np.int64).view(np.uint64), found["count"].to_numpy(np.int64) * every
    order = np.argsort(tokens)
    return tokens[order], counts[order]


class _Meeting:
    """Finds, in rows sorted by token, sub and key, who meets whom, batch by batch; keeps one row from batch to batch."""

    def __init__(self):
        self.last = None  # token, sub, subs, key of the last row
        self.hub, self.waits = 0, False  # first key of the last row's bucket; whether the last row is alone there so far

    def add(self, token: np.ndarray, sub: np.ndarray, subs: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
        """token, sub, subs, key, hub of the rows that share their bucket with another key, or a split token with any."""
        goes_on = False
        if self.last is not None:
            goes_on = (token[0], sub[0]) == self.last[:2]
            if self.waits or goes_on:  # the last row stands before the new ones again
                token, sub, subs, key = (np.r_[x, new] for x, new in zip(self.last, (token, sub, subs, key), strict=True))
        given = self.last is not None and not self.waits and goes_on  # the first row was returned before
        new = np.r_[True, (token[1:] != token[:-1]) | (sub[1:] != sub[:-1]) | (key[1:] != key[:-1])]
        token, sub, subs, key = (x[new] for x in (token, sub, subs, key))
        start = np.r_[True, (token[1:] != token[:-1]) | (sub[1:] != sub[:-1])]
        group = np.cumsum(start) - 1
        hubs = key[start]
        if given:
            hubs[0] = self.hub
        several = np.bincount(group) > 1
        if given:
            several[0] = True
        keep = several[group] | (subs > 1)
        self.last = (token[-1], sub[-1], subs[-1], key[-1])
        self.hub, self.waits = hubs[-1], not keep[-1]
        if given:
            keep[0] = False
        return token[keep], sub[keep], subs[keep], key[keep], hubs[group[keep]]


def shared_prefixes(docs: DataFrame, width: int, least: float, room: int = 200_000) -> DataFrame:
    """token, sub, subs, key, hub: the texts (their hashes) that hold one of their rarest shingles in common with another.

    Two sets of shingles with a Jaccard of `least` share one of the first n - ceil(least * n) + 1 of either, in any
    order that holds for all; common shingles come last, so few texts meet in one. Nothing is lost by it. A shingle
    that the sample shows in more than `room` rows is split into `subs` buckets by the texts' hashes. `hub` is
    the smallest key of the bucket. Null and empty texts are alike; repeated texts count once.
    """
    small_batches(docs.sparkSession)
    common, times = common_shingles(docs, width)
    split = np.maximum(1, -(-times // room))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # copies in one task count once
        for batch in batches:
            keys, tokens, parts = [], [], []
            for key, raw in zip(batch.column("key").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                hashes = shingle_set(raw or b"", width)
                keep = len(hashes) - int(np.ceil(least * len(hashes) - 1e-9)) + 1
                subs = np.ones(len(hashes), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
                    known = common[at] == hashes
                    order = np.lexsort((hashes, np.where(known, times[at], 0)))
                    hashes, subs = hashes[order], np.where(known, split[at], 1)[order]
                tokens.append(hashes[:keep].view(np.int64))
                parts.append(subs[:keep])
                keys.append(np.full(min(keep, len(hashes)), key, np.int64))
            if keys:
                key, subs = np.concatenate(keys), np.concatenate(parts)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(tokens), (key.view(np.uint64) % subs.astype(np.uint64)).astype(np.int64), subs, key)],
                                                 ["token", "sub", "subs", "key"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting = _Meeting()
        for batch in batches:
            if batch.num_rows:
                found = meeting.add(*(batch.column(c).to_numpy() for c in ("token", "sub", "subs", "key")))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["token", "sub", "subs", "key", "hub"])

    dealt = _keyed_texts(docs).mapInArrow(prefixes, "token long, sub long, subs long, key long")
    return by_bucket(dealt, ["token", "sub"], ["key"]).mapInArrow(met, "token long, sub long, subs long, key long, hub long")


def by_bucket(rows: DataFrame, bucket: list[str], order: list[str]) -> DataFrame:
    small_batches(rows.sparkSession, rows=50_000)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *bucket).sortWithinPartitions(*bucket, *order)


def bucket_portions(batches: Iterator[pa.RecordBatch], bucket: list[str], room: int = 200_000) -> Iterator[dict[str, np.ndarray]]:
    """Columns of about `room` rows each time, sorted by bucket; a bucket's rows stay together."""
    held: list[dict[str, np.ndarray]] = []
    count = 0

    def joined() -> dict[str, np.ndarray]:
        return {name: np.concatenate([h[name] for h in held]) for name in held[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append({name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names})
        count += batch.num_rows
        if count >= room and any(held[0][c][0] != held[-1][c][-1] for c in bucket):
            rows = joined()
            differ = np.zeros(count, bool)
            for c in bucket:
                differ |= rows[c] != rows[c][-1]
            end = int(np.flatnonzero(differ)[-1]) + 1
            yield {name: x[:end] for name, x in rows.items()}
            held, count = [{name: x[end:] for name, x in rows.items()}], count - end
    if held:
        yield joined()


def possible_pairs(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """u, v: the pairs whose sizes and sketches allow a Jaccard of `least`: no other pair has it.

    Sets of a and b shingles with that Jaccard differ in at most (1 - least) / (1 + least) * (a + b) of them.
    """
    left, right = (sketches.select(F.col("key").alias(f"{c}k"), F.col("n").alias(f"{c}n"), F.col("sketch").alias(f"{c}s")) for c in "uv")
    both = pairs.join(left, F.col("u") == F.col("uk")).join(right, F.col("v") == F.col("vk")).where(
        F.least("un", "vn") >= least * F.greatest("un", "vn") - 1e-9).select("u", "v", "un", "vn", "us", "vs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.fromiter(map(least_difference, batch.column("us").to_pylist(), batch.column("vs").to_pylist()), np.int64, batch.num_rows)
            sizes = batch.column("un").to_numpy() + batch.column("vn").to_numpy()
            yield batch.select(["u", "v"]).filter(pa.array(apart <= (1 - least) / (1 + least) * sizes + 1e-9))

    return both.mapInArrow(run, "u long, v long")


def similar_pairs(pairs: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """u, v: the pairs of texts of `docs`, by hash, whose sets of shingles have a Jaccard of `least` or more.

    A written table; only the texts of `pairs` are shuffled.
    """
    needed = pairs.select(F.explode(F.array("u", "v")).alias("m")).distinct()
    texts = cut_lineage(_distinct_texts(docs, needed).dropDuplicates(["key"]), "texts")
    left, right = (texts.select(F.col("key").alias(f"{c}k"), F.col("raw").alias(f"{c}r")) for c in "uv")
    both = pairs.join(left, F.col("u") == F.col("uk")).join(right, F.col("v") == F.col("vk")).select("u", "v", "ur", "vr")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[int, np.ndarray] = {}
            alike = []
            for u, v, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for key, raw in ((u, a), (v, b)):
                    if key not in sets:
                        sets[key] = shingle_set(raw or b"", width)
                shared = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
                alike.append(shared >= least * (len(sets[u]) + len(sets[v]) - shared) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(alike, pa.bool_()))

    small_batches(docs.sparkSession)
    found = cut_lineage(both.mapInArrow(run, "u long, v long"), "linked")
    free(texts)
    return found


def similar_groups(docs: DataFrame, width: int = 5, least: float = 0.8, radius: int = 28, room: int = 200_000) -> DataFrame:
    """doc_id, text_key, root for every row of `docs`: rows with one root are linked by pairs of similar texts.

    Texts are similar if the Jaccard of their sets of shingles is `least` or more; it is computed for every link.
    Texts meet in buckets of shared rare shingles. First each meets the hub of its bucket; what is then not linked
    meets through the Gray index over the bucket, by fingerprints of the sets at most `radius` bits apart: of 40 000
    random pairs with a Jaccard of 0.80 to 0.82 the farthest were 25 bits apart. Sizes and sketches rule out most
    pairs, in the bucket already, before any text is fetched. A bucket that was split meets bucket by bucket, so no task indexes more than
    some `room` rows twice. Null and empty texts are one group; rows with equal texts are one text.
    """
    bucket = ["token", "low", "high"]
    shared = cut_lineage(shared_prefixes(docs, width, least, room), "shared")
    small_batches(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x or b"", width) for x in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([majority(x) for x in sets], pa.uint64()).view(pa.int64()),
                                              pa.array(map(len, sets), pa.int64()), pa.array(map(sketch, sets), pa.binary()),
                                              pa.array([brief(sketch(x)) for x in sets], pa.binary())], ["key", "fp", "n", "sketch", "brief"])

    members = _distinct_texts(docs, shared.select(F.col("key").alias("m")).distinct())
    sketches = cut_lineage(members.mapInArrow(measure, "key long, fp long, n long, sketch binary, brief binary").dropDuplicates(["key"]), "sketches")
    stars = shared.where("key <> hub").select(F.col("hub").alias("u"), F.col("key").alias("v")).distinct()
    stars = cut_lineage(possible_pairs(stars, sketches, least), "stars")
    linked = similar_pairs(stars, docs, width, least)
    labels = cut_lineage(connected_components(linked), "labels")

    sizes = sketches.select(F.col("key").alias("k"), "fp", "n", "brief")
    keyed = shared.join(sizes, F.col("key") == F.col("k")).join(labels, F.col("key") == F.col("node"), "left")
    keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)))
    keyed = keyed.select("token", F.least("sub", "other").alias("low"), F.greatest("sub", "other").alias("high"), "sub", "key", "fp", "n", "brief", F.coalesce("root", "key").alias("label"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in bucket_portions(batches, bucket, room):
            change = np.zeros(len(held["key"]), bool)
            for c in bucket:
                change[1:] |= held[c][1:] != held[c][:-1]
            index = GrayIndex(np.cumsum(change), held["fp"].view(np.uint64))
            key, n, label, sub, within = (x[index.order] for x in (held["key"], held["n"], held["label"], held["sub"], held["low"] == held["high"]))
            sketches_here = Sketches(held["brief"][index.order])
            for a, b in index.near_pairs(radius, lambda: label):  # noqa: B023
                here = (label[a] != label[b]) & (np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - 1e-9)
                here &= within[a] | (sub[a] != sub[b])  # pairs of one part meet in its own bucket
                a, b = a[here], b[here]
                near = sketches_here.differ(a, b) <= (1 - least) / (1 + least) * (n[a] + n[b]) + 1e-9
                a, b = key[a[near]], key[b[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])

    met = by_bucket(keyed, bucket, ["key"]).mapInArrow(meet, "u long, v long").distinct()
    more = cut_lineage(met, "met")
    small_batches(docs.sparkSession)
    possible = cut_lineage(possible_pairs(more, sketches, least), "possible")
    free(shared, labels, more, sketches, stars)
    found = similar_pairs(possible, docs, width, least)
    groups = cut_lineage(connected_components(linked.unionByName(found)), "groups")
    free(possible, linked, found)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    return rows.join(groups, F.col("text_key") == F.col("node"), "left").select("doc_id", "text_key", F.coalesce("root", "text_key").alias("root"))


def one_of_similar(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` with the smallest doc_id of their group of similar texts, one row for each group; all columns stay.

    Of repeated rows with that doc_id, and of groups without any doc_id, the row with the smallest text hash stays.
    All null and empty texts are one group, of which one row stays. Columns may have any names; no rows give none.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key")).alias("first")
    heads = similar_groups(docs, **options).groupBy("root").agg(first)
    mark = unused(docs, "row_key")

    def row_key(doc_id: Column, text_key: Column) -> Column:
        """One column without nulls, so that the join and the removal of repeated rows share one shuffle."""
        return F.struct(doc_id.isNull(), F.coalesce(doc_id.cast("long"), F.lit(0).cast("long")), text_key)

    heads = cut_lineage(heads.select(row_key(F.col("first.doc_id"), F.col("first.text_key")).alias(f"{mark}_of_head")), "heads")
    keyed = docs.withColumn(mark, row_key(F.col("doc_id"), F.xxhash64("text")))
    return keyed.join(heads, F.col(mark) == F.col(f"{mark}_of_head"), "left_semi").dropDuplicates([mark]).drop(mark)

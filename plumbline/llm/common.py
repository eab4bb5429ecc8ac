"""What the corpus operators share: batch sizes, row ranks, spanning edges, connected components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.session import cut_lineage, free

WHITE = b" \t\n\x0b\x0c\r"


def small_batches(spark: SparkSession, rows: int = 2000, megabytes: int = 8) -> None:
    """Bound what one Arrow batch holds, in rows and in bytes: Python workers then need the same memory for any input."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20)):
        set_to = spark.conf.get(key, None)
        if set_to is None or not 0 < int(set_to) <= most:
            spark.conf.set(key, str(most))


def unused(df: DataFrame, name: str) -> str:
    """A column name that no column of `df` has or begins with."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = f"_{name}"
    return name


def content_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes: together they stand for the content."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def same(left: DataFrame, right: DataFrame, left_names: list[str], right_names: list[str]) -> Column:
    """Null-safe equality of key columns."""
    out = F.lit(True)
    for a, b in zip(left_names, right_names, strict=True):
        out = out & left[a].eqNullSafe(right[b])
    return out


def chunk_hashes(codes: np.ndarray, starts: np.ndarray, size: np.ndarray, room: int = 1 << 18) -> np.ndarray:
    """64-bit hashes of stretches of an array of code points, in ascending order: sums of a mixed word for each (place, code).

    Some `room` code points are looked at together.
    """
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + room)))
        begin, end = int(starts[low]), int(starts[high - 1] + size[high - 1])
        place = np.arange(1, end - begin + 1, dtype=np.uint64)
        here = (starts[low:high] - begin).astype(np.uint64)
        place -= np.repeat(here, np.diff(np.r_[here, np.uint64(end - begin)]).astype(np.int64))
        place *= np.uint64(0xD1342543DE82EF95)
        place += codes[begin:end].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            place ^= place >> np.uint64(shift)
            place *= np.uint64(factor)
        running = np.r_[np.uint64(0), np.cumsum(place)]
        at = here.astype(np.int64)
        out[low:high] = (running[at + size[low:high]] - running[at]) ^ size[low:high].astype(np.uint64) << np.uint64(40)
        low = high
    return out


def same_chunks(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray, room: int = 1 << 20) -> np.ndarray:
    """Whether a[a_start:a_start + size] and b[b_start:b_start + size] hold the same, for each of the stretches."""
    out = np.ones(len(size), bool)
    ends = np.cumsum(size)
    low = 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - size[low] + room, "right")))
        n = size[low:high]
        which = np.repeat(np.arange(low, high), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[which[a[a_start[which] + inside] != b[b_start[which] + inside]]] = False
        low = high
    return out


def distinct_chunks(codes: np.ndarray, starts: np.ndarray, size: np.ndarray,
                    hashes: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] = chunk_hashes) -> tuple[np.ndarray, ...]:
    """(hash, first, group, times): the distinct stretches, where each first stands, which one each is, how often it occurs.

    Equal hashes bring stretches together; their sizes and code points decide, so stretches of one hash that differ
    are distinct.
    """
    found, first, group, times = np.unique(hashes(codes, starts, size), return_index=True, return_inverse=True, return_counts=True)
    other = np.flatnonzero(first[group] != np.arange(len(starts)))
    one = first[group[other]]
    equal = size[other] == size[one]
    equal[equal] = same_chunks(codes, starts[other[equal]], codes, starts[one[equal]], size[other[equal]])
    if not equal.all():
        apart: dict[bytes, int] = {}
        for k in other[~equal].tolist():
            times[group[k]] -= 1
            content = codes[starts[k]:starts[k] + size[k]].tobytes()
            if content not in apart:
                apart[content] = len(first)
                found, first, times = np.r_[found, found[group[k]]], np.r_[first, k], np.r_[times, 0]
            group[k] = apart[content]
            times[group[k]] += 1
    return found, first, group, times


class KeptChunks:
    """Numbers of stretches seen before, found by hash and compared by content."""

    def __init__(self):
        self.hash, self.number, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.codes = np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.hash)

    def find(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each stretch, -1 if it is not kept."""
        if not len(self):
            return np.full(len(hashes), -1)
        slot = np.minimum(np.searchsorted(self.hash, hashes), len(self) - 1)
        on = (self.hash[slot] == hashes) & (self.size[slot] == size)
        on[on] = same_chunks(self.codes, self.start[slot[on]], codes, starts[on], size[on])
        return np.where(on, self.number[slot], -1)

    def add(self, hashes: np.ndarray, numbers: np.ndarray, codes: np.ndarray, starts: np.ndarray, size: np.ndarray) -> None:
        """Keep stretches. Of equal hashes only one can be found again: the others are taken as new each time."""
        where = np.arange(size.sum()) + np.repeat(starts - np.cumsum(size) + size, size)
        begin = len(self.codes) + np.cumsum(size) - size
        self.codes = np.r_[self.codes, codes[where].astype(np.int32)]
        columns = [np.r_[x, new] for x, new in zip((self.hash, self.number, self.start, self.size), (hashes, numbers, begin, size), strict=True)]
        order = np.argsort(columns[0], kind="stable")
        self.hash, self.number, self.start, self.size = (x[order] for x in columns)


def roots(u: np.ndarray, v: np.ndarray, n: int, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of 0..n-1 over the edges u-v, going on from `root`."""
    root = np.arange(n) if root is None else root
    while True:
        a, b = root[u], root[v]
        differ = a != b
        if not differ.any():
            return root
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            nearer = root[root]
            if (nearer == root).all():
                break
            root = nearer


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) with root the smallest node reachable, for every node that has an edge.

    Alternating large-star and small-star rounds: every round is two joins-free aggregations and two equi-joins over
    the edges, a hot node's rows are split by the skewed join, and each round's edges are a written table.
    """
    e = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a <> b").distinct()
    e = cut_lineage(e, "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["k"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut_lineage(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(low, large["a"] == low["k"])
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        before, e = e, cut_lineage(small, "small")
        free(before, large)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == seen or now["n"] == 0:
            break
        seen = now
    pairs = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

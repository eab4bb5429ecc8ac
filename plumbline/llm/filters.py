"""Filter interaction audit: what each order of the filters removes, read off count-weighted decision diagrams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import small_batches
from plumbline.session import cut_lineage

FILTERS = "ABCDE"
COPY = FILTERS.index("E")
SIGNS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
PARTS_AT_ONCE = 50  # parts whose rows make one batch


def text_failures(raw: bytes) -> int:
    """Bits 0 to 3: under 50 words; few distinct words; many capitals; a sign of SIGNS."""
    words = raw.split()
    points = len(raw) - sum(map(raw.count, _LATER)) if not raw.isascii() else len(raw)
    few = len(words) < 50
    same = 100 * len(set(words)) < 65 * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 5 * points
    signs = len(raw.translate(None, SIGNS)) < len(raw)
    return few | same << 1 | loud << 2 | signs << 3


_LATER = [bytes([b]) for b in range(0x80, 0xC0)]  # later bytes of a code point


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask for every row of `docs`: bit i is set if filter i of FILTERS fails.

    Null texts are empty, null sources the part ''. A text is a copy if a smaller doc_id has an identical one
    anywhere in the table; rows with one doc_id are no copies of each other, and rows without doc_id neither are
    copies nor make others copies. Texts are compared by their SHA-256; what is shuffled for it is one row of
    fixed size for each document, by text and doc_id, so a text with a third of all rows is spread.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array([hashlib.sha256(x).digest() for x in raws], pa.binary()),
                 pa.array(map(text_failures, raws), pa.int32())], ["doc_id", "part", "digest", "mask"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("raw"))
    rows = cut_lineage(rows.mapInArrow(run, "doc_id long, part string, digest binary, mask int"), "masks")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first")).select(F.col("digest").alias("d"), "first")
    both = rows.join(firsts, (rows["digest"] == firsts["d"]) & (rows["doc_id"] == firsts["first"]), "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return both.select("doc_id", "part", F.when(copy, F.col("mask") + (1 << COPY)).otherwise(F.col("mask")).alias("mask"))


def adjacent_swaps(n: int) -> list[int]:
    """Places i such that swapping i and i + 1 in turn walks through all orders of n things."""
    swaps: list[int] = []
    for size in range(2, n + 1):
        walk, at_left = list(range(size - 2, -1, -1)), False
        longer = []
        for inner in [*swaps, None]:
            longer += walk
            walk, at_left = walk[::-1], not at_left
            if inner is not None:
                longer.append(inner + at_left)
        swaps = longer
    return swaps


class Diagram:
    """Decision diagram of failure masks, one level for each filter, with the weights of all masks below each node.

    A node is its pair of children (passes, fails); equal pairs of a level are one node. Below the last level stand
    the distinct weights. Swapping two adjacent levels rebuilds these two only: a node of the upper level keeps its
    number and stands for the same masks, so nothing above it changes.
    """

    def __init__(self, weights: dict[int, tuple[int, ...]], n: int, width: int):
        self.n, self.zero = n, (0,) * width
        self.weight: list[tuple[int, ...]] = []
        self.child: list[tuple[int, int]] = []
        self.order = list(range(n))
        leaves: dict[tuple[int, ...], int] = {}
        nodes = []
        for index in range(1 << n):  # the first filter decides first: it is the highest bit of the index
            mask = sum(1 << f for f in range(n) if index >> (n - 1 - f) & 1)
            w = weights.get(mask, self.zero)
            if w not in leaves:
                leaves[w] = self._add((-1, -1), w)
            nodes.append(leaves[w])
        self.levels: list[dict[tuple[int, int], int]] = []
        for _ in range(n):
            table: dict[tuple[int, int], int] = {}
            nodes = [self._node(table, *nodes[k:k + 2]) for k in range(0, len(nodes), 2)]
            self.levels.insert(0, table)
        self.root = nodes[0]

    def _add(self, child: tuple[int, int], weight: tuple[int, ...]) -> int:
        self.child.append(child)
        self.weight.append(weight)
        return len(self.child) - 1

    def _node(self, table: dict[tuple[int, int], int], passes: int, fails: int) -> int:
        key = (passes, fails)
        if key not in table:
            table[key] = self._add(key, tuple(a + b for a, b in zip(self.weight[passes], self.weight[fails], strict=True)))
        return table[key]

    def swap(self, at: int) -> None:
        """Exchange the filters of levels `at` and `at` + 1."""
        below: dict[tuple[int, int], int] = {}
        above: dict[tuple[int, int], int] = {}
        for (passes, fails), node in self.levels[at].items():
            (pp, pf), (fp, ff) = self.child[passes], self.child[fails]
            self.child[node] = (self._node(below, pp, fp), self._node(below, pf, ff))
            above[self.child[node]] = node
        self.levels[at], self.levels[at + 1] = above, below
        self.order[at], self.order[at + 1] = self.order[at + 1], self.order[at]

    def steps(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, weights kept, weights removed) of each step, along the path on which all filters pass."""
        node = self.root
        for f in self.order:
            passes, fails = self.child[node]
            yield f, self.weight[passes], self.weight[fails]
            node = passes


STEP_SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
               "good_lost long, toxic_lost long, shapley long")


def order_steps(part: str, cells: list[tuple[int, int, int, int]], names: str) -> list[tuple]:
    """Rows of STEP_SCHEMA for all orders of the filters; cells: (mask, documents, good ones, toxic ones)."""
    n = len(names)
    diagram = Diagram({mask: (docs, good, toxic) for mask, docs, good, toxic in cells}, n, 3)
    seen = {}
    for at in [None, *adjacent_swaps(n)]:
        if at is not None:
            diagram.swap(at)
        seen[tuple(diagram.order)] = list(diagram.steps())
    fails, alone, shapley = [0] * n, [0] * n, [0] * n
    for steps in seen.values():
        for k, (f, _, removed) in enumerate(steps):
            shapley[f] += removed[0]
            if k == 0:  # nothing was removed before: all that fail
                fails[f] = removed[0]
            if k == n - 1:  # all others have passed: what fails this one only
                alone[f] = removed[0]
    return [(part, "".join(names[f] for f in order), k + 1, kept[0], removed[0], fails[f] - removed[0], alone[f], removed[1], removed[2], shapley[f])
            for order, steps in seen.items() for k, (f, kept, removed) in enumerate(steps)]


def filter_interactions(masks: DataFrame, names: str = FILTERS) -> DataFrame:
    """STEP_SCHEMA rows for every part and every order of the filters, zeros included.

    `masks`: part, mask, good, toxic (0 or 1) for each document. They are summed to at most 2 to the power of the
    number of filters rows a part before the shuffle, so no part is large; each part has one diagram. No rows give
    no parts.
    """
    cells = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"),
                                              F.sum(F.col("toxic").cast("long")).alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    fields = [f.split()[0] for f in STEP_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PARTS_AT_ONCE):
                piece = batch.slice(start, PARTS_AT_ONCE)
                rows = []
                for part, found in zip(piece.column("part").to_pylist(), piece.column("cells").to_pylist(), strict=True):
                    rows += order_steps(part, [(c["mask"], c["n"], c["good"], c["toxic"]) for c in found], names)
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], fields)

    return parts.mapInArrow(run, STEP_SCHEMA)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """filter_interactions of `docs` under the five filters, with `labels` (doc_id, quality, toxic).

    A document is good if any of its label rows has quality 1, toxic if any has toxic 1; rows without doc_id or
    label are neither. Repeated rows of `docs` count as often as they stand there. Other columns are not read.
    """
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("k")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    masks = failure_masks(docs)
    marked = masks.join(flags, F.col("doc_id") == F.col("k"), "left")
    return filter_interactions(marked.select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))


AUDIT_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (
  select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words, min(doc_id) over (partition by t) as first from d),
f as (
  select doc_id, part,
         (case when len(words) < 50 then 'A' else '' end) || (case when 100 * len(list_distinct(words)) < 65 * len(words) then 'B' else '' end)
         || (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) then 'C' else '' end)
         || (case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end) || (case when coalesce(doc_id > first, false) then 'E' else '' end) as fails
  from w),
l as (
  select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id),
cells as (
  select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f left join l using (doc_id) group by part, fails),
letters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (
  select filter_order, step, substr(filter_order, step, 1) as x, substr(filter_order, 1, step - 1) as before
  from orders, (select unnest(range(1, 6))::int as step)),
counted as (
  select part, filter_order, step, x,
         sum(case when length(translate(fails, before || x, '')) = length(fails) then n else 0 end) as kept,
         sum(case when contains(fails, x) and length(translate(fails, before, '')) = length(fails) then n else 0 end) as removed,
         sum(case when contains(fails, x) and length(translate(fails, before, '')) < length(fails) then n else 0 end) as redundant,
         sum(case when fails = x then n else 0 end) as unique_fails,
         sum(case when contains(fails, x) and length(translate(fails, before, '')) = length(fails) then good else 0 end) as good_lost,
         sum(case when contains(fails, x) and length(translate(fails, before, '')) = length(fails) then toxic else 0 end) as toxic_lost
  from cells, steps group by part, filter_order, step, x)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
       good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, x))::bigint as shapley from counted
"""

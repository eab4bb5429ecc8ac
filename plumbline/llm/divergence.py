"""Source divergence audit: how far the word use of two sources of a language lies apart, over hash-consed segment trees."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import small_batches
from plumbline.session import cut_lineage

SCALE = 1_000_000_000
BUCKET = 12_000  # terms that one set of trees is over, on average
CHUNK = 64  # sources whose trees meet those of another CHUNK in one task
HELD = 400_000  # counts that a task holds before it hands them on
ROOM = 1_000_000  # node pairs that are looked at together

#: Bytes of a term stay, A-Z in lower case; all others part terms.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """Runs of ASCII letters and of all that is not ASCII, A-Z in lower case."""
    return raw.translate(_FOLD).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it): one row for each; term '' with 0 for each group.

    Null texts, languages and sources are ''; every row is a document of its own, whatever its doc_id. A task adds
    up its counts before the shuffle, in portions of HELD counts.
    """
    small_batches(docs.sparkSession)
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: defaultdict[tuple[str, str], Counter] = defaultdict(Counter)
        held: defaultdict[tuple[str, str], Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in times.items():
                terms, inside = [b"", *found], held[lang, source]
                n = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, n), pa.repeat(source, n), pa.array(terms, pa.binary()).cast(pa.string()),
                     pa.array([0, *found.values()], pa.int64()), pa.array([0, *map(inside.__getitem__, found)], pa.int64())], names)
            times.clear()
            held.clear()

        for batch in batches:
            for lang, source, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = terms_of(raw)
                times[lang, source].update(terms)
                held[lang, source].update(set(terms))
            if sum(map(len, times.values())) > HELD:
                yield from out()
        yield from out()

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), F.encode(text("text"), "UTF-8").alias("raw"))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least_docs: int = 3) -> tuple[DataFrame, DataFrame]:
    """(kept, groups), written tables.

    kept: lang, source, term, n, total (occurrences in the language) of the terms in at least `least_docs` documents
    of their language. groups: lang, source, size (occurrences of kept terms), lang_size, terms (kept terms of the
    language) for every lang and source that occurs, also without terms.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = term_counts(docs).repartition(parts, "lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"docs": F.sum("docs").over(term), "total": F.sum("n").over(term)})
    kept = cut_lineage(counts.where((F.col("term") == "") | (F.col("docs") >= least_docs)).select("lang", "source", "term", "n", "total"), "kept")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    # a term's total is counted at one of its sources only
    terms = kept.where("term <> ''").groupBy("lang", "term").agg(F.first("total").alias("total"))
    langs = terms.groupBy("lang").agg(F.sum("total").alias("lang_size"), F.count("*").alias("terms")).withColumnRenamed("lang", "l")
    groups = groups.join(langs, F.col("lang") == F.col("l"), "left").select(
        "lang", "source", "size", F.coalesce("lang_size", F.lit(0)).cast("long").alias("lang_size"), F.coalesce("terms", F.lit(0)).cast("long").alias("terms"))
    return kept.where("term <> ''"), cut_lineage(groups, "groups")


def share(count: Column, size: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (size + terms)) in whole numbers."""
    return F.lit(1) + F.call_function("div", (count.cast("decimal(19,0)") + 1) * F.lit(SCALE).cast("decimal(10,0)"), (size + terms).cast("decimal(19,0)"))


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """The same in numpy, by long division in steps of 1000, so nothing leaves 64 bits."""
    out, rest = np.zeros(len(counts), np.int64), counts + 1
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + step
    return out + 1


class SegmentTrees:
    """Segment trees of several groups over the same term ids, equal subtrees being one node.

    `counts`: a row for each group, a column for each term id. A leaf is a distinct count; a node of level k is a
    distinct pair of nodes of level k - 1. So a stretch of terms that two groups, or two places, use alike is one node.
    """

    def __init__(self, counts: np.ndarray):
        width = 1 << max(0, counts.shape[1] - 1).bit_length()
        self.pad = width - counts.shape[1]
        leaf = np.full((len(counts), width), -1, np.int64)  # -1: no term stands here
        leaf[:, :counts.shape[1]] = counts
        self.counts, nodes = np.unique(leaf, return_inverse=True)
        nodes = nodes.reshape(leaf.shape)
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        n = len(self.counts)
        while nodes.shape[1] > 1:
            pairs, parents = np.unique(nodes[:, 0::2] * n + nodes[:, 1::2], return_inverse=True)
            self.children.append((pairs // n, pairs % n))
            n, nodes = len(pairs), parents.reshape(len(nodes), -1)
        self.roots = nodes[:, 0]

    def leaf_pairs(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(k, x, y, times): leaf x of group a[k] and leaf y of group b[k] stand at one term id `times` times.

        Both trees of a pair of groups are walked together, level by level; a pair of nodes that comes up again
        for the same pair of groups is walked once and counted.
        """
        k = np.arange(len(a))
        stack = [(len(self.children), k, self.roots[a], self.roots[b], np.ones(len(a), np.int64))] if len(a) else []
        while stack:
            level, k, x, y, times = stack.pop()
            if len(k) > ROOM and k[0] != k[-1]:  # sorted by pair of groups: cut between two of them
                cut = int(np.searchsorted(k, k[len(k) // 2]))
                cut = cut or int(np.searchsorted(k, k[0], "right"))
                stack += [(level, k[s], x[s], y[s], times[s]) for s in (slice(cut, None), slice(0, cut))]
                continue
            if level < len(self.children):  # equal pairs of nodes of one pair of groups become one
                n = len(self.children[level - 1][0]) if level else len(self.counts)
                key = (k * n + x) * n + y
                order = np.argsort(key)
                first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
                times = np.add.reduceat(times[order], first)
                at = order[first]
                k, x, y = k[at], x[at], y[at]
            if level == 0:
                yield k, x, y, times
                continue
            left, right = self.children[level - 1]
            stack.append((level - 1, np.repeat(k, 2), np.stack([left[x], right[x]], 1).ravel(), np.stack([left[y], right[y]], 1).ravel(), np.repeat(times, 2)))


def pair_sums(trees: SegmentTrees, totals: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of groups the sums over all terms of (p - q)^2 // q: once p is of a and q of b, once the other way."""
    real = trees.counts >= 0
    price = np.ones((len(totals), len(trees.counts)), np.int64)
    for g, total in enumerate(totals.tolist()):
        price[g, real] = shares(trees.counts[real], max(1, total))
    ab, ba = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for k, x, y, times in trees.leaf_pairs(a, b):
        p, q = price[a[k], x], price[b[k], y]
        square = (p - q) ** 2
        np.add.at(ab, k, square // q * times)
        np.add.at(ba, k, square // p * times)
    return ab, ba


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: how far each source lies from each other source of its language.

    The terms of a language are dealt to buckets by hash; in a bucket they are numbered by falling frequency, so
    rare terms, whose counts are alike, stand together. A task gets the counts of at most twice CHUNK sources, on
    average, in one bucket: the sources of a language are dealt to chunks, and each two chunks meet in a task.
    So neither many sources nor many terms make a large task, and a hot source is one array a bucket.
    """
    spark = kept.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    langs = groups.groupBy("lang").agg(
        F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"),
        F.greatest(F.lit(1), F.ceil(F.max("terms") / BUCKET)).cast("int").alias("buckets")).withColumnRenamed("lang", "l")
    sized = groups.join(langs, F.col("lang") == F.col("l")).drop("l")
    sized = cut_lineage(sized.withColumn("chunk", F.pmod(F.xxhash64("source"), "chunks")), "sized")
    placed = kept.join(langs, F.col("lang") == F.col("l")).withColumn("bucket", F.pmod(F.xxhash64("term"), "buckets").cast("int"))
    by_use = Window.partitionBy("lang", "bucket").orderBy(F.desc("total"), "term")
    numbered = placed.select("lang", "source", "bucket", "n", (F.dense_rank().over(by_use) - 1).alias("id"))
    arrays = numbered.groupBy("lang", "bucket", "source").agg(F.collect_list(F.struct("id", "n")).alias("found"), F.max("id").alias("last"))
    arrays = cut_lineage(arrays.select(F.col("lang").alias("l"), F.col("bucket").alias("b"), F.col("source").alias("s"),
                                       F.col("found.id").alias("ids"), F.col("found.n").alias("counts"), "last"), "arrays")
    widths = arrays.groupBy("l", "b").agg((F.max("last") + 1).alias("width")).withColumnsRenamed({"l": "wl", "b": "wb"})
    # a source without any term of a bucket takes part there too
    rows = sized.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    rows = rows.join(widths, (F.col("lang") == F.col("wl")) & (F.col("bucket") == F.col("wb")), "left")
    rows = rows.join(arrays, (F.col("lang") == F.col("l")) & (F.col("bucket") == F.col("b")) & (F.col("source") == F.col("s")), "left")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("lang", "bucket", F.least("chunk", "other").cast("int").alias("low"), F.greatest("chunk", "other").cast("int").alias("high"),
                       F.col("chunk").cast("int").alias("chunk"), "source", (F.col("size") + F.col("terms")).alias("total"),
                       F.coalesce("width", F.lit(0)).alias("width"), "ids", "counts")
    key = ["lang", "bucket", "low", "high"]

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        lang, low, high = rows["lang"].iat[0], rows["low"].iat[0], rows["high"].iat[0]
        rows = rows.sort_values(["chunk", "source"])
        width = int(rows["width"].iat[0])
        counts = np.zeros((len(rows), width), np.int64) if width else np.full((len(rows), 1), -1, np.int64)
        for g, (ids, n) in enumerate(zip(rows["ids"], rows["counts"], strict=True)):
            if ids is not None:
                counts[g, np.asarray(ids, np.int64)] = n
        left = np.flatnonzero(rows["chunk"] == low)
        if low == high:
            a, b = (left[i] for i in np.triu_indices(len(left), 1))
        else:
            right = np.flatnonzero(rows["chunk"] == high)
            a, b = np.repeat(left, len(right)), np.tile(right, len(left))
        ab, ba = pair_sums(SegmentTrees(counts), rows["total"].to_numpy(np.int64), a, b)
        source = rows["source"].to_numpy(object)
        return pd.DataFrame({"lang": lang, "source": np.r_[source[a], source[b]], "item": np.r_[source[b], source[a]], "value": np.r_[ab, ba]})

    met = rows.repartition(parts, *key).groupBy(*key).applyInPandas(meet, "lang string, source string, item string, value long")
    return met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def raised_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the terms that a source uses more than its language does, and by how much."""
    sizes = groups.withColumnsRenamed({"lang": "l", "source": "s"})
    rows = kept.where("n > 0").join(sizes, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")))
    p, q = F.col("p"), F.col("q")
    rows = rows.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("size"), F.col("terms")).alias("p"),
                       share(F.col("total"), F.col("lang_size"), F.col("terms")).alias("q")).where(p > q)
    return rows.select("lang", "source", "item", F.call_function("div", (p - q) * (p - q), q).alias("value"))


def audit_sources(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank, for every (lang, source) of `docs`.

    Part `pair`: every other source of the language, by falling distance. Part `term`: the `most_terms` terms that
    the source uses most beyond its language (a report: the rest is not asked for). Ties go by item in UTF-8 order.
    A language without kept terms has pairs of value 0 and no terms; a language with one source has no pairs. Nulls
    are '', no rows give no rows, repeated rows count each, other columns are not read.
    """
    kept, groups = kept_terms(docs, least_docs)
    rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = source_pairs(kept, groups).withColumn("rank", F.row_number().over(rank))
    terms = raised_terms(kept, groups).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most_terms)
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select(
        "lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


AUDIT_SQL = r"""
with d as (
  select row_number() over () as k, coalesce(text, '') as t, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (
  select k, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
v as (
  select lang, term, count(*) as n from w group by lang, term having count(distinct k) >= 3),
c as (
  select w.lang, w.source, w.term, count(*) as n from w join v on w.lang = v.lang and w.term = v.term group by all),
g as (
  select lang, source from d group by all),
gn as (
  select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as size from g left join c on g.lang = c.lang and g.source = c.source group by all),
ln as (
  select lang, sum(n)::hugeint as size, count(*)::hugeint as terms from v group by lang),
gp as (
  select gn.lang, gn.source, v.term, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (gn.size + ln.terms) as p
  from gn join v on gn.lang = v.lang join ln on ln.lang = v.lang left join c on c.lang = gn.lang and c.source = gn.source and c.term = v.term),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(sum(x.value), 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as other, sum(((x.p - y.p) * (x.p - y.p)) // y.p) as value
             from gp x join gp y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) x
    on x.lang = a.lang and x.source = a.source and x.other = b.source group by all),
lp as (
  select v.lang, v.term, 1 + (1000000000::hugeint * (v.n + 1)) // (ln.size + ln.terms) as q from v join ln on v.lang = ln.lang),
terms as (
  select gp.lang, gp.source, gp.term as item, ((p - q) * (p - q)) // q as value
  from gp join c on c.lang = gp.lang and c.source = gp.source and c.term = gp.term join lp on lp.lang = gp.lang and lp.term = gp.term where p > q),
ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from terms qualify
    row_number() over (partition by lang, source order by value desc, item) <= 200)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked
"""

"""Ordered operators that survive a group holding a large share of all rows.

A running window puts a whole group into one task. Here a group is cut into
stretches of `width` positions. Each stretch is one window partition; what flows
from one stretch into the next (the last value, a sum) is summarised to one row
per stretch, carried over the summary rows, and joined back. The summary rows are
cut into stretches in the same way, so sparse positions make no large window either:
with the default width no window is larger than 65 536 rows for positions below 2^48.
Positions are integers within the group, e.g. row or paragraph numbers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

WIDTH = 65_536


def _carried(summaries: DataFrame, keys: Sequence[str], order: str, kinds: Mapping[str, str], width: int, levels: int) -> DataFrame:
    """(keys, order, _carry_*): the last value or the sum over all earlier summaries."""
    def over(name: str, kind: str, window) -> Column:
        value = F.col(f"`_sum_{name}`")
        return (F.last(value, ignorenulls=True) if kind == "last" else F.sum(value)).over(window)

    if levels == 1:
        earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return summaries.select(*keys, order, *[over(n, k, earlier).alias(f"_carry_{n}") for n, k in kinds.items()])

    upper = f"{order}_"
    cut = summaries.withColumn(upper, F.floor(F.col(order) / F.lit(width)))
    by = [*keys, upper]
    earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select(*by, order, *[over(n, k, earlier).alias(f"_near_{n}") for n, k in kinds.items()])

    def total(name: str, kind: str) -> Column:
        value = F.col(f"`_sum_{name}`")
        return F.max_by(value, F.when(value.isNotNull(), F.col(order))) if kind == "last" else F.sum(value)

    totals = cut.groupBy(*by).agg(*[total(n, k).alias(f"_sum_{n}") for n, k in kinds.items()])
    far = _carried(totals, keys, upper, kinds, width, levels - 1)
    both = local.join(far, by, "left")

    def merged(name: str, kind: str) -> Column:
        near, before = F.col(f"`_near_{name}`"), F.col(f"`_carry_{name}`")
        return F.coalesce(near, before) if kind == "last" else F.coalesce(near, F.lit(0)) + F.coalesce(before, F.lit(0))

    return both.select(*keys, order, *[merged(n, k).alias(f"_carry_{n}") for n, k in kinds.items()])


def with_carry(
    df: DataFrame,
    group: Sequence[str],
    pos: str,
    columns: Mapping[str, tuple[Column, Column, str, Column]],
    width: int = WIDTH,
    levels: int = 2,
) -> DataFrame:
    """Add running columns.

    columns: name -> (running value inside a stretch, summary of a stretch,
    'last' or 'sum' over the earlier summaries, result out of `inner` and `carried`).
    The result may refer to F.col('_in_<name>') and F.col('_carry_<name>').
    """
    # one struct as the key: windows, sums and the join share its partitioning, and no key equals no key
    keys, names = ["_key"], df.columns
    key = F.struct(*[F.col(k) for k in group]) if group else F.struct(F.lit(0))
    cut = df.withColumns({"_key": key, "_stretch": F.floor(F.col(pos) / F.lit(width))})
    by = ["_key", "_stretch"]
    inner = Window.partitionBy(*by).orderBy(pos)
    local = cut.withColumns({f"_in_{n}": spec[0].over(
        inner if n.startswith("lag:") else inner.rowsBetween(Window.unboundedPreceding, 0))
        for n, spec in columns.items()})

    summaries = cut.groupBy(*by).agg(*[spec[1].alias(f"_sum_{n}") for n, spec in columns.items()])
    carried = _carried(summaries, keys, "_stretch", {n: spec[2] for n, spec in columns.items()}, width, levels)
    joined = local.join(carried, by, "left")
    return joined.select(*names, *[spec[3].alias(n.split(":")[-1]) for n, spec in columns.items()])


def fill_down(df: DataFrame, keys: Sequence[str], pos: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """The last value that is not null at or before each row."""
    spec = (
        F.last(value, ignorenulls=True),
        F.max_by(value, F.when(value.isNotNull(), F.col(pos))),
        "last",
        F.coalesce(F.col(f"_in_{name}"), F.col(f"_carry_{name}")),
    )
    return with_carry(df, keys, pos, {name: spec}, width)


def running_sum(df: DataFrame, keys: Sequence[str], pos: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    spec = (F.sum(value), F.sum(value), "sum",
            F.col(f"_in_{name}") + F.coalesce(F.col(f"_carry_{name}"), F.lit(0)))
    return with_carry(df, keys, pos, {name: spec}, width)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, columns: Mapping[str, str], tie: str | None = None,
          width: int = WIDTH) -> DataFrame:
    """Each row of `left` with the columns of the last row of `right` with its keys at or before its time, null if there is none.

    columns: column of `right` -> name in the result. Of rows of `right` with one time, the one with the largest `tie`
    counts. Both tables may have any size, and one group any part of them: the rows are put into one order, cut into
    stretches, and only one row a stretch is carried on. A null key or time finds nothing.
    """
    keys = list(keys)
    names = [F.col(c).alias(f"_k_{c}") for c in keys]
    found = F.struct(*[F.col(c).alias(name) for c, name in columns.items()])
    order = F.col(tie) if tie else F.lit(None).cast("long")
    known = right.dropna(subset=[*keys, at]).select(*names, F.col(at).alias("_at"), F.lit(0).alias("_side"), order.alias("_tie"), found.alias("_right"))
    asked = left.select(*names, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_left"))
    both = known.unionByName(asked, allowMissingColumns=True)
    groups = [f"_k_{c}" for c in keys]
    ranked = dense_ranks(both, [*groups, "_at", "_side", "_tie"], groups, "_place")
    filled = fill_down(ranked, groups, "_place", F.col("_right"), "_last", width).filter("_side = 1")
    last = F.when(F.col("_at").isNotNull(), F.col("_last"))
    return filled.select("_left.*", *[last[name].alias(name) for name in columns.values()])


def renumber(df: DataFrame, keys: Sequence[str], pos: str, name: str, width: int = WIDTH) -> DataFrame:
    """1..n in order within each group."""
    return running_sum(df, keys, pos, F.lit(1).cast("long"), name, width)


def previous(df: DataFrame, keys: Sequence[str], pos: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """Value of the row just before, null on the first row of a group."""
    boxed = F.struct(value.alias("v"))
    key = f"lag:{name}"
    spec = (F.lag(boxed, 1), F.max_by(boxed, F.col(pos)), "last",
            F.coalesce(F.col(f"`_in_{key}`"), F.col(f"`_carry_{key}`"))["v"])
    return with_carry(df, keys, pos, {key: spec}, width)


def islands(df: DataFrame, keys: Sequence[str], pos: str, value: str, name: str, width: int = WIDTH) -> DataFrame:
    """Number the runs of equal values in order, from 1."""
    marked = previous(df, keys, pos, F.col(value), "_before", width)
    start = F.when(F.col("_before").isNull() | (F.col("_before") != F.col(value)), 1).otherwise(0).cast("long")
    return running_sum(marked.withColumn("_start", start), keys, pos, F.col("_start"), name, width).drop("_before", "_start")


def stop_after_gap(df: DataFrame, keys: Sequence[str], pos: str, start: Column, limit: int, width: int = WIDTH) -> DataFrame:
    """Keep the rows before the first run of `limit` missing positions. `start` is the first position to look at."""
    gaps = previous(df, keys, pos, F.col(pos), "_before", width).withColumn(
        "_gap", F.col(pos) - F.coalesce(F.col("_before"), start - 1) - 1)
    stops = gaps.filter(F.col("_gap") >= limit).groupBy(*keys).agg(F.min(pos).alias("_stop"))
    return (
        gaps.join(stops, list(keys), "left")
        .filter(F.col("_stop").isNull() | (F.col(pos) < F.col("_stop")))
        .drop("_before", "_gap", "_stop")
    )


def compared_with_first(df: DataFrame, keys: Sequence[str], pos: str, fields: Sequence[str]) -> DataFrame:
    """Every later row of a group next to the first row of the group.

    The first row is an aggregate, so the shuffle carries one row per task and key.
    """
    keys = list(keys)
    first = df.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(pos).alias("_pos"), *fields), F.col(pos)).alias("first"))
    left, right = df.alias("l"), first.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return left.join(right, same).filter(F.col(f"l.{pos}") > F.col("r.first._pos")).select("l.*", "r.first")


def keep_first(df: DataFrame, keys: Sequence[Column | str], pos: str) -> DataFrame:
    """Exact duplicates: the first row of each key stays. Combined before the shuffle."""
    names = df.columns
    return (
        df.groupBy(*[(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)])
        .agg(F.min_by(F.struct(*names), F.col(pos)).alias("_row"))
        .select(*[F.col("_row")[n].alias(n) for n in names])
    )


def dense_ranks(df: DataFrame, order: Sequence[str], groups: Sequence[str], rank: str, total: Sequence[str] = (),
                adaptive: bool = False) -> DataFrame:
    """Gapless 0-based rank of each row within its group, in the given order, of which the groups are a prefix.

    The rows are range-partitioned and sorted once and written; what a partition holds of a group is one row of
    counts, and a running sum over those rows shifts the partition's own ranks. `total`: number columns for which
    the sum over the rows before is returned as `before_<name>`, by the same two steps. `adaptive`: adaptive
    execution joins neighbouring small partitions, so a small batch makes few files.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c).asc_nulls_first() for c in order]
    dealt = df.repartitionByRange(*cols) if adaptive else df.repartitionByRange(parts, *cols)
    laid = dealt.sortWithinPartitions(*cols)
    laid = cut_lineage(laid.withColumn("_row", F.monotonically_increasing_id()), "ranks")
    laid = laid.withColumn("_part", F.shiftrightunsigned("_row", 33)).withColumn("_at", F.col("_row").bitwiseAND((1 << 33) - 1))
    held = laid.groupBy("_part", *groups).agg(F.min("_at").alias("_low"), F.count("*").alias("_n"),
                                              *[F.sum(c).alias(f"_sum_{c}") for c in total])
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("_part", *[F.col(g).alias(f"_g_{g}") for g in groups], "_low",
                       F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
                       *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_base_{c}") for c in total])
    held = cut_lineage(held.withColumnRenamed("_part", "_p"), "held")
    on = laid["_part"] == held["_p"]
    for g in groups:
        on = on & laid[g].eqNullSafe(held[f"_g_{g}"])
    out = laid.join(held, on).withColumn(rank, F.col("_at") - F.col("_low") + F.col("_base"))
    if total:
        inside = Window.partitionBy("_part", *groups).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        for c in total:
            out = out.withColumn(f"before_{c}", F.col(f"_base_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.select(*df.columns, rank, *[f"before_{c}" for c in total])


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in the given order.

    Spark cuts each task to n rows per group before the shuffle (group limit).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def joined_text(
    df: DataFrame, keys: Sequence[str], pos: str, text: Column, separator: str,
    name: str = "text", rows_per_part: int | None = None,
) -> DataFrame:
    """Ordered concatenation: one text per group, column `part` is 0.

    On request the rows of a group are cut into parts of `rows_per_part` positions; the
    parts of a group in order, with the separator between, are the whole text.
    """
    part = F.lit(0).cast("long") if rows_per_part is None else F.floor(F.col(pos) / F.lit(rows_per_part))
    return (
        df.groupBy(*keys, part.alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), text.alias("t")))).alias("_items"))
        .select(*keys, "part", F.array_join(F.transform("_items", lambda x: x["t"]), separator).alias(name))
    )

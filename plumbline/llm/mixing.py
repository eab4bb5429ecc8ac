"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import unused
from plumbline.session import cut_lineage

PIECE = 16.0  # largest mean that one inversion takes; larger means are sums of independent pieces
TERMS = 120  # terms of a distribution: beyond them is less than 2^-52 for a mean of up to 16


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, growth: float = 1.0) -> DataFrame:
    """source, rate, pieces, cdf: how often a document of the source is wanted on average, and the inverse's table.

    `weights` gives each source's share of the mixture (shares are scaled to sum 1; sources without a weight get
    none); without it, shares follow the row counts to the power `exponent`. The mixture has `growth` times the
    rows of the input on average. Null sources are one source.
    """
    counts = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(exponent)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "named string, weight double")
        counts = counts.join(given, counts["source"].eqNullSafe(given["named"]), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    counts = cut_lineage(counts, "counts")
    # two numbers; the decimal sum does not depend on the order of rows
    sums = counts.agg(F.sum("n").alias("n"), F.sum(F.col("weight").cast("decimal(38,12)")).cast("double").alias("weight")).first()
    scaled = F.col("weight") / F.lit(sums["weight"] or 1.0) * F.lit(sums["n"] or 0) * growth / F.col("n")
    rated = counts.withColumn("rate", scaled)
    rated = rated.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int")).withColumn("mean", F.col("rate") / F.col("pieces"))
    start = F.struct(F.exp(-F.col("mean")).alias("term"), F.array(F.exp(-F.col("mean"))).alias("cdf"))

    def add(acc, k):
        term = acc["term"] * F.col("mean") / k
        return F.struct(term.alias("term"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + term)).alias("cdf"))

    table = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, add, lambda acc: acc["cdf"])
    return cut_lineage(rated.select("source", "rate", "pieces", table.alias("cdf")), "rates")


def _uniform(salt: Column) -> Column:
    """A number in [0, 1) with 52 bits, from a hash of the seed, the row's key and the piece."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", salt, F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, growth: float = 1.0, seed: str = "mix") -> DataFrame:
    """Documents repeated at their source's rate and shuffled: all columns of `docs`, _copy (from 1) and _order.

    A document's count inverts the Poisson distribution with its source's rate at a number hashed from seed and
    doc_id, so it is the same on every run and under any partitioning. The rows are dealt to partitions by a hash
    of document and copy, and sorted by it there, so neighbours are random. Rows with equal doc_id and source have
    equal counts; null ids have one key; null sources are a source. Texts are not looked at. Columns of `docs` named
    _copy or _order are replaced; others may have any name.
    """
    docs = docs.drop("_copy", "_order")
    own = unused(docs, "mix")
    rates = repetition_rates(docs, weights, exponent, growth)
    rates = rates.select(F.col("source").alias(f"{own}_source"), F.col("pieces").alias(f"{own}_pieces"), F.col("cdf").alias(f"{own}_cdf"))
    rated = docs.join(rates, F.col("source").cast("string").eqNullSafe(F.col(f"{own}_source")))
    # one hash for each piece of a document, drawn before the table is searched
    drawn = F.transform(F.sequence(F.lit(1), F.col(f"{own}_pieces")), lambda piece: _uniform(F.concat_ws(":", F.lit(seed), piece.cast("string"))))
    rated = rated.withColumn(f"{own}_draws", drawn)
    counts = F.transform(f"{own}_draws", lambda u: F.size(F.filter(f"{own}_cdf", lambda c: c <= u)))
    rated = rated.withColumn(f"{own}_times", F.aggregate(counts, F.lit(0), lambda a, x: a + x)).where(F.col(f"{own}_times") > 0)
    copies = rated.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(f"{own}_times"))))
    copies = copies.withColumn("_order", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.col("_copy").cast("string"))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartition(parts, "_order").sortWithinPartitions("_order").select(*docs.columns, "_copy", "_order")


MIX_SQL = r"""
counts as (
  select source, count(*) as n, pow(count(*)::double, 0.5) as weight from {table} group by source),
total as (
  select sum(n) as total, sum(weight::decimal(38,12))::double as all_weights from counts),
rates as (
  select source, weight / all_weights * total * 1.0 / n as rate,
         greatest(1, ceil(weight / all_weights * total * 1.0 / n / 16.0))::int as pieces from counts, total),
terms as (
  with recursive t(source, mean, k, term, cdf) as (
    select source, rate / pieces, 0, exp(-rate / pieces), exp(-rate / pieces) from rates
    union all
    select source, mean, k + 1, term * mean / (k + 1), cdf + term * mean / (k + 1) from t where k < 120)
  select source, list(cdf order by k) as cdf from t group by source),
drawn as (
  select d.*, list_sum(list_transform(range(1, r.pieces + 1), lambda p: len(list_filter(t.cdf, lambda c: c <=
           ('0x' || substr(md5('mix:' || p || ':' || coalesce(d.doc_id::varchar, 'none')), 1, 13))::bigint / 4503599627370496.0))))::int as times
  from {table} d join rates r on d.source is not distinct from r.source join terms t on d.source is not distinct from t.source),
mixed as (
  select d.* exclude (times), unnest(range(1, times + 1))::int as copy from drawn d where times > 0)
"""

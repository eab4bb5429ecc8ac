"""Quality rules: base rules, then a minimum-covariance-determinant estimate per language and source."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import WHITE, same, small_batches
from plumbline.session import cut_lineage

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOLS, _TRAILING, _MARKS = b"#*$%&|<>", bytes(range(0x80, 0xC0)), b"!?,;:"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
D = 7
#: Least spread of each transformed statistic: below it a difference is of no interest, however equal the others are.
FLOOR = [0.12, 0.12, 0.10, 0.12, 0.16, 0.16, 0.12]


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in a window of `width` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    code = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + code[k:k + n]
    ordered = np.sort(rolled)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    # equal hashes: decide by the words themselves, numbering runs of 1, 2, 4 and 8 words
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    step = 1
    while step < width:
        pairs = ids[:-step] * (len(words) + 1) + ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    twice = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_stats(raw: bytes) -> tuple:
    """The base statistics of a text, and its capitals, marks, lines and words that repeat the word before."""
    words = raw.split()
    letters = raw.translate(None, WHITE)
    chars = len(letters.translate(None, _TRAILING))
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    return (len(words), chars, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
            len(letters) - len(letters.translate(None, _UPPER)), len(letters) - len(letters.translate(None, _MARKS)), len(lines),
            sum(map(eq, words, words[1:])))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, a hash of the text, and the statistics of the whole text of every row."""
    small_batches(docs.sparkSession)
    fields = [*STATS, "n_upper", "n_marks", "n_lines", "n_echoes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_stats(x or b"") for x in batch.column("raw").to_pylist()]
            columns = np.array(rows, np.int64).reshape(-1, len(fields)).T
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + [pa.array(x) for x in columns],
                                             ["doc_id", "lang", "source", "text_key", *fields])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_key"),
                       F.encode(F.col("text").cast("string"), "UTF-8").alias("raw"))
    return rows.mapInArrow(run, "doc_id long, lang string, source string, text_key long, " + ", ".join(f"{f} long" for f in fields))


def _vector() -> Column:
    """Transformed statistics; square roots of shares keep their spread alike at any share."""
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    return F.array(F.log(chars / n), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_upper") / chars),
                   F.sqrt(F.col("n_marks") / n), F.sqrt(F.col("n_dup_lines") / lines), F.sqrt(F.col("n_repeat_words") / n), F.sqrt(F.col("n_echoes") / n))


def _chi2_below(x: float, d: int) -> float:
    """P(chi-square with d degrees <= x), by its series."""
    if x <= 0:
        return 0.0
    a, z = d / 2, x / 2
    term = total = 1 / a
    for k in range(1, 500):
        term *= z / (a + k)
        total += term
    return min(1.0, total * exp(-z + a * log(z) - lgamma(a)))


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_below(mid, d) < p else (low, mid)
    return (low + high) / 2


def _distance() -> Column:
    """Squared Mahalanobis distance of x from `centre` under `inverse`."""
    gap = [F.col("x")[i] - F.col("centre")[i] for i in range(D)]
    out = F.lit(0.0)
    for i in range(D):
        for j in range(i, D):
            out = out + gap[i] * gap[j] * F.col("inverse")[i * D + j] * F.lit(1.0 if i == j else 2.0)
    return out


def _fitted(rows: DataFrame, factor: float) -> DataFrame:
    """Centre and inverse covariance of the rows of each scope, from sums that combine before the shuffle."""
    pairs = [(i, j) for i in range(D) for j in range(i, D)]
    sums = rows.groupBy("scope").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(D)]).alias("centre"),
                                     F.array(*[F.avg(F.col("x")[i] * F.col("x")[j]) for i, j in pairs]).alias("products"))

    def invert(frames):
        for f in frames:
            out = []
            for centre, products in zip(f["centre"], f["products"], strict=True):
                m, cov = np.asarray(centre), np.zeros((D, D))
                for (i, j), value in zip(pairs, products, strict=True):
                    cov[i, j] = cov[j, i] = value - m[i] * m[j]
                out.append(np.linalg.inv(cov * factor + np.diag(np.square(FLOOR))).ravel())
            f["inverse"] = out
            yield f[["scope", "centre", "inverse"]]

    return cut_lineage(sums.mapInPandas(invert, "scope string, centre array<double>, inverse array<double>"), "fit")


def estimates(rows: DataFrame, share: float = 0.75, steps: int = 3) -> DataFrame:
    """scope, centre, inverse: the minimum covariance determinant of each scope's vectors.

    Starts from medians and median deviations; each step keeps the `share` of rows nearest to the estimate and
    estimates anew from them, which never raises the determinant; one last step re-weights, with the rows within
    the 97.5 % quantile. All statistics are aggregates over all rows.
    """
    middle = rows.groupBy("scope").agg(F.array(*[F.percentile_approx(F.col("x")[i], 0.5, 2000) for i in range(D)]).alias("centre"))
    middle = cut_lineage(middle, "middle")
    gaps = rows.join(middle, "scope").groupBy("scope", "centre").agg(F.array(*[
        F.percentile_approx(F.abs(F.col("x")[i] - F.col("centre")[i]), 0.5, 2000) for i in range(D)]).alias("mad"))
    spread = [F.pow(F.col("mad")[i] * 1.4826, 2) + FLOOR[i] ** 2 for i in range(D)]
    fit = cut_lineage(gaps.select("scope", "centre", F.array(*[
        F.lit(1.0) / spread[i] if i == j else F.lit(0.0) for i in range(D) for j in range(D)]).alias("inverse")), "fit")
    q = chi2_quantile(share, D)
    for _ in range(steps):
        near = rows.join(fit, "scope").select("scope", "x", _distance().alias("d2"))
        cut = cut_lineage(near.groupBy("scope").agg(F.percentile_approx("d2", share, 2000).alias("most")), "cut")
        fit = _fitted(near.join(cut, "scope").where("d2 <= most"), share / _chi2_below(q, D + 2))
    near = rows.join(fit, "scope").select("scope", "x", _distance().alias("d2"))
    q = chi2_quantile(0.975, D)
    return _fitted(near.where(F.col("d2") <= q), 0.975 / _chi2_below(q, D + 2))


def quality_verdicts(docs: DataFrame, least_rows: int = 200, quantile: float = 0.9999) -> DataFrame:
    """One row per row of `docs`: statistics, base_failed, the squared distance from the estimate and kept.

    Estimates are per language and source, from the rows that pass the base rules; a pair with fewer than
    `least_rows` of them is estimated with the other small sources of its language, those of a small language
    together. Where even these are too few, or for rows without a vector, the base rules decide alone. Null
    languages and sources are values like others. Null and empty texts have no words, so the base rules reject
    them. Repeated rows count as often as they are there; other columns are not read.
    """
    stats = statistics(docs).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    stats = stats.withColumn("x", _vector()).withColumn("group", F.to_json(F.struct("lang", "source")))
    stats = cut_lineage(stats, "stats")
    passed = stats.where(~F.col("base_failed"))
    counts = cut_lineage(passed.groupBy("group", "lang").agg(F.count("*").alias("n")), "counts")
    few = counts.where(F.col("n") < least_rows)
    by_lang = few.groupBy("lang").agg(F.sum("n").alias("n_lang")).withColumnRenamed("lang", "l")
    rest = F.when(F.col("n_lang") >= least_rows, F.to_json(F.struct(F.lit(1).alias("level"), "lang"))).otherwise(F.lit("all"))
    scopes = counts.where(F.col("n") >= least_rows).select("group", F.col("group").alias("scope")).unionByName(
        few.join(by_lang, F.col("lang").eqNullSafe(F.col("l"))).select("group", rest.alias("scope")))
    scopes = cut_lineage(scopes, "scopes")
    rows = cut_lineage(passed.join(scopes, "group").select("scope", "x"), "vectors")
    enough = rows.groupBy("scope").count().where(F.col("count") >= least_rows).select("scope")
    fit = cut_lineage(estimates(rows).join(enough, "scope"), "estimates")
    judged = stats.join(scopes, "group", "left").join(fit, "scope", "left").withColumn("d2", _distance())
    most = chi2_quantile(quantile, D)
    return judged.select("doc_id", "lang", "source", "text_key", *STATS, "base_failed", "d2",
                         (~F.col("base_failed") & F.coalesce(F.col("d2") <= most, F.lit(True))).alias("kept"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that pass, with all their columns."""
    bad = quality_verdicts(docs, **options).where("not kept").select(
        F.col("doc_id").alias("_q_doc"), F.col("lang").alias("_q_lang"), F.col("source").alias("_q_source"), F.col("text_key").alias("_q_key")).distinct()
    bad = cut_lineage(bad, "rejected")
    keyed = docs.withColumn("_q_text", F.xxhash64("text"))
    on = same(keyed, bad, ["doc_id", "lang", "source", "_q_text"], ["_q_doc", "_q_lang", "_q_source", "_q_key"])
    return keyed.join(bad, on, "left_anti").drop("_q_text")

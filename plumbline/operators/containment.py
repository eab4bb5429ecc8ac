"""Substring joins without comparing every text with every other.

If a needle lies inside a text, its inner words (all but the first and the last)
are whole words of that text. So the pair is found on the needle's rarest inner
word. A needle without inner words is anchored on its longest piece: the distinct
words of the texts are indexed by their short substrings, which gives the whole
words that hold the piece. Every candidate is checked with contains().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 3


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def _inner(c: Column) -> Column:
    """Words with white space on both sides within the text itself."""
    parts = F.split(c, r"\s+")
    return F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: w != "")


def _short_pieces(word: Column) -> Column:
    """All distinct substrings of up to PIECE characters."""
    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(word) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substr(word, i, F.lit(n)))

    return F.array_distinct(F.concat(*[of_size(n) for n in range(1, PIECE + 1)]))


def contained(
    needles: DataFrame, texts: DataFrame, scope: Sequence[str] = (),
    needle: str = "needle", needle_id: str = "needle_id", text: str = "text", text_id: str = "text_id",
) -> DataFrame:
    """(scope, needle_id, text_id) for each non-empty needle that lies inside a text. Case must be folded before."""
    scope = list(scope)
    n = needles.select(*scope, needle_id, F.col(needle).alias("_needle")).filter(F.length("_needle") > 0)
    t = texts.select(*scope, text_id, F.col(text).alias("_text"))
    # a needle longer than every text lies in none
    longest = t.groupBy(*scope).agg(F.max(F.length("_text")).alias("_longest"))
    if scope:
        n = n.join(longest, scope).filter(F.length("_needle") <= F.col("_longest")).drop("_longest")
    else:
        n = n.filter(F.length("_needle") <= longest.scalar())
    index = t.select(*scope, text_id, F.explode(F.array_distinct(_words(F.col("_text")))).alias("_word"))
    common = index.groupBy(*scope, "_word").agg(F.count(F.lit(1)).alias("_df"))

    # needles with inner words: anchor on the rarest; an unknown word rules the needle out
    inner = n.select(*scope, needle_id, F.array_distinct(_inner(F.col("_needle"))).alias("_inner"))
    inner = inner.select(*scope, needle_id, F.size("_inner").alias("_n"), F.explode("_inner").alias("_word"))
    rare = (
        inner.join(common, [*scope, "_word"])
        .groupBy(*scope, needle_id, "_n")
        .agg(F.count(F.lit(1)).alias("_known"), F.min(F.struct("_df", "_word")).alias("_m"))
        .filter("_known = _n")
        .select(*scope, needle_id, F.col("_m._word").alias("_word"))
    )

    # needles of one or two pieces: longest piece -> words of the vocabulary that hold it
    loose = n.filter(F.size(_inner(F.col("_needle"))) == 0)
    pieces = loose.select(*scope, needle_id, F.array_max(F.transform(
        _words(F.col("_needle")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))).alias("_p"))
    pieces = pieces.filter("_p.w is not null").select(*scope, needle_id, F.col("_p.w").alias("_piece"))
    keyed = pieces.withColumn("_key", F.substring("_piece", 1, PIECE))
    vocabulary = common.select(*scope, "_word", F.explode(_short_pieces(F.col("_word"))).alias("_key"))
    held = (
        keyed.join(vocabulary, [*scope, "_key"])
        .filter(F.contains("_word", "_piece"))
        .select(*scope, needle_id, "_word").distinct()
    )

    candidates = rare.unionByName(held).join(index, [*scope, "_word"]).select(*scope, needle_id, text_id).distinct()
    hits = (
        candidates.join(n, [*scope, needle_id]).join(t, [*scope, text_id])
        .filter(F.contains("_text", "_needle")).select(*scope, needle_id, text_id)
    )
    # a needle of white space alone has no piece: look at the texts that hold white space
    blank = n.filter(F.trim(F.regexp_replace("_needle", r"\s", " ")) == "")
    spaced = t.filter(F.col("_text").rlike(r"\s"))
    keyed_blank = blank.select(*scope, needle_id, "_needle", F.substring("_needle", 1, 1).alias("_key"))
    spaces = spaced.select(*scope, text_id, "_text", F.explode(
        F.array_distinct(F.regexp_extract_all("_text", F.lit(r"(\s)"), F.lit(1)))).alias("_key"))
    only_blank = keyed_blank.join(spaces, [*scope, "_key"]).filter(
        F.contains("_text", "_needle")).select(*scope, needle_id, text_id)
    return hits.unionByName(only_blank)

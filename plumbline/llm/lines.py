"""Line dedup: range-partitioned line hashes, first occurrences in document order, keep bitmaps per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import content_key, same
from plumbline.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\x0c\r"
WORD_BITS = 63  # lines that one number of a bitmap covers


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def _lines(docs: DataFrame) -> DataFrame:
    """docs with the array of its lines; null and empty texts have one empty line."""
    return docs.withColumn("_lines", F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1))


def dropped_lines(docs: DataFrame, least_chars: int = 10, slices: int = 256) -> DataFrame:
    """Bitmaps of the lines to drop: doc_id, text_key, word (position / 63), bits.

    Only hashes, ids and positions are shuffled, once range-partitioned by hash and document slice and sorted by
    document and position; within a slice the first and last document of a line are read off the sorted stream.
    They combine to the first document of the line and whether it has a second one. A line that a third of all
    documents hold lies in `slices` slices, so it is spread over as many range partitions.
    """
    rows = _lines(docs).select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode("_lines").alias("pos", "line"))
    rows = rows.select("doc_id", "text_key", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    h1, h2 = content_key(F.col("key"))
    rows = rows.select(h1.alias("h1"), h2.alias("h2"), F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int").alias("slice"), "doc_id", "text_key", "pos")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(parts, "h1", "h2", "slice")
    stream = Window.partitionBy("h1", "h2", "slice").orderBy(F.col("doc_id").asc_nulls_last(), "pos", "text_key")
    laid = laid.withColumn("is_first", F.row_number().over(stream) == 1).withColumn("is_last", F.lead("pos").over(stream).isNull())
    laid = cut_lineage(laid, "lines")
    # documents without an id count as one document, after all others
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    ends = laid.where("is_first or is_last").groupBy("h1", "h2").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    shared = ends.where("first <> last and not (first.none and last.none)").select(
        F.col("h1").alias("s1"), F.col("h2").alias("s2"), F.col("first.id").alias("first_doc"))
    found = laid.join(shared, (laid["h1"] == shared["s1"]) & (laid["h2"] == shared["s2"])).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    word, bit = F.floor(F.col("pos") / WORD_BITS).cast("int"), F.col("pos") % WORD_BITS
    return found.groupBy("doc_id", "text_key", word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {WORD_BITS})")).alias("bits"))


def keep_bitmaps(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text_key, drops: per document with lines to drop, the words of its bitmap that are not all ones.

    `drops` maps word number to the bits of the lines that go; every line that is not in it stays, so a document
    takes room only for the stretches of 63 lines in which something goes.
    """
    words = dropped_lines(docs, **options)
    return words.groupBy("doc_id", "text_key").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drops"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs plus _lines, _kept (the lines that stay) and _drops."""
    marks = bitmaps.select(F.col("doc_id").alias("_b_doc"), F.col("text_key").alias("_b_key"), F.col("drops").alias("_drops"))
    keyed = docs.withColumn("_text_key", F.xxhash64("text"))
    out = _lines(keyed.join(marks, same(keyed, marks, ["doc_id", "_text_key"], ["_b_doc", "_b_key"]), "left"))
    stays = F.filter("_lines", lambda line, i: F.coalesce(F.expr("1").cast("long").bitwiseAND(
        F.call_function("shiftright", F.element_at("_drops", F.floor(i / WORD_BITS).cast("int")), i % WORD_BITS)) == 0, F.lit(True)))
    out = out.withColumn("_kept", F.when(F.col("_drops").isNull(), F.col("_lines")).otherwise(stays))
    return out.drop("_b_doc", "_b_key", "_text_key")


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every row of `docs`.

    A line goes if its key (stripped, A-Z lower-cased) has `least_chars` code points or more and a document with a
    smaller id holds it too; the first document keeps all of its copies. Null and empty texts are one empty line,
    which stays. Rows with one doc_id are one document; rows without an id are one document, the last. Other
    columns are not read.
    """
    out = apply_bitmaps(docs.select("doc_id", "text"), keep_bitmaps(docs, **options))
    return out.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
                      F.array_join("_kept", "\n").alias("kept_text"))


def without_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """`docs` with the lines dropped from its texts, n_chars counted anew where the column is there; null texts stay null."""
    names = docs.columns
    out = apply_bitmaps(docs, keep_bitmaps(docs, **options))
    out = out.withColumn("text", F.when(F.col("_drops").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("_drops").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*names)


DEDUP_SQL = r"""
with lines as (
  select doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from {table}),
keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines),
firsts as (
  select k, min(doc_id) as first_doc from keyed where length(k) >= 10 group by k having count(distinct doc_id) >= 2),
judged as (
  select keyed.*, firsts.first_doc is not null and keyed.doc_id > firsts.first_doc as gone from keyed left join firsts using (k)),
kept as (
  select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
         coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as kept_text
  from judged group by doc_id)
"""

"""The corpus operators as queries on the given tables, with their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import bpe, divergence, filters, lines, mixing, pages, pieces, quality, sharding, simhash, tokens, toxicity, vectors
from plumbline.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_verdicts(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality.STATS, "base_failed", "kept", "d2")


@query()
def op2_cosine_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


@query()
def op3_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("text_key", F.xxhash64("text"))
    out = pieces.decode_pieces(pieces.sample_pieces(docs).withColumn("n_pieces", F.size("ids").cast("long")))
    return out.select("doc_id", "n_pieces", "ids_crc32", F.char_length("text").cast("long").alias("n_decoded"),
                      (F.xxhash64("text") == F.col("text_key")).alias("lossless"))


@query()
def op4_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op5_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.longest_first_shards(_table(spark, sf_dir, "documents"))


@query()
def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query()
def op7_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(_table(spark, sf_dir, "documents"), path)
    return tokens.token_index(spark, path)


@query(lines.DEDUP_SQL.format(table="documents") + "select doc_id, n_lines, n_dropped, sha256(kept_text) as kept_sha256 from kept")
def op8_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


@query("with " + mixing.MIX_SQL.format(table="documents") + "select doc_id, text, lang, source, n_chars, copy, md5('mix:order:' || coalesce(doc_id::varchar, 'none') || ':' || copy) as mix_order from mixed")
def op9_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("_copy", "copy").withColumnRenamed("_order", "mix_order")


@query()
def op10_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.extract_main_text(_table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


@query(divergence.AUDIT_SQL)
def op11_source_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, sf_dir, "documents"))


@query()
def op12_two_tier_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.decode_bytes(bpe.encode_bytes(_table(spark, sf_dir, "documents")))
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(joined, "UTF-8"), 256).alias("ids_sha256"),
                      F.sha2("raw", 256).alias("decoded_sha256"))


@query(filters.AUDIT_SQL)
def op13_filter_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))

"""Corpus pipeline: quality rules, line dedup, near-duplicates, mixing of sources, sampled pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import lines, mixing, pieces, quality, simhash
from plumbline.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near the robust estimate of their language and source.

    Null and empty texts have no words and go; null languages and sources are groups of their own; repeated rows
    share one verdict; an empty table gives an empty one.
    """
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document with a smaller id holds.

    Every row stays; a null or empty text is one empty line, and a text may become empty. Lines of fewer than ten code
    points stay.
    """
    return lines.without_repeated_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id: five-word shingles, Jaccard of 0.8 or more.

    All null and empty texts are one group; texts of fewer than five words are one shingle; repeated rows count once.
    """
    return simhash.one_of_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated at their source's rate, in random order.

    Null sources are one source, null ids have one draw; a text is not looked at; columns stay as they are.
    """
    return mixing.mix_sources(docs).select(*docs.columns)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars and the ids of a sampled segmentation of each text: null for null, none for an empty one."""
    return pieces.sample_pieces(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("simhash near-dedup", simhash_dedup),
          ("mixing sources", mix_sources), ("sampled pieces", sample_pieces)]

#: The determinant estimates and the sampler have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns the columns of
documents, the last one the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, line_dedup, mixing, packing, simhash
from tidemark.llm.common import cleared, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose language is unknown or told apart from none; all stay where no language is known."""
    return language.accepted(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that match an earlier one; n_chars follows the text. A document may be left empty."""
    left = line_dedup.dedup_lines(docs, min_words=line_dedup.EVERY_LINE)
    return left.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, with their sequences and places."""
    return packing.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mixing", mixing_to_weights),
    ("best_fit_packing", best_fit_packing),
]
#: SQL cannot express the trained stages and the fingerprints; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; each stage's result is written as Parquet and read again by the next one.

    The stages' tables stay in the folder that spark.checkpoint.dir names; all others that stages write on their way are
    deleted when the stage's table is written. A null or empty text is rejected by the
    first stage where any language is known; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with cleared(spark) as kept:
            docs = stored(stage(spark, docs, sf_dir))
            kept.append(docs)
    return docs

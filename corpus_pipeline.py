"""A corpus pipeline: quality rules, near-duplicates, secrets, mixture and packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the one before it kept; a
caller writes what a stage returns and reads it again as the next stage's ``docs``. All stages but
the last return the columns of ``docs``, extra ones of any name included. An empty table gives no rows,
and texts are taken whole at any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stemloom.llm import mixing, packing, quality, secret_scan, similar
from stemloom.scratch import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go.

    A null or empty text breaks one. Each row is judged alone: there are no ties, repeated rows go or
    stay together, and nulls in other columns change nothing."""
    return quality.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 or more of their five-word shingles) the document with the smallest id stays.

    Texts without words, null included, are one group. Of rows that repeat an id one stays in each group:
    of unequal ones that whose columns have the least hash. Rows without an id all stay."""
    return similar.one_of_each(docs, words=5, least=0.8)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays.

    A null text stays null. Overlapping and touching secrets become one mark. Each row is taken alone."""
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens have the target mixture.

    Null sources and languages are values of their own; a null text has no tokens, and cells without tokens
    stay whole. Rows of equal ids, null included, are kept or left out together. Ties in a cell's ratio go by its values."""
    return mixing.sampled(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as pieces of sequences, with the ids of each.

    A null or empty text is its end id alone, and a null source a queue of its own. Repeated rows and ids are
    packed each by itself; every row has its own place, so there are no ties."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: Fingerprints and token ids are beyond SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Exact length histogram of encoded documents, and what it answers for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemloom.llm.tokenizing import default_vocabulary, encoder
from stemloom.scratch import Scratch

#: Lengths whose sums are first made on their own, so that no task sees more than so many of them.
BLOCK = 1024


def token_histogram(docs: DataFrame, vocabulary: str | None = None, extra: int = 0, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length, counted over whole texts.

    extra: tokens that framing adds to every document. Null texts have no tokens of their own.
    Each batch sends one row per length; the exchange holds at most (tasks x distinct lengths) rows."""
    path = vocabulary or default_vocabulary()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            sizes = np.array([len(x) for x in coder.encode(batch.column(0).to_pylist())], np.int64) // coder.dtype.itemsize + extra
            values, counts = np.unique(sizes, return_counts=True)
            yield pa.record_batch([pa.array(values), pa.array(counts.astype(np.int64))], names=["n_tokens", "n_docs"])

    found = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(lengths, "n_tokens long, n_docs long")
    return found.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def length_answers(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, as a context limit: documents and tokens from it up and below
    it, the share of documents up to it, and the tokens left when every document is cut to it.

    Suffix sums in two steps: of blocks of lengths, then inside each block. Between two lengths
    that occur the answers for any limit follow from the next longer one (``answers_at``)."""
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    h = h.withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    # One row a block of lengths: (longest document / BLOCK) rows at most, whatever the corpus's size.
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(after), zero).alias("d_after"), F.coalesce(F.sum("t").over(after), zero).alias("t_after"),
        F.sum("d").over(totals).alias("all_docs"), F.sum("t").over(totals).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    h = h.join(blocks, "block")
    docs_from, tokens_from = F.sum("n_docs").over(inside) + F.col("d_after"), F.sum("tokens").over(inside) + F.col("t_after")
    h = h.select("n_tokens", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), "all_docs", "all_tokens")
    longer = F.col("docs_from") - F.col("n_docs")
    return h.select(
        "n_tokens", "n_docs", "docs_from", "tokens_from",
        longer.alias("docs_longer"),
        (F.col("all_docs") - longer).alias("docs_upto"),
        (F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("tokens_cut"),
        "all_docs", "all_tokens",
    )


def answers_at(answers: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_longer, tokens_cut, all_docs, all_tokens) for any limits, also ones that no document has.

    For a limit L with next longer occurring length m: documents longer than L are those from m
    up, and cutting leaves all tokens below m and L of each from m up. ``limits`` is the caller's list."""
    # Each row is met with the caller's own list of limits, and reduced at once.
    listed = F.array(*(F.lit(int(x)).cast("long") for x in limits)) if limits else F.array().cast("array<long>")
    met = answers.withColumn("limit", F.explode(listed))
    next_ = F.min_by(F.struct("docs_from", "tokens_from"), F.when(F.col("n_tokens") > F.col("limit"), F.col("n_tokens")))
    got = met.groupBy("limit").agg(next_.alias("m"), F.max("all_docs").alias("all_docs"), F.max("all_tokens").alias("all_tokens"))
    zero = F.lit(0).cast("long")
    docs, tokens = F.coalesce("m.docs_from", zero), F.coalesce("m.tokens_from", zero)
    return got.select("limit", docs.alias("docs_longer"), (F.col("all_tokens") - tokens + F.col("limit") * docs).alias("tokens_cut"), "all_docs", "all_tokens")


def quantile(answers: DataFrame, q: float) -> DataFrame:
    """One row: the shortest length that at least the share ``q`` of the documents do not exceed."""
    return answers.where(F.col("docs_upto") >= F.ceil(F.lit(q) * F.col("all_docs"))).agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, vocabulary: str | None = None, extra: int = 0) -> DataFrame:
    """The answers for a corpus. Null and empty texts have length ``extra``; repeated rows count
    each; ties share a row; other columns are not read; an empty table gives no rows."""
    scratch = Scratch(docs.sparkSession, "lengths")
    return length_answers(scratch.write(token_histogram(docs, vocabulary, extra), "histogram"))


def lengths_query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Exact histogram of documents' encoded lengths, and what its suffix sums answer for every context limit.

A document's length is its number of ids under a public vocabulary; a null or empty text has length 0. Documents are
aggregated by length, so what is shuffled is at most one row a task and length, and the table has as many rows as there
are distinct lengths. Suffix sums run in two levels, inside blocks of lengths and over the blocks' totals. Repeated rows
count each time; an empty table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewright.llm.library import LibraryEncoder
from tidewright.llm.scratch import Scratch
from tidewright.llm.textkit import slices
from tidewright.llm.vocab import default_path

#: Lengths in a block of the suffix sums.
BLOCK = 1024


def lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens."""
    path = path or default_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = LibraryEncoder(path)
        for batch, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in encode([t or "" for t in texts])], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def histogram(measured: DataFrame) -> DataFrame:
    """One row a length that occurs. For the context limit `n_tokens`:

    docs, tokens         documents of just this length, and their tokens
    docs_over, tokens_over   documents that are longer, and their tokens
    docs_within          documents that fit
    truncated_tokens     tokens left when every document is cut to the limit
    lost_tokens          tokens that this cuts off
    quantile             share of all documents that fit
    """
    counted = measured.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs")).withColumn("tokens", F.col("docs") * F.col("n_tokens")).withColumn("_block", F.floor(F.col("n_tokens") / BLOCK))
    counted = Scratch(measured.sparkSession, "lengths").keep(counted, "counted")  # read twice below; texts are encoded once
    above = W.orderBy(F.col("_block").desc()).rowsBetween(W.unboundedPreceding, -1)
    blocks = counted.groupBy("_block").agg(F.sum("docs").alias("_d"), F.sum("tokens").alias("_t"))
    blocks = blocks.select("_block", F.coalesce(F.sum("_d").over(above), F.lit(0)).alias("_docs_above"), F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_tokens_above"), F.sum("_d").over(W.partitionBy()).alias("_all_docs"), F.sum("_t").over(W.partitionBy()).alias("_all_tokens"))
    after = W.partitionBy("_block").orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, -1)
    over = counted.withColumn("_d", F.coalesce(F.sum("docs").over(after), F.lit(0))).withColumn("_t", F.coalesce(F.sum("tokens").over(after), F.lit(0))).join(blocks, "_block")
    docs_over, tokens_over = F.col("_d") + F.col("_docs_above"), F.col("_t") + F.col("_tokens_above")
    lost = tokens_over - docs_over * F.col("n_tokens")
    return over.select(
        "n_tokens",
        "docs",
        "tokens",
        docs_over.alias("docs_over"),
        tokens_over.alias("tokens_over"),
        (F.col("_all_docs") - docs_over).alias("docs_within"),
        (F.col("_all_tokens") - lost).alias("truncated_tokens"),
        lost.alias("lost_tokens"),
        ((F.col("_all_docs") - docs_over) / F.col("_all_docs")).alias("quantile"),
    )


def answer(hist: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_within, truncated_tokens, lost_tokens of any limits, whether or not a document has that length."""
    spread = hist.select(F.explode(F.array(*[F.lit(int(x)) for x in limits])).alias("context_limit"), "n_tokens", "docs", "tokens")
    kept = F.least(F.col("n_tokens"), F.col("context_limit")) * F.col("docs")
    return spread.groupBy("context_limit").agg(
        F.sum(F.when(F.col("n_tokens") <= F.col("context_limit"), F.col("docs")).otherwise(0)).alias("docs_within"), F.sum(kept).alias("truncated_tokens"), F.sum(F.col("tokens") - kept).alias("lost_tokens")
    )


def quantile_length(hist: DataFrame, share: float) -> DataFrame:
    """n_tokens: the shortest length that at least `share` of the documents do not exceed."""
    return hist.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))

"""Exact token counts by a histogram of encoded lengths.

Documents are encoded once and summed up by length, so that all later questions are answered
from the histogram: one row per distinct length, at most the square root of twice the token
total of them. Suffix sums over it give, for every context limit, the documents and tokens at
or above it and the tokens that remain when all documents are cut to it.

Null and empty texts have length 0. Repeated rows count as often as they come. An empty table
has an empty histogram. Texts are encoded whole, however long. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import stored
from strandloom.llm.tokens import encoder, vocabulary_path


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = encoder(path).encode(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([len(c) // 4 for c in coded], pa.int64())], ["length"])

    return run


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(length, n_docs)."""
    lengths = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_lengths(vocabulary or vocabulary_path()), "length long")
    return lengths.groupBy("length").agg(F.count("*").alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """Per distinct length L: totals below and from L on, the tokens kept at a limit of L, and the quantile that L is."""
    n, total = F.col("n_docs"), F.col("n_docs") * F.col("length")
    # Sums within ranges of lengths, set off by the sums of the ranges before: one row per range meets in one task.
    parts = int(histogram.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(histogram.repartitionByRange(parts, "length").withColumn("part", F.spark_partition_id()), "lengths")
    sums = ranged.groupBy("part").agg(F.sum(n).alias("docs"), F.sum(total).alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    sums = sums.select("part", *(x for c in ("docs", "tokens") for x in (F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before"), F.sum(c).over(every).alias(f"{c}_all"))))
    up = Window.partitionBy("part").orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(F.broadcast(sums), "part").select("*", (F.sum(n).over(up) + F.col("docs_before")).alias("docs_to"), (F.sum(total).over(up) + F.col("tokens_before")).alias("tokens_to"))
    out = out.select("length", "n_docs", "docs_to", "tokens_to", (F.col("docs_all") - F.col("docs_to") + n).alias("docs_from"), (F.col("tokens_all") - F.col("tokens_to") + total).alias("tokens_from"))
    whole = F.col("docs_to") + F.col("docs_from") - n
    return out.select(
        "*",
        (F.col("tokens_to") - total + F.col("docs_from") * F.col("length")).alias("tokens_kept"),
        (F.col("tokens_from") - F.col("docs_from") * F.col("length")).alias("tokens_cut"),
        (F.col("docs_to") / whole).alias("quantile"),
    )


def tokens_at_limit(histogram: DataFrame, limit: int) -> DataFrame:
    """n_docs, tokens and tokens_kept at any limit, also one that no document has."""
    n, length = F.col("n_docs"), F.col("length")
    return histogram.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n_docs"), F.coalesce(F.sum(n * length), F.lit(0)).alias("tokens"), F.coalesce(F.sum(n * F.least(length, F.lit(limit))), F.lit(0)).alias("tokens_kept"))


def length_quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The least length that a share ``q`` of the documents does not exceed."""
    return context_limits(histogram).filter(F.col("quantile") >= q).agg(F.min("length").alias("length"))

"""The corpus pipeline: quality rules, toxicity, near-duplicates, decontamination, packing.

Each stage takes all rows that its predecessor kept, and is written and read again as Parquet;
all but the last return the columns of ``documents``. Duplicates and contaminated texts go by
doc_id: rows that share one go together, and rows without one are kept, as no group can be
represented by them. Null and empty texts fail the quality rules; repeated rows that pass stay repeated.
Empty tables give empty results. Other columns, of any name, come out as they went in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import stored, table
from strandloom.llm.decontaminate import decontaminate
from strandloom.llm.packing import best_fit_packing
from strandloom.llm.quality import quality_rules
from strandloom.llm.simhash import near_duplicates
from strandloom.llm.toxicity import accepted, held_out, train


def columns_of(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    verdict = "_" * (1 + max(map(len, docs.columns)))  # longer than any name, so none is replaced
    return quality_rules(docs, name=verdict).filter(F.col(verdict)["kept"]).select(columns_of(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return accepted(docs, model)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rejected = near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(columns_of(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rejected = decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(columns_of(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs)


STAGES = [
    ("quality_rules", quality),
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicate_groups),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: The classifier and the packing are not expressible in SQL; tests hold the decisions of each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: toxicity, fuzzy line dedup, MinHash near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next one's documents. All but the last keep the columns of
documents. Of rows with one id and text the near-duplicate stage keeps one; documents without
words pass every stage and are packed as their end id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodegraph.llm import decontaminate, line_dedup, near_dup, packing, toxicity
from lodegraph.llm.runtime import Scratch, closing

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", near_dup.stage),
    ("decontamination", decontaminate.stage),
    ("packing", packing.stage),
]

#: Fitting a classifier, MinHash and tokenizing have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; tables of a finished stage are deleted."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with closing(spark):
            found = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = found
    return docs

"""The corpus pipeline: each stage works on what the one before kept, written as Parquet between them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import best_fit, decontaminate, quality_rules, simhash, toxicity
from tidemark.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the divergence rule; references are those of ``docs``."""
    return quality_rules.accepted(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the toxicity threshold; labels are learned as in op10."""
    learn = ~(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2)
    model = toxicity.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), learn)
    return toxicity.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each group of linked fingerprints."""
    return simhash.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that overlap no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, placed in sequences of 4096 tokens."""
    return best_fit.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("quality_rules", quality), ("toxicity", toxic), ("simhash_near_dedup", near_duplicates), ("decontamination", decontaminated), ("best_fit_packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

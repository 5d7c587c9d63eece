"""The corpus pipeline: five stages over documents, each written and read again as the next one's input.

run(spark, sf_dir) applies all stages to the documents table. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sextant.llm import bpe, decontaminate, line_dedup, quality, simhash
from sextant.llm.common import ensure_checkpoint_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their group's robust estimate reject go."""
    return quality.drop_low_quality(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of lines go; documents stay, with n_chars of their new text."""
    from pyspark.sql import functions as F

    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests, ids and decoded text of each document."""
    return bpe.encode_texts(docs, bpe.default_spec())


STAGES = [
    ("quality", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("encode", encode),
]

#: The stages aren't SQL (robust estimates, fingerprints, BPE); tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}-{name}")
        docs = spark.read.parquet(f"{at}/{i}-{name}")
    return docs

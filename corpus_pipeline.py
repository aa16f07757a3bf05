"""The corpus pipeline: stages that each read what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import byte_bpe, mixing, near_duplicates, substring_dedup, toxicity
from tagloom.llm.common import checkpointed

#: Each takes (spark, docs, sf_dir). All but the last return the columns of documents.
STAGES = [
    ("toxicity", toxicity.sound),
    ("near_dedup", near_duplicates.one_of_each),
    ("substring_dedup", substring_dedup.cleaned),
    ("mixing", mixing.taken),
    ("byte_bpe", byte_bpe.tokenised),
]

#: The classifier and the random choices can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the checkpoint folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs

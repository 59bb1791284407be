"""The corpus pipeline: documents through five stages, each one of the operators in lodeworks.llm.

Each stage takes all that the one before it kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeworks.llm import stages

STAGES = [
    ("quality rules", stages.quality_rules),
    ("exact dedup", stages.exact_duplicates),
    ("SimHash near-dedup", stages.near_duplicates),
    ("mixing sources to target weights", stages.mix_sources),
    ("SentencePiece encoding and decoding", stages.encode_pieces),
]

#: SQL can express neither the near-duplicate search nor the piece encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir."""
    return stages.run(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir, STAGES)

"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir), works on all rows of docs, and gives a frame with
the columns of docs, whatever their names; the last adds its own.

Nulls, empty tables and repeated rows have the results that each operator's docstring gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, mixing, quality, sentencepiece_codec, shared, simhash
from .text import free_name, whole

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _apart(docs: DataFrame, made: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs) with the columns of docs alone; those with the names that work makes are kept under others meanwhile."""
    other = {c: free_name(docs, f"_own_{c}") for c in docs.columns if c.lower() in made}
    out = work(docs.withColumnsRenamed(other))
    return out.select(*[F.col(other.get(c, c)).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the latest policy of the rule ledger keeps."""
    held = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text"))
    return quality.decide(quality.ledger(held)).where("kept").select("doc.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the most code points, then the least doc_id."""
    return exact_dedup.keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near texts (five words, a similarity of 0.8): the longest, then the least
    doc_id."""
    with shared.small_batches(spark):  # all of its Python runs in here
        return _apart(docs, ("near_of", "near_row"), lambda own: simhash.near_duplicates(own).where("near_of = near_row"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights by the square root of their size, rows repeated by Poisson counts, shuffled."""
    return _apart(docs, ("copy", "copies"), mixing.mix)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces (ids), and whether decoding them gives the text (same)."""
    out = sentencepiece_codec.encode(docs)
    return out.withColumn("same", F.col("decoded") == whole()).drop("decoded", "log_score")


def run(spark: SparkSession, docs: DataFrame, sf_dir: str, stages: list[tuple[str, Stage]]) -> DataFrame:
    """The stages, one after the other, each from the written result of the one before; the tables of a stage are
    deleted when its result is written."""
    before = None
    for k, (_, stage) in enumerate(stages[:-1]):
        with shared.scope() as kept:
            out = shared.written(stage(spark, docs, sf_dir).select(*docs.columns), f"stage-{k}")
            kept.append(out)
        if before is not None:
            shared.drop(before)
        docs = before = out
    return stages[-1][1](spark, docs, sf_dir)

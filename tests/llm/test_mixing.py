from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeworks.llm import mixing


@pytest.fixture(scope="module")
def many(spark):
    # One source holds two thirds of all rows.
    return spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 > 0, "big").when(F.col("id") % 9 == 0, "small").otherwise("mid").alias("source"))


def test_weights_are_met(many):
    got = Counter({r.source: r.n for r in mixing.mix(many, {"big": 1, "small": 1, "mid": 2}, size=20_000).groupBy("source").agg(F.count("*").alias("n")).collect()})
    assert abs(got["big"] - 5000) < 300 and abs(got["small"] - 5000) < 300 and abs(got["mid"] - 10_000) < 500


def test_poisson_shape_and_repeatability(many):
    a = mixing.mix(many, power=1.0)
    copies = Counter(r.copies for r in a.where("copy = 1").collect())
    assert abs(copies[1] / 9000 - 0.3679) < 0.02 and abs(copies[2] / 9000 - 0.1839) < 0.02
    assert {(r.doc_id, r.copy) for r in a.collect()} == {(r.doc_id, r.copy) for r in mixing.mix(many.repartition(7), power=1.0).collect()}


def test_large_means_do_not_underflow(spark):
    one = spark.createDataFrame([(1, "t", "x")], "doc_id long, text string, source string")
    assert abs(mixing.mix(one, size=5000).count() - 5000) < 300


def test_hard_inputs(docs, no_docs):
    out = mixing.mix(docs, size=50)
    assert set(docs.columns) <= set(out.columns) and out.where("source IS NULL").count() > 0
    assert mixing.mix(no_docs).count() == 0


def test_join_beyond_the_broadcast_bound(many, monkeypatch):
    want = sorted((r.doc_id, r.copy) for r in mixing.mix(many).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted((r.doc_id, r.copy) for r in mixing.mix(many).collect()) == want


def test_rows_without_an_id_draw_by_text_and_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.lit("x").alias("source"))
    out = mixing.mix(df)
    assert abs(out.count() - 4000) < 300 and max(r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 1600
    same = mixing.mix(df.withColumn("text", F.lit("t")).coalesce(1), size=8000)
    assert max(r.n for r in same.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 0.5 * max(1, same.count()) + 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

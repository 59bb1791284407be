"""Mixing sources to target weights by Poisson replication.

A source with n rows, of N, and target weight w gets the mean repetition rate w * size / n, where size is the
wanted number of rows (N by default). Each document is then repeated as often as an inverse Poisson
distribution with that mean says at a uniform number hashed from the seed and its doc_id (its text, where that is
null): the same for every run, order and cluster, and independent of the other rows. The copies are shuffled globally by another hash.

Means over CHUNK are drawn as sums of smaller Poisson numbers, so no term underflows. Only Spark's own
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .text import free_name, whole

#: Largest mean of one draw; TERMS of its distribution reach beyond 1 - 2 ** -53.
CHUNK, TERMS = 16.0, 96
#: Up to so many sources their table is broadcast (about 1 KB each); beyond it is joined, salted.
BROADCAST_SOURCES, SALTS = 10_000, 64


def uniform(*parts: Column) -> Column:
    """In [0, 1), from 52 bits of the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])), 1, 13), 16, 10).cast("double") / float(2**52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, size: int | None = None) -> DataFrame:
    """source, n, rate (mean copies of a row), draws, cdf (of one draw).

    weights: by source, in any unit; sources it doesn't name get none. Without it a source weighs n ** power.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        given = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "source string, w double")
        counts = counts.withColumnRenamed("source", "s").join(given, F.col("s").eqNullSafe(F.col("source")), "left").select(F.col("s").alias("source"), "n", F.coalesce("w", F.lit(0.0)).alias("w"))
        weight = F.col("w")
    counts = shared.written(counts.withColumn("w", weight), "counts")
    all_w, all_n = counts.agg(F.sum("w"), F.sum("n")).first()  # one row
    wanted = float(all_n or 0 if size is None else size)
    rate = F.col("w") / F.lit(all_w) * F.lit(wanted) / F.col("n") if all_w else F.lit(0.0)
    table = counts.select("source", "n", rate.alias("rate"))
    table = table.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / CHUNK).cast("int"))).withColumn("mean", F.col("rate") / F.col("draws"))
    first = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("c"))

    def grow(a: Column, k: Column) -> Column:
        p = a["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + p)).alias("c"))

    return table.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, grow)["c"])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, size: int | None = None, seed: str = "mix-1") -> DataFrame:
    """docs, each row as often as drawn, in a global random order, with copy (1, 2, ...) and copies.

    Columns named copy or copies are replaced; others stay. A null source is a source of its own. Rows of a source
    with equal doc_id draw alike, and so do rows without one that have equal texts; but the latter are dealt by their
    place in the input, so that many of them don't meet in one partition. Texts may be null, empty or of any length.
    An empty docs stays so.
    """
    docs = docs.drop("copy", "copies")
    table = shared.written(rates(docs, weights, power, size), "rates")
    s, d, c, salt, order, place = (free_name(docs, f"_{x}") for x in ("source", "draws", "cdf", "salt", "order", "place"))
    docs = docs.withColumn(place, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    drawn_by = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(whole().cast("binary"))))
    table = table.select(F.col("source").alias(s), F.col("draws").alias(d), F.col("cdf").alias(c))
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(table), F.col("source").eqNullSafe(F.col(s)))
    else:
        table = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        docs = docs.withColumn(salt, F.pmod(F.xxhash64("doc_id", place), F.lit(SALTS)).cast("int"))
        joined = docs.join(table, F.col("source").eqNullSafe(F.col(s)) & (docs[salt] == table[salt])).drop(salt)
    draws = F.transform(F.sequence(F.lit(1), F.col(d)), lambda j: uniform(F.lit(seed), drawn_by, j))
    times = F.aggregate(draws, F.lit(0), lambda a, x: a + F.size(F.filter(F.col(c), lambda y: y <= x)))
    numbers = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array().cast("array<int>"))
    many = joined.withColumn("copies", times).drop(s, d, c).withColumn("copy", F.explode(numbers))
    # The order hashes every copy on its own, so no partition follows a source or the input.
    return many.withColumn(order, F.xxhash64(F.lit(seed), F.lit("order"), "doc_id", "copy", place)).repartition(order).sortWithinPartitions(order).drop(order, place)


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n, sqrt(CAST(count(*) AS DOUBLE)) AS w FROM documents GROUP BY source),
r AS (SELECT source, w / (SELECT sum(w) FROM n) * CAST((SELECT sum(n) FROM n) AS DOUBLE) / n AS rate FROM n),
d AS (SELECT source, greatest(1, CAST(ceil(rate / 16.0) AS INTEGER)) AS draws, rate / greatest(1, CAST(ceil(rate / 16.0) AS INTEGER)) AS mean FROM r),
c AS (SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf FROM d
      UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM c WHERE k < 96),
e AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, ''))) AS drawn_by FROM documents),
u AS (SELECT drawn_by, source, j, CAST(CAST('0x' || substr(md5('mix-1:' || drawn_by || ':' || j), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
      FROM (SELECT drawn_by, source, unnest(range(1, draws + 1)) AS j FROM (SELECT DISTINCT drawn_by, e.source, draws FROM e JOIN d ON e.source IS NOT DISTINCT FROM d.source))),
t AS (SELECT drawn_by, u.source, count(c.k) AS copies FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf <= u.u GROUP BY ALL)
SELECT e.* EXCLUDE (drawn_by), CAST(copies AS INTEGER) AS copies, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy
FROM e JOIN t ON e.drawn_by = t.drawn_by AND e.source IS NOT DISTINCT FROM t.source
"""

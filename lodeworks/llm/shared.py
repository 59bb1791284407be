"""Tables in the folder that the driver and all executors share.

What an operator returns still reads some of its tables, so they stay until the caller has used the result:
`scope` deletes what was written inside it, and `clear` all that this process has written.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Only on one machine, and only where neither the cluster nor the caller has named a folder, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints"
#: Tables that this process has written and not deleted.
_written: list[DataFrame] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or else the context's checkpoint folder, or else, on one machine, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(LOCAL_FOLDER)
    return LOCAL_FOLDER


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df after a round trip through Parquet in the shared folder.

    This cuts lineage: what reads the result never runs df again, whichever executors are lost.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    fields = [f for f in df.schema if f.name not in partition_by] + [df.schema[c] for c in partition_by]
    out = spark.read.schema(type(df.schema)(fields)).parquet(path)
    out.shared_path = path
    _written.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that `written` returned, once whatever reads them has itself been written."""
    for df in tables:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.shared_path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        _written[:] = [x for x in _written if x is not df]


def release(spark: SparkSession) -> None:
    """Has the driver's JVM collect garbage, upon which Spark deletes the shuffle files that nothing refers to. Some of
    them are found only by a second collection, when the first has been worked off."""
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, size: int = 2 << 20) -> Iterator[None]:
    """What is written inside it reaches Python in batches of about so many bytes, not of 10,000 whole texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def scope(*keep: DataFrame) -> Iterator[list[DataFrame]]:
    """Deletes at its end all tables written inside it, but for those in the list that it gives."""
    before = list(_written)
    kept = list(keep)
    try:
        yield kept
    finally:
        drop(*(x for x in list(_written) if not any(x is y for y in (*before, *kept))))


def clear() -> None:
    """Deletes all tables that this process has written: results that read them can't be used any more."""
    drop(*list(_written))

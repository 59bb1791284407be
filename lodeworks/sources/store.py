"""Versioned state tables and the monthly archive, on any file system that Spark writes to."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state as S
from ..plans import report

TABLES = {"listings": S.LISTINGS, "content": S.CONTENT, "health": S.HEALTH, "projects": S.PROJECTS}


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _current(spark: SparkSession, root: str) -> str | None:
    p, fs = _fs(spark, f"{root}/current")
    return spark.read.text(f"{root}/current").first()[0] if fs.exists(p) else None


def load_state(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The four tables of the current version; empty ones where there is none."""
    version = _current(spark, root)
    out = {}
    for name, schema in TABLES.items():
        path = f"{root}/{version}/{name}"
        p, fs = _fs(spark, path)
        out[name] = spark.read.schema(schema).parquet(path) if version and fs.exists(p) else spark.createDataFrame([], schema)
    return out


def save_state(tables: dict[str, DataFrame], root: str) -> str:
    """Writes a new version beside the one being read, then points to it; returns its name."""
    spark = next(iter(tables.values())).sparkSession
    version = f"v-{uuid.uuid4().hex}"
    for name in TABLES:
        tables[name].write.parquet(f"{root}/{version}/{name}")
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/current")
    return version


def import_json(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """State kept as one JSON document: buckets by key, or (older) a bare mapping of listings."""
    data = json.loads(text)
    if not isinstance(data, dict):
        data = {}
    if data and not any(k in data for k in ("listings", "content_seen", "portal_health", "projects")):
        data = {"listings": data}
    keys = {"listings": ("listings", "id"), "content": ("content_seen", "fingerprint"), "health": ("portal_health", "portal"), "projects": ("projects", "slug")}
    out = {}
    for name, (bucket, key) in keys.items():
        rows = [json.dumps({**v, key: k}) for k, v in (data.get(bucket) or {}).items()]
        raw = spark.createDataFrame([(r,) for r in rows], "j string")
        out[name] = raw.select(F.from_json("j", TABLES[name]).alias("r")).select("r.*")
    return out


def append_archive(items: DataFrame, root: str, day: str) -> None:
    """Appends the matches of a day to the archive, partitioned by month; nothing is written for no matches."""
    rows = report.ranked(items).select(F.lit(day).alias("logged"), "rank", report.archive_row(F.lit(day)).alias("row"), F.lit(day[:7]).alias("month"))
    if not rows.isEmpty():
        rows.write.mode("append").partitionBy("month").parquet(root)


def archive_page(spark: SparkSession, root: str, month: str) -> str:
    """One month of the archive as a document: header, then its rows in order."""
    rows = spark.read.parquet(root).where(F.col("month") == month).orderBy("logged", "rank").select("row").toLocalIterator()
    return "\n".join([f"# Matches {month}", "", report.ARCHIVE_HEADER, *(r[0] for r in rows), ""])

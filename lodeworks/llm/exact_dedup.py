"""Exact duplicates through an extendible-hash index kept in shared files.

1. Each task of the scan chains the texts of its own split: rows whose key and bytes are equal fold into one
   entry with their best row and their number. The entries (with their bytes) and one small row for each
   document are written to the shared folder. However hot a text is, it reaches the index once for each task.
2. Keys are counted, without bytes. An entry alone with its key is its own group; the others go to the index.
3. The directory: their entries are counted by the first bits of their keys (at most 2 ** MAX_DEPTH counts,
   whatever the input), and the directory doubles until no bucket holds more than `bucket_entries`, or its
   bits are used up.
4. Each owner task takes a bucket, which is a range of keys, in key order. Entries with one key form a chain;
   their bytes are compared, so texts that only share a key stay apart.
5. Each document's row then meets the verdict on its entry.

A task holds the chain of one key, or what its own split has gathered up to `split_bytes` (what is beyond
that is flushed, which costs another entry, never a wrong result).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .text import free_name, squeezed, whole

MAX_DEPTH = 16
#: Keys of several entries are broadcast up to this number (8 bytes each); more are joined.
BROADCAST_KEYS = 1_000_000
LAST = 2**63 - 1  # stands for a null doc_id: it comes last in ties

_PARTS = pa.schema([("entry", pa.int64()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.string()), ("key", pa.int64()), ("n_chars", pa.int64()), ("rows", pa.int64()), ("body", pa.binary()), ("is_entry", pa.bool_())])
_PARTS_DDL = "entry long, uid long, doc_id long, sha string, key long, n_chars long, rows long, body binary, is_entry boolean"
_FOUND = pa.schema([("entry", pa.int64()), ("keep_uid", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _better(a: tuple, b: tuple) -> tuple:
    """Of two rows (n_chars, doc_id, uid): more code points, then the smaller doc_id, then the earlier row."""
    return min(a, b, key=lambda x: (-x[0], LAST if x[1] is None else x[1], x[2]))


def _chain_split(split_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 38  # entries are numbered within the task
        entry = base
        chains: dict[int, list[list]] = {}  # key -> [entry, best row, rows, bytes, sha]
        held = 0

        def flush():
            kept = [(k, e) for k, es in chains.items() for e in es]
            for i in range(0, len(kept), 1000):
                part = kept[i : i + 1000]
                best = [e[1] for _, e in part]
                cols = [[e[0] for _, e in part], [b[2] for b in best], [b[1] for b in best], [e[4] for _, e in part], [k for k, _ in part], [b[0] for b in best], [e[2] for _, e in part], [e[3] for _, e in part], [True] * len(part)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PARTS.types, strict=True)], schema=_PARTS)
            chains.clear()

        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 500):
                batch = whole_batch.slice(at, 500)
                doc_ids, shas, keys, sizes, uids = (batch.column(c).to_pylist() for c in ("doc_id", "sha", "key", "n_chars", "uid"))
                entries = []
                for i, body in enumerate(batch.column("body")):
                    text, row = body.as_buffer(), (sizes[i], doc_ids[i], uids[i])
                    chain = chains.setdefault(keys[i], [])
                    for e in chain:
                        if e[3] == text:
                            e[1], e[2] = _better(e[1], row), e[2] + 1
                            break
                    else:
                        e = [entry, row, 1, text.to_pybytes(), shas[i]]
                        chain.append(e)
                        held += len(text) + 300
                        entry += 1
                    entries.append(e[0])
                n = batch.num_rows
                cols = [pa.array(entries, pa.int64()), batch.column("uid"), batch.column("doc_id"), batch.column("sha"), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array([False] * n)]
                yield pa.RecordBatch.from_arrays(cols, schema=_PARTS)
                if held > split_bytes:
                    yield from flush()
                    held = 0
        yield from flush()

    return run


def directory(counts: dict[int, int], depth: int, bucket_entries: int, least: int = 0) -> list[tuple[int, int]]:
    """Extendible hashing over counts of entries by their first `depth` bits: a list of (first prefix, local
    depth) of the buckets, in order. A bucket that holds too many splits in two by its next bit; none is less deep
    than `least`."""
    out, todo = [], [(0, 0)]
    total = [0]
    for p in range(1 << depth):
        total.append(total[-1] + counts.get(p, 0))
    while todo:
        first, local = todo.pop()
        width = 1 << (depth - local)
        if local < depth and (local < least or total[first + width] - total[first] > bucket_entries):
            todo += [(first + width // 2, local + 1), (first, local + 1)]
        else:
            out.append((first, local))
    return out


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in key order: chains the entries of a key by their bytes and tells each its group."""
    now: int | None = None
    chain: list[list] = []  # [bytes, best row, rows, entries]
    out: list[tuple] = []

    def close():
        for _, best, rows, entries in chain:
            out.extend((e, best[2], best[1], rows) for e in entries)
        chain.clear()

    def emit():
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _FOUND.types, strict=True)], schema=_FOUND)

    for batch in batches:
        c = {n: batch.column(n) for n in batch.schema.names}
        ids = [c[n].to_pylist() for n in ("key", "entry", "n_chars", "doc_id", "uid", "rows")]
        for i, (key, entry, n_chars, doc_id, uid, rows) in enumerate(zip(*ids, strict=True)):
            if key != now:
                close()
                now = key
            body, row = c["body"][i].as_buffer(), (n_chars, doc_id, uid)
            for link in chain:
                if link[0] == body:
                    link[1], link[2] = _better(link[1], row), link[2] + rows
                    link[3].append(entry)
                    break
            else:
                chain.append([body.to_pybytes(), row, rows, [entry]])
        yield emit()
    close()
    yield emit()


def groups(df: DataFrame, id_column: str = "doc_id", text: str = "text", key_bits: int = 64, bucket_entries: int = 20_000, split_bytes: int = 128 << 20, row: str | None = None, made: list[DataFrame] | None = None) -> DataFrame:
    """One row for each row of df: doc_id, keep_id, group_size, kept, text_sha256, uid (the column `row` of df,
    if it is named, else a number of our own).

    Texts are equal when identical after all white space is deleted; null counts as empty, and all empty texts
    are equal. The row with the most code points stays, then the smallest doc_id (null last); of repeated rows
    with one doc_id, exactly one stays. Other columns of df don't matter. An empty df gives no rows.
    made, if given, gets the shared tables that the result reads. key_bits shortens the keys, which only tests need: it makes different texts share a chain.
    """
    spark = df.sparkSession
    body = squeezed(whole(text))
    uid = F.col(row) if row else F.monotonically_increasing_id()
    docs = df.select(uid.alias("uid"), F.col(id_column).cast("long").alias("doc_id"), body.alias("body"), F.length(whole(text)).cast("long").alias("n_chars"))
    docs = docs.withColumn("sha", F.sha2(F.col("body"), 256)).withColumn("body", F.col("body").cast("binary"))
    high = F.conv(F.substring("sha", 1, 15), 16, 10).cast("long")  # 60 bits, never negative
    docs = docs.withColumn("key", F.shiftright(high, max(0, 60 - key_bits)))
    bits = min(60, key_bits)
    parts = shared.written(docs.mapInArrow(_chain_split(split_bytes), _PARTS_DDL), "hash-index", ("is_entry",))
    entries = parts.where("is_entry").drop("is_entry", "sha")
    several = shared.written(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "hash-keys")
    if made is not None:
        made += [parts, several]
    few = several.count() <= BROADCAST_KEYS
    met = F.broadcast(several.select("key")) if few else several.select("key")
    depth = min(MAX_DEPTH, bits)
    prefix = F.shiftright("key", bits - depth).cast("int")
    counted = {r[0]: r[1] for r in several.groupBy(prefix.alias("p")).agg(F.sum("n")).collect()}  # at most 2 ** MAX_DEPTH rows
    # As many buckets as there are to be tasks, at least.
    least = min(depth, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    buckets = directory(counted, depth, bucket_entries, least)
    spans = [(p, i) for i, (first, local) in enumerate(buckets) for p in range(first, first + (1 << depth - local))]
    starts = spark.createDataFrame(spans, "prefix int, bucket int")  # 2 ** MAX_DEPTH rows at most
    dealt = entries.join(met, "key", "left_semi").withColumn("prefix", prefix).join(F.broadcast(starts), "prefix").drop("prefix")
    dealt = dealt.repartitionById(len(buckets), F.col("bucket")).sortWithinPartitions("key")
    found = dealt.select("key", "entry", "n_chars", "doc_id", "uid", "rows", "body").mapInArrow(_own, "entry long, keep_uid long, keep_id long, group_size long")
    alone = entries.join(met, "key", "left_anti").select("entry", F.col("uid").alias("keep_uid"), F.col("doc_id").alias("keep_id"), F.col("rows").alias("group_size"))
    found = found.unionByName(alone)
    members = parts.where("NOT is_entry").select("entry", "uid", "doc_id", "sha")
    return members.join(found, "entry").select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("sha").alias("text_sha256"), "uid")


def keep_one(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stay, one of each group of equal texts (see groups), with the columns of df.

    The rows are numbered in a shared table first, so that repeated rows can be told apart.
    """
    row = free_name(df, "_row")
    numbered = shared.written(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    made: list[DataFrame] = []
    verdict = groups(numbered, id_column, text, row=row, made=made)
    verdict = shared.written(verdict.where("kept").select(F.col("uid").alias(row)), "kept")
    shared.drop(*made)
    return numbered.join(verdict, row, "left_semi").select(*df.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("uid")


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       row_number() OVER w = 1 AS kept, sha AS text_sha256
FROM d WINDOW w AS (PARTITION BY sha ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

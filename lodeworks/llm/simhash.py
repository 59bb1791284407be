"""SimHash near-duplicates by deletion variants.

A fingerprint is cut into s segments. If two differ in at most 2 * s - 1 bits, one segment differs in at most
one, so each segment is indexed with each of its bits deleted in turn; fingerprints that are equal
under one such key meet in a bucket, and are verified there. Fingerprints enter the index once, however many
documents have them, and a bucket gives links that grow with its members, not with their pairs.

`link_hamming` is exact: it links all fingerprints within 2 bits, from two segments of 32.
`near_duplicates` finds similar texts: first by that search over the fingerprints of their sets of shingles. Texts can
be similar enough with fingerprints further apart; an exact pass finds those, as such sets share one of their
first shingles, and leaves out what the fingerprints have joined. Whole sets decide in both (similarity of 0.8, words of
five, unless told otherwise).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import graph, shared
from .text import portions, whole

SEED = 42
#: Buckets up to this size compare all members; beyond, the work per member is bounded (see _bucket_links).
DENSE = 256
#: In the search for similar texts, buckets up to this size give all their near pairs as candidates.
PAIRS = 16


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of so many words, A-Z lower-cased; of all words if there are fewer."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=False)), np.uint64, len(tokens) - k + 1)


_LANES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; zero if there are none."""
    counts = np.zeros((8, 8), np.int64)  # [bit within its byte, byte]
    for at in range(0, len(hashes), 255):
        part = hashes[at : at + 255]
        for bit in range(8):
            lanes = ((part >> np.uint64(bit)) & _LANES).sum(dtype=np.uint64)
            counts[bit] += np.frombuffer(lanes.tobytes(), np.uint8)
    bits = (counts.T * 2 > len(hashes)).reshape(64)
    return int(np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """Adds fp (long; bit i of the fingerprint). All other columns but text stay."""
    keep = [c for c in df.columns if c != text]
    schema = df.select(*keep).schema.add("fp", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([majority(shingle_hashes(value.as_py(), words)) for value in batch.column(text)], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    return df.select(*keep, whole(text).alias(text)).mapInArrow(run, schema)


def variants(segments: Column, bits: int) -> Column:
    """An array of keys for an array of segments: each with each of its bits deleted in turn. Equal segments share
    all of these, those that differ in one bit share one."""
    without = lambda x, j: x.bitwiseAND(F.bitwise_not(F.expr("1L").cast("long") * F.pow(F.lit(2.0), j).cast("long")))
    key = lambda x, s: F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda j: ((s * 64 + j).cast("long") * F.lit(1 << bits)) + without(x, j))
    return F.flatten(F.transform(segments, key))


def _bits_off(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _roots(near: np.ndarray) -> np.ndarray:
    """Component labels from a matrix of neighbours."""
    n = len(near)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], n).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(fps: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join all members of a bucket that are within `most` (1 or 2) bits, directly or by others."""
    fps = np.unique(fps)
    if len(fps) <= DENSE:
        root = _roots(_bits_off(fps[:, None], fps[None, :]) <= most)
        yield fps[root != np.arange(len(fps))], fps[root[root != np.arange(len(fps))]]
        return
    flips = [1 << i for i in range(64)]
    if most == 2:
        flips += [1 << i | 1 << j for i in range(64) for j in range(i)]
    for flip in flips:  # linear in the members: each looks up its neighbours
        other = fps ^ np.uint64(flip)
        at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
        hit = (fps[at] == other) & (fps < other)
        if hit.any():
            yield fps[hit], other[hit]


def _bucket_links(most: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last = None

        def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
            size = ends - starts
            two = starts[size == 2]
            ok = _bits_off(fps[two], fps[two + 1]) <= most
            found = [(fps[two][ok], fps[two + 1][ok])]
            for s, e in zip(starts[size > 2], ends[size > 2], strict=True):
                found += _linked(fps[s:e], most)
            a, b = (np.concatenate([x[i] for x in found]) for i in (0, 1))
            if len(a):
                both = np.unique(np.stack([a, b], 1), axis=0)
                for i in range(0, len(both), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(both[i : i + 100_000, j].view(np.int64) if both.dtype == np.uint64 else both[i : i + 100_000, j]) for j in (0, 1)], schema=schema)

        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            if keys[-1] == last and keys[0] == last:  # all of one bucket, which goes on
                held.append((keys, fps))
                continue
            cut = np.searchsorted(keys, keys[-1])  # the last bucket may go on in the next batch
            held.append((keys[:cut], fps[:cut]))
            yield from links(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            held, last = [(keys[cut:], fps[cut:])], keys[-1]
        if held:
            yield from links(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

    return run


def bucket_links(index: DataFrame, bits: int, most: int) -> DataFrame:
    """(a, b) from an index of (fp, segments): fp must be distinct."""
    keys = index.select(F.explode(variants(F.col("segments"), bits)).alias("key"), "fp")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links(most), "a long, b long")


def link_hamming(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join all within 2 bits, by two segments."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    segments = F.array(low, F.shiftrightunsigned("fp", 32))
    return bucket_links(fps.select("fp", segments.alias("segments")), 32, 2)


def classes(df: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """One row for each row of df: doc_id, fp (long) and component_id, the smallest doc_id that links of at
    most 2 bits reach (itself included).

    Null and empty texts, and those without words, have fingerprint zero and link like any other. Ties and
    repeated rows share a fingerprint. A null doc_id never names a component unless nothing else is in it.
    """
    docs = shared.written(fingerprints(df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", words).select("doc_id", "fp"), "fingerprints")
    firsts = shared.written(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    parts = graph.components(link_hamming(firsts.select("fp")))
    named = firsts.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    names = shared.written(named.join(least, "component").select("fp", "component_id"), "classes")
    return docs.join(names, "fp").select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    out = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Rows of which the common shingles are taken, and how many of those are told from the rest. Both only order the
#: shingles: any order finds the same pairs.
SAMPLE, COMMON = 20_000, 100_000


def _prefix(m: int, similarity: float) -> int:
    """So many of the first of m shingles that two sets of this similarity share one of them, in any order."""
    return m - math.ceil(similarity * m - 1e-9) + 1 if m else 0


def _shingle_sets(words: int, similarity: float, common: tuple[np.ndarray, np.ndarray]):
    """near_row, doc_id, n; the set's digest (h1, h2), its size m, its fingerprint fp and its first shingles in the
    order of the search: those not known to be common, then the common by their count."""
    values, ranks = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole_batch.slice(*at) for whole_batch in batches for at in portions(whole_batch.column("text"))):
            digests, m, fps, parities, keys = [], [], [], [], []
            for text in batch.column("text"):
                h = np.unique(shingle_hashes(text.as_py(), words))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                fps.append(majority(h))
                parities.append(_parity(h))
                m.append(len(h))
                rank = np.zeros(len(h), np.int64)
                if len(values):
                    at = np.minimum(np.searchsorted(values, h), len(values) - 1)
                    rank = np.where(values[at] == h, ranks[at], 0)
                keys.append(h[np.lexsort((h, rank))[: _prefix(len(h), similarity)]].view(np.int64))
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            ends = np.cumsum([0, *(len(k) for k in keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("near_row", "doc_id", "n")), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(m, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(parities, pa.binary()), lists], names=["near_row", "doc_id", "n", "h1", "h2", "m", "fp", "parity", "keys"])

    return run


_SETS = "near_row long, doc_id long, n int, h1 long, h2 long, m int, fp long, parity binary, keys array<long>"


def _common(texts: DataFrame, rows: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several rows of a sample have, in order, and their ranks by count (from 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in portions(batch.column("text")):
                sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in batch.column("text").slice(at, n)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    some = texts.where(F.pmod(F.xxhash64("near_row"), F.lit(max(1, -(-rows // SAMPLE)))) == 0)
    counts = some.select("text").mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= 8)
    most = counts.orderBy(F.desc("count"), "h").limit(COMMON).collect()
    values = np.array([r.h for r in most], np.int64).view(np.uint64)
    ranks = np.array([r["count"] for r in most], np.int64)
    order = np.argsort(values)
    return values[order], ranks[order]


def _may(m: np.ndarray, pos: np.ndarray, i, j, similarity: float) -> np.ndarray:
    """Whether sets whose first common shingle is at these places can be similar enough: never false if they are."""
    reach = np.minimum(m[i] - pos[i], m[j] - pos[j])
    return reach >= similarity / (1 + similarity) * (m[i] + m[j]) - 1e-6


def _able(m: np.ndarray, pos: np.ndarray, similarity: float) -> np.ndarray:
    """Members of a bucket for which _may holds with some other, or a bound on the others doesn't rule it out."""
    most = (m - pos) * (1 + similarity) / similarity - m + 1e-3  # how large another may be
    low, high = np.argmin(m), np.argmax(most)
    lows, highs = np.delete(m, low), np.delete(most, high)
    other_low, other_high = np.full(len(m), m[low], float), np.full(len(m), most[high])
    other_low[low], other_high[high] = lows.min(), highs.max()
    return (other_low <= most) & (other_high >= m)


def _buckets(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """The buckets (rows of one key) of more than one member, from batches sorted by key."""
    held: list[list[np.ndarray]] = []

    def cut(columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        cuts = np.flatnonzero(np.diff(columns[0])) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(columns[0])]))
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            yield tuple(c[s:e] for c in columns)

    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if not len(columns[0]):
            continue
        last = np.searchsorted(columns[0], columns[0][-1])
        if held and columns[0][0] == columns[0][-1] == held[-1][0][-1]:
            held.append(columns)
            continue
        held.append([c[:last] for c in columns])
        yield from cut([np.concatenate(c) for c in zip(*held, strict=True)])
        held = [[c[last:] for c in columns]]
    if held:
        yield from cut([np.concatenate(c) for c in zip(*held, strict=True)])


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("m", pa.int32()), ("pos", pa.int32())])


def _first_pairs(similarity: float, screen: int):
    """All pairs (a, b) of a small bucket that can be similar. Of a larger one, pairs with a few leaders, each the
    member nearest to the majority of those left; and its members (a, without b), for the exact pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            a, b, key, m, pos = (np.concatenate(c) for c in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=key != 0), pa.array(key), pa.array(m.astype(np.int32)), pa.array(pos.astype(np.int32))], schema=_FOUND)

        for key, node, m, pos, fp in _buckets(batches, ("key", "node", "m", "pos", "fp")):
            n = len(node)
            if n <= PAIRS:
                i, j = np.triu_indices(n, 1)
                ok = _may(m, pos, i, j, similarity)
                i, j = i[ok], j[ok]
            else:
                fps, rest, found = fp.view(np.uint64), np.ones(n, bool), []
                for _ in range(PAIRS):
                    own = np.flatnonzero(rest)
                    if len(own) < 2:
                        break
                    lead = own[np.lexsort((node[own], _bits_off(fps[own], np.uint64(majority(fps[own])))))[0]]
                    near = own[(_bits_off(fps[own], fps[lead]) <= screen) & (own != lead)]
                    near = near[_may(m, pos, near, lead, similarity)]
                    rest[near] = rest[lead] = False
                    found.append((np.full(len(near), lead), near))
                i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                able = _able(m, pos, similarity)
                out.append([x[able] for x in (node, node, np.where(key == 0, 1, key), m, pos)])
                size += int(able.sum())
            if len(i):
                none = np.zeros(len(i), np.int64)
                out.append([np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), none, none, none])
                size += len(i)
            if size > 50_000:
                yield packed()
                out, size = [], 0
        if out:
            yield packed()

    return run


def _known_sets(words: int, most: int = 1000):
    """Sets of shingles by node, of which the latest are held."""
    known: dict[int, np.ndarray] = {}

    def shingles(node: int, text: str) -> np.ndarray:
        if node not in known:
            if len(known) >= most:
                del known[next(iter(known))]
            known[node] = np.unique(shingle_hashes(text, words))
        return known[node]

    return shingles


def _near(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both >= similarity * (len(p) + len(q) - both) - 1e-9


#: Bits of a set's parities, for small and for large sets: sets differ in as many members as their parities in bits,
#: or more.
PARITIES, SMALL = (1024, 8192), 1500


def _parity(hashes: np.ndarray) -> bytes:
    bits = PARITIES[len(hashes) > SMALL]
    return np.packbits(np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def _folded(parity: bytes) -> np.ndarray:
    """The parities of a set as those of a small one."""
    return np.bitwise_xor.reduce(np.frombuffer(parity, np.uint64).reshape(-1, PARITIES[0] // 64), axis=0)


def _apart(p: bytes, q: bytes) -> int:
    """In how many bits two parities differ."""
    if len(p) == len(q):
        return (int.from_bytes(p, "little") ^ int.from_bytes(q, "little")).bit_count()
    return int(np.bitwise_count(_folded(p) ^ _folded(q)).sum(dtype=np.int64))


def _rest_pairs(similarity: float):
    """All pairs of a bucket in different components (part), but for those that an exact bound refutes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, node, m, pos, part, parity in _buckets(batches, ("key", "node", "m", "pos", "part", "parity")):
            folded = np.stack([_folded(x) for x in parity])
            whole_ = {k: np.frombuffer(parity[k], np.uint64) for k in np.flatnonzero(m > SMALL).tolist()}
            most = (1 - similarity) / (1 + similarity)
            for i in range(len(node) - 1):
                j = np.arange(i + 1, len(node))
                j = j[(part[j] != part[i]) & _may(m, pos, j, i, similarity)]
                apart = np.bitwise_count(folded[j] ^ folded[i]).sum(1, dtype=np.int64)
                j = j[apart <= most * (m[j] + m[i]) + 1e-6]
                if i in whole_:
                    j = j[[k not in whole_ or int(np.bitwise_count(whole_[k] ^ whole_[i]).sum(dtype=np.int64)) <= most * (m[k] + m[i]) + 1e-6 for k in j.tolist()]] if len(j) else j
                if len(j):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])

    return run


#: Rows to compare up to this number are told to the tasks that read texts; more are joined.
BROADCAST_NODES = 1_000_000


def _screened(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) but for those that the parities of their sets refute: a bound that is never wrong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = (1 - similarity) / (1 + similarity)
        for batch in batches:
            m = batch.column("m_a").to_numpy(zero_copy_only=False) + batch.column("m_b").to_numpy(zero_copy_only=False)
            keep = [_apart(p, q) <= most * n + 1e-6 for p, q, n in zip(batch.column("parity_a").to_pylist(), batch.column("parity_b").to_pylist(), m.tolist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: sets.select(F.col("near_row").alias(x), F.col("m").alias(f"m_{x}"), F.col("parity").alias(f"parity_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "m_a", "m_b", "parity_a", "parity_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, sets: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of which the whole sets of shingles are similar enough."""
    pairs = shared.written(_screened(pairs, sets, similarity), "near-pairs")
    nodes = shared.written(pairs.select(F.explode(F.array("a", "b")).alias("near_row")).distinct(), "near-nodes")
    some = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
    own = shared.written(texts.join(some, "near_row", "left_semi").select("near_row", "text"), "near-texts")
    side = lambda x: own.select(F.col("near_row").alias(x), F.col("text").alias(f"text_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _known_sets(words)
        for batch in batches:
            rows = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True)
            keep = [_near(shingles(x, s.as_py()), shingles(y, t.as_py()), similarity) for x, y, s, t in rows]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = shared.written(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "near-links")
    shared.drop(pairs, nodes, own)
    shared.release(texts.sparkSession)
    return out


def _by_fingerprints(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp) by the search of `link_hamming`: the least node of a fingerprint with the others
    that have it, and with those of the fingerprints that this one is linked to."""
    leads = shared.written(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "near-leads")
    side = lambda x: leads.select(F.col("fp").alias(x), F.col("lead").alias(f"lead_{x}"))
    linked = link_hamming(leads.select("fp")).join(side("a"), "a").join(side("b"), "b").select(F.least("lead_a", "lead_b").alias("a"), F.greatest("lead_a", "lead_b").alias("b"))
    same = nodes.join(leads, "fp").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    out = shared.written(linked.unionByName(same).distinct(), "fingerprint-pairs")
    shared.drop(leads)
    shared.release(nodes.sparkSession)
    return out


def _not_joined(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes aren't in one component of parts (node, component)."""
    side = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"part_{x}"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where(~F.coalesce(F.col("part_a") == F.col("part_b"), F.lit(False))).select("a", "b")


def near_duplicates(df: DataFrame, text: str = "text", id_column: str = "doc_id", words: int = 5, similarity: float = 0.8, screen: int = 16) -> DataFrame:
    """df with near_of (long): the row number of the row that stays for its group, and near_row, its own.

    Texts are near when the Jaccard similarity of their sets of word shingles is at least `similarity`; groups are
    the components of all near pairs, exactly and at every size. Candidates come from fingerprints within 2 bits, by
    deletion variants; then, for what these miss, from an exact pass: two such sets share one of their first shingles
    (see _prefix), so each distinct set is indexed by those. Every candidate is verified on whole sets. A large
    bucket of the exact pass first links its members to leaders (`screen` bits of 64 around each), then gives all pairs
    that are not yet in one component. Of a group the longest text stays, then the smallest doc_id (null last), then
    the first row. Texts without words are near each other. Columns of df keep their names; near_of and near_row
    are replaced.
    """
    df = df.drop("near_of", "near_row")
    spark = df.sparkSession
    shared.release(spark)
    numbered = shared.written(df.withColumn("near_row", F.monotonically_increasing_id()), "numbered")
    texts = numbered.select("near_row", F.col(id_column).cast("long").alias("doc_id"), F.length(whole(text)).alias("n"), whole(text).alias("text"))
    sets = texts.mapInArrow(_shingle_sets(words, similarity, _common(texts, numbered.count(), words)), _SETS)
    sets = shared.written(sets, "sets")
    # One row stands for all with the same set.
    better = F.struct((-F.col("n")).alias("n"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), F.col("near_row").alias("r"))
    heads = shared.written(sets.groupBy("h1", "h2").agg(F.min(better)["r"].alias("head")), "heads")
    distinct = sets.join(heads.select(F.col("head").alias("near_row")), "near_row", "left_semi")
    by_print = _by_fingerprints(distinct.select(F.col("near_row").alias("node"), "fp"))
    linked = _verified(by_print, texts, sets, words, similarity)
    joined = shared.written(graph.components(linked), "fingerprint-parts")
    index = distinct.select(F.col("near_row").alias("node"), "m", "fp", F.posexplode("keys").alias("pos", "key"))
    found = shared.written(index.repartition("key").sortWithinPartitions("key").mapInArrow(_first_pairs(similarity, screen), "a long, b long, key long, m int, pos int"), "found")
    shared.release(spark)  # of the index's shuffle
    first = shared.written(_not_joined(found.where("b IS NOT NULL").select("a", "b").distinct(), joined), "first-pairs")
    near = linked.unionByName(_verified(first, texts, sets, words, similarity))
    shared.drop(by_print, joined)
    parts = shared.written(graph.components(near), "first-parts")
    large = found.where("b IS NULL").join(parts, F.col("a") == F.col("node"), "left").select("key", F.col("a").alias("node"), "m", "pos", F.coalesce("component", "a").alias("part"))
    split = large.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    rest = large.join(split, "key", "left_semi").join(sets.select(F.col("near_row").alias("node"), "parity"), "node")
    rest = rest.repartition("key").sortWithinPartitions("key").mapInArrow(_rest_pairs(similarity), "a long, b long")
    rest = shared.written(rest.distinct().join(first, ["a", "b"], "left_anti"), "rest-pairs")
    shared.drop(found, first)
    parts = graph.components(near.unionByName(_verified(rest, texts, sets, words, similarity)))
    grouped = sets.select("near_row", "doc_id", "n", "h1", "h2").join(heads, ["h1", "h2"]).join(parts, F.col("head") == F.col("node"), "left")
    grouped = shared.written(grouped.select("near_row", "doc_id", "n", F.coalesce("component", "head").alias("part")), "grouped")
    shared.drop(sets, heads, rest)
    stays = grouped.groupBy("part").agg(F.min(better)["r"].alias("near_of"))
    return numbered.join(grouped.join(stays, "part").select("near_row", "near_of"), "near_row")

"""Language-model scores from a log-frequency Bloom filter.

Every word and every pair of neighbours of the training texts is counted. A pair with count c has level q, the
place of c among the steps of a log scale (STEPS); the filter holds (pair, 1) ... (pair, q), so its count is read
back by probing level after level until one fails, as the least count that has the level reached. Small counts
come back exactly.

    P(w | u) = (count(u, w) + MASS * P1(w)) / (count(u) + MASS)

where P1 is the smoothed unigram probability. As a logarithm it is a part of single words, which exact counts give
(those of frequent words are broadcast, the rest meet the table of words in a join), and the part of the pair,
log(1 + count(u, w) / (MASS * P1(w))). For a w that isn't frequent the filter holds its own count as well, read from
above there. So the probabilities after a word sum to 1 at most (but for false positives, about one in 100 absent
pairs, read as 1).

The filter is cut into slices by hash, as many as the corpus asks for (SLICE_KEYS tokens each), and each stays in the
one task that builds it: the keys go to their slices. A portion of texts (`round_bytes` of them) sends each slice its
distinct keys with how often texts that are learnt from have them; the slice is built from the counts of all portions,
looks each key up, and the levels go back to the portions. So texts are read twice (words, then keys), whatever
the size of the filter, and nothing is left out at any size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .text import portions, whole
from .toxicity import fold

END = b"\n"  # no word has white space
#: Words with at least N / WORD_SHARE of the N training tokens are broadcast: so many at most.
WORD_SHARE = 2_000_000
BASE, MASS = 1.5, 3000.0
BITS_EACH, PROBES = 10, 4
#: Slices at least, and training tokens for each slice beyond.
SLICES, SLICE_KEYS = 64, 1 << 21
#: Bytes of text (or one text) whose keys go to their slices at once.
ROUND_BYTES = 4 << 20
FLUSH = 1 << 18
#: Words that a task keeps numbered; when full it starts afresh.
NUMBERED = 1 << 18

#: The least counts of each level: 0, then the distinct whole numbers from powers of BASE on.
STEPS = np.array(sorted({0, *(math.ceil(BASE**k - 1e-9) for k in range(190))}), np.float64)


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased, from UTF-8, then the end. Bytes know only the six white spaces of ASCII, and
    lower only A-Z."""
    return [*text.lower().split(), END]


def _tokens(texts: pa.Array) -> list[list[bytes]]:
    return [tokens(t.as_buffer().to_pybytes()) for t in texts]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush():
        names = list(counts)
        for i in range(0, len(names), 65536):
            part = names[i : i + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()).cast(pa.string()), pa.array([counts[w] for w in part], pa.int64())], names=["token", "c"])
        counts.clear()

    for batch in batches:
        for text in batch.column("text"):
            counts.update(tokens(text.as_buffer().to_pybytes()))
            if len(counts) > FLUSH:
                yield from flush()
    yield from flush()


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Vocabulary:
    """Numbers the words of a task: the frequent ones first, with their counts, then others as they come."""

    def __init__(self, frequent: list[tuple[bytes, int]], n: int, v: int, n_slices: int):
        self.n, self.whole, self.n_slices = n, n + 0.5 * (v + 1), n_slices
        self.frequent = [w for w, _ in frequent]
        self.n_frequent = len(frequent)
        self.count = np.array([c for _, c in frequent], np.float64)
        self.starts = float(dict(frequent).get(END, 0))  # texts learnt from
        self.forget()

    def forget(self) -> None:
        self.number = Numbers(self.frequent)
        self.hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.frequent], np.uint64)

    def numbers(self, texts: list[list[bytes]]) -> np.ndarray:
        """The numbers of the words of all texts."""
        if len(self.number) > self.n_frequent + NUMBERED:
            self.forget()
        get = self.number.__getitem__
        out = np.fromiter(map(get, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        new = [xxhash.xxh64_intdigest(w) for w in self.number.names[len(self.hashes) :]]
        self.hashes = np.concatenate((self.hashes, np.array(new, np.uint64)))
        return out


class Numbers(dict):
    """Numbers words in the order in which they first come, after those that are given."""

    def __init__(self, given: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(given))
        self.names = list(given)

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self.names)
        self.names.append(word)
        return i


#: The bits of a key that say its slice.
SLICE_BITS = 24
UPPER = np.uint64((1 << SLICE_BITS) - 1 << 64 - SLICE_BITS)


def slices(key: np.ndarray, n_slices: int) -> np.ndarray:
    return ((key >> np.uint64(64 - SLICE_BITS)) * np.uint64(n_slices) >> np.uint64(SLICE_BITS)).astype(np.int64)


def word_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of words alone, in the slices of their pairs."""
    return _mixed(hashes) & UPPER | _mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)) & ~UPPER


def pairs(hashes: np.ndarray, frequent: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The keys of tokens with what stands before them; firsts are the places where texts begin."""
    before = np.empty(len(hashes), np.uint64)
    before[1:] = hashes[:-1]
    before[firsts] = 0
    with np.errstate(over="ignore"):
        pair = _mixed(_mixed(before) * np.uint64(3) + hashes)
    # The upper bits say the slice: by the pair if its word is frequent, else by the word.
    return np.where(frequent, pair, _mixed(hashes) & UPPER | pair & ~UPPER)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, a place of each, and the number of each place's key among them."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.concatenate((np.ones(min(1, len(key)), bool), ordered[1:] != ordered[:-1]))
    where = np.empty(len(key), np.int64)
    where[order] = np.cumsum(new) - 1
    return ordered[new], order[new], where


def _keys(hashes: np.ndarray, frequent: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of texts of these lengths in order, which is that of slices; and the number among them of each
    token's pair, then of each word that isn't frequent."""
    firsts = np.cumsum(lengths) - lengths
    key, _, where = _distinct(np.concatenate((pairs(hashes, frequent, firsts), word_keys(hashes[~frequent]))))
    return key, where


def _packed(values: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, which compress better: sorted keys by a third."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return len(values).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:4], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[4:], n * width, codec="zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


#: What portions (by the row number of their first text) tell slices, and slices them, packed. To a slice: keys, and their
#: counts in the texts that are learnt from; from it: levels, in the order of the keys. What a portion keeps of its
#: texts for their scores has no slice: their ids and lengths, the numbers of their words, and the names of those that
#: aren't frequent, which are numbered after those that are.
_TOLD = "portion long, slice int, keys binary, counts binary, levels binary, doc_id array<long>, lengths binary, words binary, names array<string>"
_TYPES = pa.schema([("portion", pa.int64()), ("slice", pa.int32()), *((c, pa.binary()) for c in ("keys", "counts", "levels")), ("doc_id", pa.list_(pa.int64())), ("lengths", pa.binary()), ("words", pa.binary()), ("names", pa.list_(pa.string()))])


def _told(n: int, **columns) -> pa.RecordBatch:
    """n rows of _TOLD, null in all columns that aren't given."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _TYPES], schema=_TYPES)


def _ask(sent, round_bytes: int):
    """Of each portion of texts what it tells the slices, and what it keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(*sent.value)
        for whole_batch in batches:
            for first, rows in portions(whole_batch.column("text"), round_bytes):
                batch = whole_batch.slice(first, rows)
                texts = _tokens(batch.column("text"))
                ids, lengths = vocabulary.numbers(texts), np.array([len(t) for t in texts], np.int32)
                del texts
                frequent = ids < vocabulary.n_frequent
                key, where = _keys(vocabulary.hashes[ids], frequent, lengths)
                taught = np.repeat(batch.column("taught").to_numpy(zero_copy_only=False), lengths)
                counts = np.bincount(where[np.concatenate((taught, taught[~frequent]))], minlength=len(key)).astype(np.int32)
                others, number = np.unique(ids[~frequent], return_inverse=True)
                names = pa.array([vocabulary.number.names[i] for i in others.tolist()], pa.binary()).cast(pa.string())
                ids[~frequent] = vocabulary.n_frequent + number
                portion = batch.column("row")[0].as_py()
                yield _told(1, portion=[portion], doc_id=[batch.column("doc_id").to_pylist()], lengths=[_packed(lengths)], words=[_packed(ids.astype(np.int32))], names=[names])
                own = slices(key, vocabulary.n_slices)
                starts = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1, [len(own)])).tolist()
                for i in range(0, len(starts) - 1, 1024):
                    cuts = [slice(*x) for x in pairwise(starts[i : i + 1025])]
                    yield _told(len(cuts), portion=[portion] * len(cuts), slice=[own[x.start] for x in cuts], keys=[_packed(key[x]) for x in cuts], counts=[_packed(counts[x]) for x in cuts])

    return run


def level(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(STEPS, count, "right") - 1


class Filter:
    """A log-frequency Bloom filter of some slices, each with its own number of bits; other slices hold nothing."""

    def __init__(self, n_slices: int, sizes: list[tuple[int, int]], data: bytes):
        """sizes: (slice, bytes) of the slices in data, one after the other."""
        self.bits = np.zeros(n_slices, np.uint64)
        self.first = np.zeros(n_slices, np.uint64)
        at = 0
        for s, size in sizes:
            self.bits[s], self.first[s] = size * 8, at
            at += size * 8
        self.data = np.frombuffer(data, np.uint8)  # no copy: the data is much of a task's memory
        self.has = self.bits > 0

    @staticmethod
    def places(h: np.ndarray, q: int, probe: int, bits: np.ndarray | np.uint64) -> np.ndarray:
        """The bit of a probe for keys with these mixed hashes at level q."""
        low = np.uint64(0xFFFFFFFF)
        with np.errstate(over="ignore"):
            g = _mixed(h ^ np.uint64(q * 0x5851F42D4C957F2D & (2**64 - 1)))
            x = ((g >> np.uint64(32)) + (g | np.uint64(1)) * np.uint64(probe)) & low
            return x * bits >> np.uint64(32)

    @classmethod
    def build(cls, key: np.ndarray, c: np.ndarray) -> bytes:
        """The bits of one slice."""
        q = level(c)
        size = -(-max(int(q.sum()) * BITS_EACH, LEAST_BITS) // 64) * 64
        on = np.zeros(size, bool)
        h = _mixed(key)
        for j in range(1, int(q.max(initial=0)) + 1):
            h, q = h[q >= j], q[q >= j]
            for probe in range(PROBES):
                on[cls.places(h, j, probe, np.uint64(size)).astype(np.int64)] = True
        return np.packbits(on, bitorder="little").tobytes()

    def level(self, key: np.ndarray, s: np.ndarray) -> np.ndarray:
        """The levels read back, by probes; all keys must be of slices that are held."""
        out = np.zeros(len(key), np.int64)
        on = np.arange(len(key))
        h, bits, first = _mixed(key), self.bits[s], self.first[s]
        for j in range(1, len(STEPS)):
            for probe in range(PROBES):
                p = first[on] + self.places(h[on], j, probe, bits[on])
                on = on[self.data[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1 == 1]
            if not len(on):
                break
            out[on] = j
        return out


#: Bits of a slice at least.
LEAST_BITS = 1 << 12


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Builds each task's slices of the filter (one, unless there are fewer tasks) and looks up what portions ask.
    What portions keep passes through."""
    asked: dict[int, list[tuple[int, bytes, bytes]]] = {}
    for batch in batches:
        keeps = batch.column("slice").is_null()
        yield batch.filter(keeps)
        for r in batch.filter(pc.invert(keeps)).select(["portion", "slice", "keys", "counts"]).to_pylist():
            asked.setdefault(r["slice"], []).append((r["portion"], r["keys"], r["counts"]))
    for s in sorted(asked):
        portion, keys, counts = zip(*asked.pop(s), strict=True)
        keys = [_unpacked(x, np.uint64) for x in keys]
        ends = np.cumsum([0, *(len(x) for x in keys)]).tolist()
        key, _, where = _distinct(np.concatenate(keys))
        del keys
        c = np.bincount(where, weights=np.concatenate([_unpacked(x, np.int32) for x in counts]), minlength=len(key))
        raw = Filter.build(key[c > 0], c[c > 0])
        levels = Filter(1, [(0, len(raw))], raw).level(key, np.zeros(len(key), np.int64)).astype(np.uint8)[where]
        yield _told(len(portion), portion=portion, slice=[s] * len(portion), levels=[_packed(levels[i:j]) for i, j in pairwise(ends)])


_PARTS = "row long, doc_id long, n_tokens long, n_frequent long, base_part double, score_part double, others array<string>, times array<long>"


def _score(sent_words):
    """The parts of each row's scores that don't depend on exact counts of words that aren't frequent. others are such
    words that may have been seen (the filter has them), with their numbers."""

    def scored(words: Vocabulary, portion: int, kept: dict, told: dict[int, bytes]) -> pa.RecordBatch:
        levels = np.concatenate([_unpacked(told[s], np.uint8) for s in sorted(told)])
        ids, lengths = _unpacked(kept["words"], np.int32), _unpacked(kept["lengths"], np.int32)
        frequent = ids < words.n_frequent
        names = np.array([xxhash.xxh64_intdigest(w.encode()) for w in kept["names"]], np.uint64)
        _, where = _keys(np.concatenate((words.hashes, names))[ids], frequent, lengths)
        most = np.empty(len(ids))  # the word's count, or a bound above it
        most[frequent] = words.count[ids[frequent]]
        most[~frequent] = STEPS[levels[where[len(ids) :]].astype(np.int64) + 1] - 1
        count = np.minimum(STEPS[levels[where[: len(ids)]]], most)
        p1 = (most + 0.5) / words.whole
        # Of words alone: here those of frequent ones, and of words that the filter says were never seen.
        told_here = frequent | (most == 0)
        base = np.where(told_here, np.log10(p1), 0.0)
        after = np.where(told_here, np.log10(most + MASS), 0.0)
        after[ids == words.number[END]] = 0.0  # nothing comes after the end
        firsts = np.cumsum(lengths) - lengths
        n_known, base_part, score_part = (np.add.reduceat(x, firsts) for x in ((frequent & (most > 0)).astype(np.int64), base, np.log10(1 + count / (MASS * p1)) + base - after))
        score_part += lengths * math.log10(MASS) - math.log10(words.starts + MASS)
        row = np.repeat(np.arange(len(lengths)), lengths)[~told_here]
        pair, times = np.unique(row << 32 | ids[~told_here] - words.n_frequent, return_counts=True)
        ends = pa.array(np.searchsorted(pair >> 32, np.arange(len(lengths) + 1)).astype(np.int32))
        others = pa.array([kept["names"][i] for i in (pair & 0xFFFFFFFF).tolist()], pa.string())
        others, many = (pa.ListArray.from_arrays(ends, x) for x in (others, pa.array(times.astype(np.int64))))
        return pa.RecordBatch.from_arrays([pa.array(portion + np.arange(len(lengths))), pa.array(kept["doc_id"], pa.int64()), *(pa.array(x) for x in (lengths.astype(np.int64), n_known, base_part, score_part)), others, many], names=["row", "doc_id", "n_tokens", "n_frequent", "base_part", "score_part", "others", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(*sent_words.value)
        kept: dict[int, dict] = {}
        told: dict[int, dict[int, bytes]] = {}
        for batch in batches:
            for r in batch.select(["portion", "slice", "levels", "doc_id", "lengths", "words", "names"]).to_pylist():
                if r["slice"] is None:
                    kept[r["portion"]] = r
                else:
                    told.setdefault(r["portion"], {})[r["slice"]] = r["levels"]
        for portion in sorted(kept):
            yield scored(words, portion, kept.pop(portion), told.pop(portion))

    return run


def score(df: DataFrame, train: Column | None = None, text: str = "text", round_bytes: int = ROUND_BYTES) -> DataFrame:
    """One row for each row of df: doc_id, n_tokens, n_known, train_tokens (longs), base_score, score (log10).

    Learns from the rows where `train` holds (on doc_id; by default crc32 % 5 <> 1). A null or empty text is
    the end alone; repeated rows are scored (and learnt) as often as they occur; other columns of df don't matter.
    With nothing to learn from every token is unknown, and has probability 1. An empty df gives no rows.
    `round_bytes` of text ask the filter at once; results don't depend on it.
    """
    spark = df.sparkSession
    train = fold(F.col("doc_id"), 5) != 1 if train is None else train
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), whole(text).alias("text"))
    taught = F.coalesce(train, F.lit(False))
    counts = shared.written(docs.where(taught).select("text").mapInArrow(_count_words, "token string, c long").groupBy("token").agg(F.sum("c").alias("c")), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()  # one row
    often = (F.col("c") * WORD_SHARE >= n) | (F.col("token") == END.decode())
    frequent = [(r[0].encode(), r[1]) for r in counts.where(often).collect()]  # WORD_SHARE rows at most, and the end
    n_slices = max(SLICES, n // SLICE_KEYS)
    if END not in dict(frequent):  # nothing to learn from
        frequent.append((END, 0))
    sent_words = spark.sparkContext.broadcast((frequent, n, v, n_slices))

    shared.release(spark)  # of the words' shuffle
    asked = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", taught.alias("taught")).mapInArrow(_ask(sent_words, round_bytes), _TOLD)
    to = F.coalesce("slice", F.pmod(F.xxhash64("portion"), F.lit(n_slices)).cast("int"))
    told = shared.written(asked.repartitionById(n_slices, to).mapInArrow(_answer, _TOLD), "levels")
    shared.release(spark)  # of the keys' shuffle
    several = shared.written(told.repartition(max(SLICES, n_slices // 4), "portion").mapInArrow(_score(sent_words), _PARTS), "score-parts")
    shared.drop(told)
    rest = several.select("row", F.explode(F.arrays_zip("others", "times")).alias("x")).select("row", F.col("x.others").alias("token"), F.col("x.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    p1 = F.log10((c + 0.5) / F.lit(n + 0.5 * (v + 1)))
    # None of these words has more than N / WORD_SHARE training tokens, and all but false positives have some.
    met = rest.join(counts, "token", "left").select("row", (p1 * F.col("times")).alias("base_part"), ((p1 - F.log10(c + MASS)) * F.col("times")).alias("score_part"), F.when(c > 0, F.col("times")).otherwise(0).alias("known"))
    sums = several.select("row", "doc_id", "n_tokens", "base_part", "score_part", F.col("n_frequent").alias("known")).unionByName(met, allowMissingColumns=True)
    sums = sums.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base_part").alias("base_score"), F.sum("score_part").alias("score"))
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir: str) -> DataFrame:
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

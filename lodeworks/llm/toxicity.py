"""Toxic passages by maximum-scoring segment search.

Model: each word is described by its own hash and by hashes of its first letters; the labelled training texts
give each feature a log-odds score between toxic and other texts, with a Dirichlet prior in proportion to the
classes, less a multiple of its standard error, so that rare features are drawn to zero. Features live in a table of
2 ** BITS cells: that is the bound of what is collected and broadcast, whatever the corpus.

Search: a text is a sequence of scores with negative mean, and one pass over it (Ruzzo and Tompa's algorithm)
finds all its maximal segments. A segment's score has an extreme-value distribution in clean text; its decay
and scale are fitted to the maxima of clean training texts, and give each segment an expected number of
chance finds. Segments with few enough are significant passages.

Result: the evidence of a text, -ln of the chance of its best segments, becomes a probability by a logistic
curve fitted on binned counts of a part of the training texts that the scores haven't seen.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .text import whole

BITS = 20
PREFIXES = (4, 5)  # letters
#: Strength of the prior, in texts, split as the classes are.
PRIOR = 1.0
#: Log-odds count only as far as they are beyond so many of their standard errors.
SURE = 1.5
#: Taken off every word's score, so that clean text drifts down.
DRIFT = 0.25
#: A word's score is kept within these, so that no single word decides a long text.
CLIP = 6.0
#: Labelled rows learnt from: all up to this number (the table of their ids is broadcast, about 10 MB); beyond it,
#: those with the lowest hashes of doc_id, about so many.
MOST_LABELS = 200_000
EDGE = ".,;:!?\"'()[]«»¿¡"


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds. A null id counts as the text null."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("null")).cast("binary")), F.lit(folds))


def features(word: str) -> list[int]:
    """Cells of a word: of itself and of its beginnings."""
    w = word.strip(EDGE) or word
    mask = (1 << BITS) - 1
    cells = [zlib.crc32(b"=" + w.encode("utf-8", "surrogatepass")) & mask]
    cells += [zlib.crc32(b"%d" % k + w[:k].encode("utf-8", "surrogatepass")) & mask for k in PREFIXES if len(w) >= k]
    return cells


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end), in linear time (Ruzzo and Tompa, 1999)."""
    out: list[tuple[float, int, int, float, float]] = []  # start, end, sum before it, sum at its end
    stack: list[list] = []
    total = 0.0
    for i, x in enumerate(scores):
        before = total
        total += x
        if x <= 0:
            continue
        seg = [i, i + 1, before, total]
        while True:
            # The nearest earlier segment that begins lower.
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= seg[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= seg[3]:
                stack.append([*seg, j])
                break
            seg = [stack[j][0], seg[1], stack[j][2], seg[3]]
            del stack[j:]
    return [(s[3] - s[2], s[0], s[1]) for s in stack]


class Scorer:
    def __init__(self, table: np.ndarray):
        self.table = table
        self.known: dict[str, float] = {}

    def word(self, w: str) -> float:
        s = self.known.get(w)
        if s is None:
            if len(self.known) > 1 << 18:
                self.known.clear()
            values = self.table[features(w)]
            s = self.known[w] = float(max(-CLIP, min(CLIP, values.max()))) - DRIFT
        return s

    def passages(self, text: str) -> tuple[int, list[tuple[float, int, int]]]:
        tokens = text.lower().split()
        return len(tokens), segments([self.word(w) for w in tokens])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, toxic texts' occurrences, others') of each task: a text counts a cell once."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    known: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            cells: set[int] = set()
            for w in set(text.as_py().lower().split()):
                got = known.get(w)
                if got is None:
                    if len(known) > 1 << 18:
                        known.clear()
                    got = known[w] = features(w)
                cells.update(got)
            if cells:
                counts[toxic, list(cells)] += 1
    at = np.flatnonzero(counts.any(0))
    for i in range(0, len(at), 65536):
        p = at[i : i + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(counts[1, p]), pa.array(counts[0, p])], names=["cell", "bad", "good"])


def log_odds(cells: np.ndarray, bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> np.ndarray:
    """The table of scores from counts of texts by cell and class; cells never seen score 0."""
    table = np.zeros(1 << BITS, np.float32)
    if not n_bad or not n_good:
        return table
    share = n_bad / (n_bad + n_good)
    a, b = bad + PRIOR * share, good + PRIOR * (1 - share)
    odds = np.log(a / b) - math.log(share / (1 - share))
    doubt = SURE * np.sqrt(1 / a + 1 / b)
    table[cells] = np.sign(odds) * np.maximum(0.0, np.abs(odds) - doubt)
    return table


def _measured(table, gumbel: tuple[float, float]):
    """Adds n_tokens, evidence, and passages (start, end in words; score; expected: its chance finds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(table.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
        for batch in batches:
            n_tokens, evidence, best, passages = [], [], [], []
            for text in batch.column("text"):
                n, found = scorer.passages(text.as_py())
                top = max((s for s, _, _ in found), default=0.0)
                rated = [(s, a, b, expected(s, n, gumbel)) for s, a, b in found]
                n_tokens.append(n)
                best.append(top)
                evidence.append(sum(max(0.0, -math.log(max(e, 1e-300))) for *_, e in rated))
                passages.append([{"start": a, "end": b, "score": s, "expected": e} for s, a, b, e in rated if e <= SIGNIFICANT])
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n_tokens, pa.int64()), pa.array(best, pa.float64()), pa.array(evidence, pa.float64()), pa.array(passages, kind)], names=[*keep, "n_tokens", "best", "evidence", "passages"])

    return run


#: A passage counts as found if chance gives so many as good in a clean text, or fewer.
SIGNIFICANT = 0.05
_EXTRA = "n_tokens long, best double, evidence double, passages array<struct<start:int,end:int,score:double,expected:double>>"


def expected(score: float, n: int, gumbel: tuple[float, float]) -> float:
    """How many segments of at least this score n clean words give by chance: K * n * exp(-decay * score)."""
    decay, log_k = gumbel
    return math.exp(min(700.0, max(-690.0, log_k + math.log(max(n, 1)) - decay * score)))


def fit_gumbel(mean: float, variance: float, mean_log_n: float) -> tuple[float, float]:
    """Decay and ln K from the moments of clean texts' best scores, by the extreme-value distribution."""
    decay = math.pi / math.sqrt(6 * max(variance, 0.05))
    return decay, decay * mean - 0.5772156649 - mean_log_n


def fit_logistic(bins: list[tuple[float, int, int]], steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of the chance of a toxic text, given (evidence, toxic texts, others), by Newton's
    method with a weak prior on the slope."""
    x, bad, good = (np.array([b[i] for b in bins] or [0.0], float) for i in range(3))
    a, b = 1.0, -2.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w, r = (bad + good) * p * (1 - p), bad - (bad + good) * p
        g = np.array([(r * x).sum() - 0.01 * (a - 1), r.sum() - 0.01 * (b + 2)])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    return a, b


def score(documents: DataFrame, labels: DataFrame, train: Column | None = None, text: str = "text", most_labels: int = MOST_LABELS) -> DataFrame:
    """documents (doc_id and text are read; repeated rows stay) with score, predicted, evidence, passages.

    labels (doc_id, toxic) of rows where `train` (on doc_id; by default crc32 % 4 <> 2) holds are learnt from:
    two parts of three give the scores of words, the third the calibration; of more than most_labels labels a
    hashed sample of about that size is taken. Labels other than 0 and 1, or of
    documents that aren't there, are left out. A null text is empty; an empty text has no evidence and scores
    as the curve has it at none. Without labels of both kinds every text scores 0. Other columns of either table
    don't matter, whatever their names. No documents give no rows.
    """
    spark = documents.sparkSession
    train = fold(F.col("doc_id"), 4) != 2 if train is None else train
    known = labels.where(F.col("toxic").isin(0, 1)).where(train).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # a text labelled both ways is toxic
    n = known.count()
    if n > most_labels:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most_labels / n))
    known = shared.written(known.withColumn("part", fold(F.concat(F.lit("part"), F.col("doc_id").cast("string")), 3)), "labels")
    base = documents.select("doc_id", whole(text).alias("text"))
    # The texts stay where they are: the ids of at most about most_labels rows go to them. What they pick is read often.
    taught = shared.written(base.join(F.broadcast(known), "doc_id").select("text", "toxic", "part"), "taught")
    first = taught.where("part <> 2").select("text", "toxic")
    sizes = {r[0]: r[1] for r in first.groupBy("toxic").count().collect()}  # two rows
    # Not more rows than cells.
    cells = first.mapInArrow(_counted, "cell int, bad long, good long").groupBy("cell").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()
    table = log_odds(cells["cell"].to_numpy(), cells["bad"].to_numpy(float), cells["good"].to_numpy(float), sizes.get(1, 0), sizes.get(0, 0))
    sent = spark.sparkContext.broadcast(table)  # 2 ** BITS floats
    rest = taught.where("part = 2").select("text", "toxic")
    moments = rest.where("toxic = 0").mapInArrow(_measured(sent, (1.0, 0.0)), f"toxic int, {_EXTRA}").where("n_tokens > 0")
    m = moments.agg(F.avg("best"), F.var_samp("best"), F.avg(F.log("n_tokens"))).first()  # one row
    gumbel = fit_gumbel(m[0] or 0.0, m[1] or 1.0, m[2] or 0.0)
    tried = rest.mapInArrow(_measured(sent, gumbel), f"toxic int, {_EXTRA}").withColumn("bin", F.least(F.lit(400), F.floor(F.log1p("evidence") * 50)))
    bins = tried.groupBy("bin").agg(F.avg(F.log1p("evidence")), F.sum("toxic"), F.sum(1 - F.col("toxic"))).collect()  # 401 rows at most
    bad, good = (sum(b[i] for b in bins) for i in (2, 3))
    slope, intercept = fit_logistic([tuple(b)[1:] for b in bins]) if bad and good else (0.0, -40.0)
    shared.drop(taught, known)
    out = base.mapInArrow(_measured(sent, gumbel), f"doc_id {dict(base.dtypes)['doc_id']}, {_EXTRA}")
    chance = 1 / (1 + F.exp(-(F.log1p("evidence") * slope + intercept)))
    return out.withColumn("score", chance).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(documents, labels)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted", "evidence", F.size("passages").alias("n_passages"), "passages")

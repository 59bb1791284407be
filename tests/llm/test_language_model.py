import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lodeworks.llm import language_model as lm


def test_filter_reads_back_levels():
    rng = np.random.default_rng(0)
    keys, counts = np.arange(4000, dtype=np.uint64) * np.uint64(7919) + np.uint64(5), rng.zipf(1.5, 4000).clip(1, 10**6)
    raw = lm.Filter.build(keys, counts)
    f = lm.Filter(2, [(1, len(raw))], raw)
    one = np.ones(4000, np.int64)
    got, want = lm.STEPS[f.level(keys, one)], lm.STEPS[lm.level(counts)]
    assert (got >= want).all() and (got == want).mean() > 0.98
    assert (f.level(keys + np.uint64(1), one) > 0).mean() < 0.02
    assert [lm.STEPS[lm.level(np.array([c]))[0]] for c in (1, 2, 3, 4)] == [1, 2, 3, 4]


def brute(rows):
    """{doc_id: (base, score)} with exact counts of words, and counts of pairs and of words that aren't frequent as their levels have them."""
    tokens = lambda t: [*(t or "").lower().split(), "\n"]
    taught = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    words, pairs = Counter(w for t in taught for w in t), Counter(p for t in taught for p in zip(["", *t], t, strict=False))
    n, v = sum(words.values()), len(words)
    down = lambda c: lm.STEPS[lm.level(np.array([c]))[0]]
    up = lambda c: lm.STEPS[lm.level(np.array([c]))[0] + 1] - 1
    out = {}
    for i, t in rows:
        base = score = 0.0
        for u, w in zip(["", *tokens(t)], tokens(t), strict=False):
            p1 = (words[w] + 0.5) / (n + 0.5 * (v + 1))
            told = words[w] if w == "\n" or words[w] * lm.WORD_SHARE >= n else up(words[w])
            gain = 1 + min(down(pairs[u, w]), told) / (lm.MASS * (told + 0.5) / (n + 0.5 * (v + 1)))
            base += math.log10(p1)
            score += math.log10(lm.MASS * p1 * gain / ((words[u] if u else len(taught)) + lm.MASS))
        out[i] = (base, score)
    return out


@pytest.mark.parametrize(("share", "round_bytes"), [(lm.WORD_SHARE, lm.ROUND_BYTES), (40, lm.ROUND_BYTES), (40, 3000), (1, 1)])
def test_scores_match_brute_force(spark, monkeypatch, share, round_bytes):
    """Whether words are frequent or not, and in whatever rounds the filter goes: nothing is left out."""
    monkeypatch.setattr(lm, "WORD_SHARE", share)
    monkeypatch.setattr(lm, "SLICE_KEYS", 100)
    monkeypatch.setattr(lm, "LEAST_BITS", 1 << 14)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a", "b", "C", "dd", f"r{rng.randint(0, 40)}", "é", f"x{i}"]) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "only here only here"), (503, "a b " * 2000)]
    want = brute(rows)
    monkeypatch.setattr(lm, "SLICES", 8)
    got = {r.doc_id: (r.base_score, r.score) for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), round_bytes=round_bytes).collect()}
    assert got.keys() == want.keys()
    for i, (base, score) in want.items():
        assert got[i] == (pytest.approx(base), pytest.approx(score)), i


def test_texts_are_read_as_often_whatever_the_size_of_the_filter(spark, monkeypatch):
    """A larger filter has more slices, not more passes over the texts, and no part of it comes to the driver."""
    made, written = [], lm.shared.written
    monkeypatch.setattr(lm.shared, "written", lambda df, name, *more: made.append(name) or written(df, name, *more))
    monkeypatch.setattr(lm, "SLICES", 12)
    rows = [(i, f"a b c{i % 7} d{i}") for i in range(60)]
    out = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), round_bytes=1).collect()}
    assert made.count("score-parts") == 1 and len(made) <= 3
    monkeypatch.setattr(lm, "SLICES", 1)
    one = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out.keys() == one.keys() and all(abs(out[i] - one[i]) < 0.5 for i in out)


def test_base_scores_match_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "b", "C", "dd", f"r{i}", "é"]) for _ in range(rng.randint(0, 30))) for i in range(200)]
    rows = [*enumerate(texts), (500, None), (501, ""), (501, ""), (502, "A  b\n\tc" * 3000)]
    out = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    tokens = lambda t: [*(t or "").lower().split(), "\n"]
    train = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    base = lambda t: sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
    want = sorted((i, len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), n, base(t)) for i, t in rows)
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want])
    assert all(r.score < 0 for r in out)


def test_pairs_help_where_order_is_regular(spark):
    rows = [(i, "alpha beta gamma delta " * 40) for i in range(60)]
    out = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.score > r.base_score for r in out)


def test_empty(no_docs):
    assert lm.score(no_docs).count() == 0


def test_hard_inputs(docs):
    out = lm.score(docs.withColumn("row", docs.doc_id).withColumn("token", docs.text)).collect()
    assert len(out) == 9 and sum(r.doc_id is None for r in out) == 1 and len({(r.base_score, r.score) for r in out if r.doc_id == 2}) == 1


def test_nothing_to_learn_from(spark):
    from pyspark.sql import functions as F

    r = lm.score(spark.createDataFrame([(1, "a b a")], "doc_id long, text string"), train=F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (4, 0, 0) and r.base_score == pytest.approx(0) and r.score == pytest.approx(0)

import random

import numpy as np

from lodeworks.llm import simhash

WORDS = [f"w{i}" for i in range(20_000)]


def _edited(rng, text, runs):
    """The text with so many words changed, each far from the others; a change takes five shingles."""
    copy = list(text)
    for at in range(runs):
        copy[5 + at * (len(text) - 10) // runs + rng.randrange(3)] = f"x{rng.randrange(10**9)}"
    return copy


def _groups(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    by = {r.near_row: r.doc_id for r in out}
    return {r.doc_id: by[r.near_of] for r in out}


def _brute(texts):
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return group


def _same(got, want):
    n = len(want)
    return all((got[i] == got[j]) == (want[i] == want[j]) for i in range(n) for j in range(i))


def test_every_pair_at_the_threshold_is_found(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(100):
        text = [rng.choice(WORDS) for _ in range(200)]
        texts += [" ".join(text), " ".join(_edited(rng, text, rng.choice((4, 4, 4, 5))))]  # similarities about 0.81 and 0.77
    want = _brute(texts)
    assert 60 <= 200 - len(set(want)) < 100
    assert _same(_groups(spark, texts), want)


def test_large_buckets_lose_no_pair(spark):
    rng = random.Random(2)
    line = [f"line{i}" for i in range(10)] * 30
    texts = []
    for _ in range(100):  # one passage in all, and a near copy of each
        text = [rng.choice(WORDS) for _ in range(300)]
        texts += [" ".join(text + line), " ".join(_edited(rng, text, 4) + line)]
    base = [rng.choice(WORDS) for _ in range(150)]
    texts += [" ".join(_edited(rng, base, rng.choice((1, 2, 3)))) for _ in range(60)]  # one group by chains: many pairs below the threshold
    want = _brute(texts)
    assert _same(_groups(spark, texts), want) and len(set(want[:200])) == 100


def test_long_texts_are_decided_on_whole_sets(spark):
    rng = random.Random(3)
    texts = []
    for k in range(24):
        text = [rng.choice(WORDS) for _ in range(2000)]
        texts += [" ".join(text), " ".join(_edited(rng, text, 43 if k % 2 else 46))]  # just above and just below 0.8
    want = _brute(texts)
    assert len(set(want)) == 36
    assert _same(_groups(spark, texts), want)


def test_sets_of_one_fingerprint_are_all_compared(spark):
    rng = random.Random(4)
    line = [f"line{i}" for i in range(11)] * 100  # most of each text, so that it alone makes a fingerprint of repeated shingles
    texts = []
    for _ in range(10):
        text = [rng.choice(WORDS) for _ in range(200)]
        texts += [" ".join(text + line), " ".join(_edited(rng, text, 2) + line)]
    assert _same(_groups(spark, texts), _brute(texts))


def test_fingerprints_find_near_texts_by_themselves(spark, monkeypatch):
    """The search over fingerprints comes first: without candidates from the exact pass it still joins what it finds."""

    def nothing(batches):
        yield from (batch for batch in batches if False)

    monkeypatch.setattr(simhash, "_first_pairs", lambda similarity, screen: nothing)
    rng = random.Random(5)
    texts = []
    for _ in range(30):
        text = [rng.choice(WORDS) for _ in range(600)]
        texts += [" ".join(text), " ".join(_edited(rng, text, rng.choice((1, 2, 20))))]
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
    prints = [simhash.majority(s) for s in sets]
    close = [(prints[i] ^ prints[i + 1]).bit_count() <= 2 for i in range(0, 60, 2)]
    got = _groups(spark, texts)
    assert 5 < sum(close) < 30
    assert [got[i] == got[i + 1] for i in range(0, 60, 2)] == close and len(set(got.values())) == 60 - sum(close)

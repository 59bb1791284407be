import random

import numpy as np
import pytest
import xxhash

from lodeworks.llm import simhash


def brute_fp(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    k = min(k, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_classes(fps):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_classes(docs, no_docs):
    rows = docs.collect()
    out = simhash.classes(docs).collect()
    assert sorted((r.doc_id or -1, r.fp % 2**64) for r in out) == sorted((r.doc_id or -1, brute_fp(r.text)) for r in rows)
    by = {r.doc_id: r.component_id for r in out}
    assert by[3] == by[4] == by[5] == 3 and by[1] == by[2] == 1
    assert simhash.classes(no_docs).count() == 0


@pytest.mark.parametrize("dense", [256, 1])
def test_links_lose_none_in_2_bits(spark, dense, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {b for b in base}
    for b in base:
        for _ in range(8):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    links = simhash.link_hamming(spark.createDataFrame(signed, "fp long")).collect()
    at = {f: i for i, (f,) in enumerate(signed)}
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for r in links:
        root[find(at[r.a])] = find(at[r.b])
    want = brute_classes(fps)
    for i in range(len(fps)):
        for j in range(i):
            assert (find(i) == find(j)) == (want[i] == want[j])


def test_near_duplicates_keep_one_of_each_group(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for g in range(20):
        text = [rng.choice(words) for _ in range(200)]
        rows.append((g * 10, " ".join(text)))
        for k in range(1, 4):
            copy = list(text)
            copy[rng.randrange(200)] = f"new{g}{k}"
            rows.append((g * 10 + k, " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " "), (903, "short text"), (None, "short  text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = simhash.near_duplicates(df)
    kept = {r.doc_id for r in out.where("near_of = near_row").collect()}
    # The longest of the texts without words, and of the two short ones, stay.
    assert len([i for i in kept if i is not None and i < 900]) == 20 and kept - set(range(900)) == {902, None}
    assert out.count() == len(rows)


def test_majority_is_strict():
    assert simhash.majority(np.array([1, 2], np.uint64)) == 0
    assert simhash.majority(np.array([1, 3, 5] * 300, np.uint64)) == 1


def test_members_left_out_have_no_partner():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(2, 12))
        m = rng.integers(1, 60, n)
        pos = (rng.random(n) * (m / 5 + 1)).astype(int)
        able = simhash._able(m, pos, 0.8)
        i, j = np.triu_indices(n, 1)
        ok = simhash._may(m, pos, i, j, 0.8)
        assert able[i[ok]].all() and able[j[ok]].all()
    m, pos = np.full(40, 100), np.arange(40) // 2
    assert simhash._able(m, pos, 0.8).sum() < 26

import random
import zlib

from lodeworks.llm import toxicity as tx


def brute_segments(scores):
    """The definition: the best segment, then the same to its left and right."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or total > best[0] + 1e-12):
                best = (total, i, j + 1)
    if best is None:
        return []
    _, i, j = best
    shift = lambda xs, k: [(s, a + k, b + k) for s, a, b in xs]
    return [*brute_segments(scores[:i]), best, *shift(brute_segments(scores[j:]), j)]


def test_segments_match_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        scores = [rng.randint(-5, 5) + rng.random() / 100 for _ in range(rng.randint(0, 14))]
        rounded = lambda xs: [(round(s, 6), a, b) for s, a, b in xs]
        assert rounded(tx.segments(scores)) == rounded(brute_segments(scores))


def _corpus(n, rng):
    clean = [f"word{i}" for i in range(400)]
    bad = ["nastyone", "vilething", "awfulest"]
    rows = []
    for i in range(n):
        text = [rng.choice(clean) for _ in range(rng.randint(20, 80))]
        toxic = i % 6 == 0
        if toxic:
            at = rng.randrange(len(text))
            text[at:at] = rng.choices(bad, k=4)
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_held_out_accuracy_and_hard_inputs(spark):
    rows = _corpus(1200, random.Random(4))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (5001, ""), (5002, "word1 " * 20_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, quality int")
    out = {r.doc_id: r for r in tx.score(docs, labels).collect()}
    held = [(y, out[i].predicted) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values())
    assert not out[5000].predicted and out[5000].n_tokens == 0 and not out[5002].predicted
    found = out[next(i for i, _, y in rows if y and out[i].predicted)].passages[0]
    assert found.end - found.start <= 12


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.score(docs, none).first().predicted == 0
    assert tx.score(docs.limit(0), none).count() == 0


def test_held_out_accuracy(spark, tmp_path):
    """The registered query, on made texts: labels are learnt from the rows that aren't held out, and the others are judged."""
    rng = random.Random(5)
    mild, vile = [f"calm{i}" for i in range(300)], [f"vile{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(mild) for _ in range(rng.randint(20, 80))]
        if i % 3 == 0:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(vile) for _ in range(8)]
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(i % 3 == 0)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = tx.query(spark, str(tmp_path)).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 600 and 100 < len(held) < 200
    assert sum((r.doc_id % 3 == 0) == r.predicted for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)

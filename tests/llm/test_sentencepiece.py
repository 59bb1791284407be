import math
import random

import pytest

from lodeworks.llm import sentencepiece_codec as sp


@pytest.fixture(scope="module")
def codec():
    return sp.Codec(sp.read_pieces())


def brute(codec, run):
    """The best score of any segmentation, by trying all splits."""
    p = codec.pieces
    table = {s: p.score[i] for i, s in enumerate(p.spelling) if s is not None and i not in set(p.byte_ids)}
    data = run.encode()
    best = [0.0] + [-math.inf] * len(data)
    ends = [0]
    for ch in run:
        ends.append(ends[-1] + len(ch.encode()))
    for e in ends[1:]:
        for s in ends:
            if s < e and data[s:e] in table:
                best[e] = max(best[e], best[s] + table[data[s:e]])
        s = ends[ends.index(e) - 1]
        if data[s:e] not in table:
            best[e] = max(best[e], best[s] + sum(p.score[p.byte_ids[b]] for b in data[s:e]))
    return best[-1]


def test_round_trip_and_best_score(codec):
    rng = random.Random(1)
    alphabet = "abcde théÜ▁日🙂\n  ."
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        ids, score = codec.encode(text)
        assert codec.decode(ids) == text
        assert score == pytest.approx(brute(codec, " " + text) if text else 0.0)


def test_trie_holds_exactly_its_keys():
    keys = {b"a": 1, b"ab": 2, b"abc": 3, b"b": 4, b"zz": 5}
    trie = sp.Trie(keys)

    def get(key):
        s = 0
        for c in key:
            t = trie.base[s] + c
            if trie.check[t] != s:
                return -1
            s = t
        return trie.value[s]

    assert all(get(k) == v for k, v in keys.items())
    assert get(b"z") == -1 and get(b"c") == -1 and get(b"abcd") == -1


def test_hard_inputs(docs, no_docs):
    out = {r.doc_id: r for r in sp.encode(docs).collect()}
    assert out[3].ids == [] and out[3].decoded == "" and out[6].decoded == out[6].text
    assert out[5].decoded == " \n\t" and out[2].entry == "x"
    assert sp.encode(no_docs).count() == 0


def test_query_matches_single_texts(spark, tmp_path, codec):
    texts = ["Hello  world", "", None, " lead", "tab\there\n\nnew ▁ mark", "日本 🙂" * 50, "x" * 30_000, "Hello  world", "слово " * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    for r in sp.query(spark, str(tmp_path)).collect():
        ids, score = codec.encode(texts[r.doc_id] or "")
        assert r.ids == ids and r.log_score == pytest.approx(score) and r.same and r.n_ids == len(ids)
        assert codec.decode(ids) == (texts[r.doc_id] or "")


def test_runs_together_and_alone_are_the_same(codec):
    rng = random.Random(3)
    runs = [(" " * rng.randint(0, 2) + "".join(rng.choice("abcdeéßя日🙂.1") for _ in range(rng.randint(1, 14)))).encode() for _ in range(500)]
    for got, run in zip(codec.viterbi_many(runs), runs):
        ids, score = codec.viterbi(run)
        assert got == (ids, pytest.approx(score))

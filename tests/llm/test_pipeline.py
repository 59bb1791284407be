import re

import numpy as np

import corpus_pipeline
from lodeworks.llm import mixing, sentencepiece_codec, shared, simhash


def _small(spark, tmp_path, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def _text(seed, n=80, change=()):
    rng = np.random.default_rng(seed)
    words = [f"word{rng.integers(10**6)}" for _ in range(n)]
    for i in change:
        words[i] = "other"
    return " ".join(words)


def _rows():
    rows = [(i, _text(i), "en", "abc"[i % 3], 1) for i in range(30)]
    rows += [(100 + i, _text(i) + " ", "en", "a", 1) for i in range(5)]  # equal but for white space, and longer
    rows += [(200 + i, _text(i, change=(40,)), "en", "b", 1) for i in range(5, 9)]  # near: 71 of 81 shingles
    rows += [(300, "too short", "en", "a", 1), (301, None, None, None, None), (302, "", "en", "a", 0), (303, _text(20), "en", "a", 1), (303, _text(20), "en", "a", 1)]
    return rows


def _brute(rows):
    """The doc_ids that each of the first three stages keeps, from all pairs."""
    kept = [r for r in rows if len((r[1] or "").split()) >= 50]
    best = {}
    for i, r in enumerate(kept):
        best.setdefault(re.sub(r"\s", "", r[1]), []).append((-len(r[1]), r[0], i))
    exact = [kept[min(g)[2]] for g in best.values()]
    sets = [set(simhash.shingle_hashes(r[1], 5).tolist()) for r in exact]
    group = list(range(len(exact)))
    for i in range(len(exact)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    near = {}
    for i, r in enumerate(exact):
        near.setdefault(group[i], []).append((-len(r[1]), r[0]))
    return [r[0] for r in kept], [r[0] for r in exact], [min(g)[1] for g in near.values()]


def test_stages_match_brute_force(spark, tmp_path):
    rows = _rows()
    docs = spark.read.parquet(_small(spark, tmp_path, rows) + "/documents.parquet")
    want = _brute(rows)
    for (_, stage), ids in zip(corpus_pipeline.STAGES, want):
        docs = shared.written(stage(spark, docs, ""), "t")
        assert sorted(r.doc_id for r in docs.collect()) == sorted(ids)
    mixed = mixing.mix(docs).groupBy("doc_id").count().collect()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {r.doc_id: r["count"] for r in mixed}
    assert out.where("NOT same").count() == 0
    codec = sentencepiece_codec.Codec(sentencepiece_codec.read_pieces())
    assert all(codec.decode(r.ids) == r.text for r in out.collect())


def test_hard_tables(spark, tmp_path):
    names = ("copy", "copies", "near_of", "near_row", "kept", "fail_bits", "_row", "entry", "ids")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    rows = [(*r, *range(len(names))) for r in _rows()]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {tuple(r)[5:] for r in out.collect()} == {tuple(range(len(names)))}, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {"ids", "same", "copy"} <= set(last.columns) and last.count() == len(rows)


def test_nothing_is_left_behind(spark, tmp_path):
    before = len(shared._written)
    assert corpus_pipeline.run(spark, _small(spark, tmp_path, [])).count() == 0
    kept = [x.shared_path for x in shared._written[before:]]
    assert len(kept) <= 1 + 3  # the last stage's input, and nothing of the stages before
    assert not any("numbered" in p or "hash-index" in p for p in kept)

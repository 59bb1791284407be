from collections import Counter

from lodeworks.llm import quality


def brute(text):
    w = (text or "").split()
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + o for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if x.split()]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force(spark):
    texts = ["a b c a b c x", "a b c d", "", None, "x\nx\n y\n\n", "# $ %% é č!", "a a a a", " lead  and\ttrail ", "A B C d e f A B C d A B"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.ledger(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), texts[r.doc_id]


def test_verdicts_and_hard_inputs(docs, no_docs):
    out = {r.doc_id: r for r in quality.decide(quality.ledger(docs)).collect()}
    assert out[3].n_words == 0 and out[3].base_failed and not out[3].kept
    assert out[6].n_repeat_words == 20_000 and not out[6].kept
    assert len(quality.decide(quality.ledger(docs)).collect()) == 9
    assert quality.decide(quality.ledger(no_docs)).count() == 0


def test_clean_text_stays(spark):
    text = " ".join(f"word{i}" for i in range(60)) + "."
    row = quality.decide(quality.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert row.kept and row.fail_bits == 0


def test_ablation_is_counted_from_bits(docs):
    measured = quality.ledger(docs)
    bits = [r.fail_bits for r in measured.collect()]
    for r in quality.ablation(measured).collect():
        m = quality.POLICIES[r.version]
        assert r.rows == len(bits) and r.kept == sum(not b & m for b in bits)
        assert r.kept_without == sum(not b & m & ~(1 << r.rule) for b in bits)
        assert r.fails == sum(bool(b >> r.rule & 1) for b in bits)

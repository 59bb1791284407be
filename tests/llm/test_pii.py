import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeworks.llm import pii

TEXTS = [
    "mail Jo.81@mail7.example.com or jo.81@mail7.example.com",
    "from 16.195.23.156 not 999.1.1.1 nor 1.2.3.4.5",
    "card 4349000490986231 and 4111 1111 1111 1111 but 4111111111111112 fails",
    "call +1 (269) 555-3296 now",
    "born 1984-02-29 or 31.12.1999, never 2023-02-30",
    None,
    "",
    "nothing here 12345",
    "again 4349000490986231",
    "order 2021 4111 1111 1111 1111 and 4111 1111 1111 1111 4349000490986231 7, not 1234 5678 9012 3456 7",
    "due 12/31/1999 or 12.11.1999",
    "josé.Novák@mail.sk 12345678901234567890123@mail.sk иван.Ёлкин@mail.ru",
    "ssn 219-09-9999 not 666-12-1234 nor 219-00-1234",
]


@pytest.fixture(scope="module")
def done(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, found string")
    return pii.pseudonymise(df, "k").persist()


def test_finds_what_is_valid_and_nothing_else(done):
    kinds = {r.doc_id: [f.kind for f in r.found] for r in done.collect()}
    assert kinds == {0: ["email"] * 2, 1: ["ip"], 2: ["card"] * 2, 3: ["phone"], 4: ["date"] * 2, 5: [], 6: [], 7: [], 8: ["card"], 9: ["card"] * 3, 10: ["date"] * 2, 11: ["email"] * 3, 12: ["social"]}


def test_formats_links_and_absence(done):
    rows = {r.doc_id: r for r in done.collect()}
    shape = lambda s: "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in s)
    for r in rows.values():
        for f in r.found:
            assert f.pseudonym != f.value and f.pseudonym in r.text
            if f.kind != "ip":
                assert shape(f.pseudonym) == shape(f.value)
    assert rows[2].found[0].pseudonym == rows[8].found[0].pseudonym
    assert rows[5].text is None and rows[7].text == TEXTS[7]
    digits = [int(c) for c in rows[2].found[0].pseudonym][::-1]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def test_round_trip(done):
    back = pii.pseudonymise(done.select("doc_id", "text"), "k", back=True)
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(TEXTS))


def test_feistel_is_a_permutation(spark):
    v = spark.range(1000).select(pii.feistel(F.col("id"), 25, 40, "k", F.lit("t")).alias("v"))
    assert sorted(r.v for r in v.collect()) == list(range(1000))


def test_empty(no_docs):
    assert pii.pseudonymise(no_docs, "k").count() == 0


def test_cards_from_any_start_and_months_first(done):
    rows = {r.doc_id: r for r in done.collect()}
    assert [f.value for f in rows[9].found] == ["4111 1111 1111 1111", "4111 1111 1111 1111", "4349000490986231"]
    assert rows[9].text.startswith("order 2021 4") and rows[9].text.endswith(" 7, not 1234 5678 9012 3456 7")
    month, day = (int(x) for x in rows[10].found[0].pseudonym.split("/")[:2])
    assert month <= 12 < day
    assert [f.value for f in rows[11].found] == TEXTS[11].split()
    assert not any(c in rows[11].text for c in ("josé", "Ёлкин", "890123@"))


def test_random_values_go_round(spark):
    rng = random.Random(4)

    def luhn(body):
        total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(body)))
        return body + str(-total % 10)

    texts = []
    for i in range(400):
        card = luhn("4" + "".join(rng.choice("0123456789") for _ in range(14)))
        cut = " ".join(card[k : k + 4] for k in range(0, 16, 4))
        ssn = f"{rng.choice([x for x in range(1, 900) if x != 666]):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}"
        texts.append(f"{rng.randrange(1000, 9999)} {cut} {rng.randrange(10, 99)} . {ssn} . {rng.randrange(1, 13):02d}/{rng.randrange(13, 29)}/{rng.randrange(1800, 2200)} . {rng.randrange(10**22)}.é{i}@x.org")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    there = pii.pseudonymise(df, "k").persist()
    kinds = Counter(f.kind for r in there.collect() for f in r.found)
    assert kinds["social"] == kinds["date"] == kinds["email"] == 400 and kinds["card"] >= 400
    assert {r.doc_id: r.text for r in pii.pseudonymise(there.select("doc_id", "text"), "k", back=True).collect()} == dict(enumerate(texts))


def test_clashing_columns_stay(spark):
    names = ["_hits", "_parts", "_kinds", "kind", "value"]
    df = spark.createDataFrame([(1, "a@b.cz", *range(5))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    r = pii.pseudonymise(df, "k").first().asDict()
    assert [r[n] for n in names] == list(range(5)) and r["n_found"] == 1

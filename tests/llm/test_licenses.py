import os

from lodeworks.llm import licenses


def _scan(spark, text):
    return licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()


def test_canonical_forms_meet(spark):
    mit = next(t for n, _, t in licenses.KNOWN if n == "MIT")
    r = _scan(spark, "Copyright (c) 2020 Somebody Else\n" + mit.upper().replace(", ", " ,\n").replace("SUBLICENSE", "sublicence"))
    assert r.whole_license == "MIT" and r.permitted
    assert _scan(spark, mit + "\nAlso pay me.").whole_license is None


def test_lines_and_blocks(spark):
    r = _scan(spark, "Some prose here.\nReleased under the MIT Licence\nmore prose\n\nLicensed under CC BY-NC 4.0.")
    assert r.licenses == ["CC-BY-NC-4.0", "MIT"] and not r.permitted and r.whole_license is None
    assert _scan(spark, "It was released under the MIT License by them.").licenses == []


def test_hard_inputs(docs, no_docs):
    out = licenses.scan(docs)
    assert out.count() == 9 and out.where("size(licenses) > 0").count() == 0 and out.where("permitted").count() == 9
    assert licenses.scan(no_docs).count() == 0


def test_whole_licences_and_headers_are_known(spark):
    folder = "/usr/share/common-licenses"
    whole = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    for name, want in whole.items():
        if os.path.exists(f"{folder}/{name}"):
            with open(f"{folder}/{name}", encoding="utf-8") as f:
                assert _scan(spark, f.read()).whole_license == want
    for name, _, text in licenses.MORE:
        r = _scan(spark, "Copyright (c) 2021 Somebody\n\n" + text)
        assert r.whole_license == name and r.permitted
    assert _scan(spark, "Code.\n\n" + dict((n, t) for n, _, t in licenses.MORE)["AGPL-3.0"]).licenses == ["AGPL-3.0"]


def test_copyright_heads_are_left_out(spark):
    mit = next(t for n, _, t in licenses.KNOWN if n == "MIT")
    for head in ("Copyright (c) Jane Doe", "Copyright (c) 2001 Jane Doe\nAll rights reserved.", "© Jane Doe. All rights reserved.", "(c) 1999, 2001 Jane Doe\n  All Rights Reserved"):
        r = _scan(spark, f"{head}\n\n{mit}")
        assert r.whole_license == "MIT" and r.permitted, head
    r = _scan(spark, "Prose.\nAll rights reserved.\nMore prose.")
    assert r.licenses == ["Proprietary"] and not r.permitted
    # A line that begins like one but says something else stays.
    assert licenses.canonical("(c) You must keep this\ncopyright holder be liable") == "c you must keep this copyright owner be liable"


def test_spellings_of_two_words_cross_line_ends():
    assert licenses.canonical("the Copyright\n  Holders' per\ncent, at http") == "the copyright owners percent at http"


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.", 2, 3, 4, 5, "old")], "doc_id long, text string, scan_row int, row int, doc int, whole int, licenses string")
    r = licenses.scan(df).first().asDict()
    assert (r["scan_row"], r["row"], r["doc"], r["whole"], r["licenses"]) == (2, 3, 4, 5, ["MIT"])
    assert licenses.scan(df.select("text")).first().whole_license == "MIT"

import hashlib
from collections import Counter

import pytest

from lodeworks.llm import exact_dedup


def brute(rows):
    key = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    out = []
    for i, t in rows:
        same = [(-len(x or ""), 2**63 if j is None else j) for j, x in rows if key(x) == key(t)]
        keep = min(same)[1]
        out.append((i, None if keep == 2**63 else keep, len(same), hashlib.sha256(key(t).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("key_bits,bucket", [(64, 100_000), (2, 1)])
def test_groups_match_brute_force(docs, key_bits, bucket):
    rows = exact_dedup.groups(docs, key_bits=key_bits, bucket_entries=bucket, split_bytes=100).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == brute([(r.doc_id, r.text) for r in docs.collect()])
    kept = Counter(r.text_sha256 for r in rows if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in rows})


def test_directory_doubles_only_where_full():
    assert exact_dedup.directory({0: 5, 1: 5}, 2, 100) == [(0, 0)]
    assert exact_dedup.directory({0: 60, 1: 60, 2: 1}, 2, 100) == [(0, 2), (1, 2), (2, 1)]
    assert exact_dedup.directory({}, 2, 100, least=1) == [(0, 1), (2, 1)]
    assert exact_dedup.directory({0: 900}, 2, 100) == [(0, 2), (1, 2), (2, 1)]


def test_empty(no_docs):
    assert exact_dedup.groups(no_docs).count() == 0


def test_keep_one_keeps_columns(docs):
    out = exact_dedup.keep_one(docs)
    assert out.columns == docs.columns and out.count() == 5


def test_join_beyond_the_broadcast_bound(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", 0)
    rows = exact_dedup.groups(docs.repartition(3)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == brute([(r.doc_id, r.text) for r in docs.collect()])

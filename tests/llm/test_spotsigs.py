import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from lodestrata.llm import spotsigs
from tests.llm.common import empty_docs, odd_docs

ANCHORS = set(spotsigs.ANCHORS)


def plain_signatures(text):
    words = re.findall(r"[^\W_]+", text.lower())
    out = Counter()
    for i, w in enumerate(words):
        if w in ANCHORS:
            out[w, tuple([x for x in words[i + 1 : i + 1 + spotsigs.REACH] if x not in ANCHORS][:2])] += 1
        elif not any(x in ANCHORS for x in words[max(0, i - spotsigs.REACH) : i]):
            out[w] += 1
    return out if words else Counter([text] if text else [])


def plain_likeness(a, b):
    if not a and not b:
        return 1.0
    return (a & b).total() / (a | b).total()


@pytest.mark.parametrize("range_rows", [7, 4000])
def test_query_against_plain(spark, data, range_rows):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = spotsigs.edited_likeness(docs.repartition(3), range_rows=range_rows).collect()
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(r.doc_id for r in rows) == [i for i, _ in texts]
    by = {r.doc_id: r for r in rows}
    prints = {}
    for k, (i, text) in enumerate(texts):
        nxt = texts[(k + 1) % len(texts)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + nxt[:q]
        r = by[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own = plain_signatures(text)
        assert abs(r.near_edited - plain_likeness(own, plain_signatures(edited))) < 1e-9
        assert abs(r.near_next - plain_likeness(own, plain_signatures(nxt))) < 1e-9
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
    edited, next_ = [r.near_edited for r in rows], [r.near_next for r in rows]
    assert np.median(edited) > 0.5 > 0.1 > np.median(next_)


def test_odd_rows(spark):
    rows = spotsigs.edited_likeness(odd_docs(spark)).collect()
    assert len(rows) == 11
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    empty = [r for r in rows if r.n_chars == 0]
    assert len(empty) == 3 and len({r.fingerprint for r in empty}) == 1
    assert spotsigs.edited_likeness(empty_docs(spark)).count() == 0
    one = spark.createDataFrame([(5, "the cat sat by the old grey mill")], "doc_id long, text string")
    (r,) = spotsigs.edited_likeness(one).collect()
    assert r.near_next == 1.0 and r.n_chars == 32
    assert spotsigs.near_duplicates(odd_docs(spark)).count() == 11
    assert spotsigs.near_duplicates(empty_docs(spark)).count() == 0


def test_join_against_all_pairs(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = [plain_signatures(t) for _, t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if plain_likeness(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in spotsigs.near_duplicates(docs).collect()}
    assert got == {texts[i][0]: texts[find(i)][0] for i in range(len(texts))}

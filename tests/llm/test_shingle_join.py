"""The join of shingle sets against all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import shingle_join as J
from tests.llm.common import empty_docs, odd_docs


def shingle_set(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain(rows):
    """[(doc_id, n_shingles, component_id)] by comparing every pair."""
    sets = [shingle_set(t) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                at[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return sorted(((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def family(rng, n, words=60, edits=3, shared=0):
    """n texts with a few words changed each, after a passage that all share."""
    base = [f"w{rng.integers(400)}" for _ in range(words)]
    passage = [f"p{i}" for i in range(shared)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(int(rng.integers(edits + 1))):
            own[int(rng.integers(words))] = f"e{rng.integers(1000)}"
        out.append(" ".join(passage + own))
    return out


def texts_of(seed):
    rng = np.random.default_rng(seed)
    texts = [t for edits in (1, 3, 6) for _ in range(3) for t in family(rng, 12, edits=edits)]
    # Texts that are mostly one passage, near the bound, with own ends of all lengths.
    passage = [f"common{i}" for i in range(50)]
    texts += [" ".join(passage + [f"own{i}x{k}" for k in range(int(rng.integers(1, 30)))]) for i in range(40)]
    texts += [" ".join([f"own{i}x{k}" for k in range(int(rng.integers(1, 20)))] + passage) for i in range(40)]
    texts += ["a b c", "a b c", "A B c d", "", None, " \t", "a b c d e", "A b C d E", "a b c d e f"]
    return [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]


@pytest.mark.parametrize("late", [J.LATE, 0])
def test_against_all_pairs(spark, late):
    rows = texts_of(5)
    assert found(J.joined(spark.createDataFrame(rows, "doc_id long, text string"), late=late)) == plain(rows)


def test_short_parts_of_lists(spark, monkeypatch):
    monkeypatch.setattr(J, "PART", 3)
    monkeypatch.setattr(J, "HUB_TURNS", 0)
    rows = texts_of(6)
    assert found(J.joined(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert found(J.joined(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    docs = odd_docs(spark)
    assert found(J.joined(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert J.joined(empty_docs(spark)).count() == 0


def test_overlap_at_the_bound():
    """Partners from exactly 80 of 100 on; the probe stops early without changing that."""
    x = np.arange(0, 2000, dtype="<u8")
    for common, other in ((1600, 0), (1600, 1), (1599, 0), (1000, 0)):
        y = np.concatenate([x[:common], np.arange(5000, 5000 + other, dtype="<u8")])
        want = 100 * common >= 80 * (2000 + other)
        assert J.reaches(x, np.sort(y), 80) == J.reaches(np.sort(y), x, 80) == want
    for n in range(1, 200):
        for m in range(n, 200):
            need = J.required(n, m, 80)
            assert 100 * need >= 80 * (n + m - need) and 100 * (need - 1) < 80 * (n + m - need + 1)
            assert need > n or need >= J.least_shared(m, 80)


def test_bound_never_drops_a_partner():
    rng = np.random.default_rng(9)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        own = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        other = np.unique(np.concatenate([own[: int(len(own) * rng.random())], rng.integers(0, 2**63, int(rng.integers(1, 60))).astype(np.uint64)]))
        like = 100 * len(np.intersect1d(own, other)) >= 80 * len(np.union1d(own, other))
        batch = pa.RecordBatch.from_pydict({"a": [1], "b": [2], "na": [len(own)], "nb": [len(other)], "x": [J.parities(own)], "y": [J.parities(other)]})
        (kept,) = J.may_reach(80)([batch])
        assert kept.num_rows or not like
        assert J.reaches(own, other, 80) == like


def test_sketches_never_drop_a_partner():
    """The smaller set of each pair asks a list that holds the other: partners stay, whatever the sizes."""
    rng = np.random.default_rng(4)
    dropped = 0
    for _ in range(300):
        n = int(rng.integers(5, 900))
        own = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        other = np.unique(np.concatenate([own[: int(len(own) * rng.uniform(0.5, 1))], rng.integers(0, 2**63, int(rng.integers(1, 90))).astype(np.uint64)]))
        a, b = sorted((own, other), key=len)
        entry = {"node": 9, "n": len(b), "room": len(b), "label": 9, "sketch": J.sketch_of(J.parities(b))}
        kind = pa.list_(pa.struct([("node", pa.int64()), ("n", pa.int32()), ("room", pa.int32()), ("label", pa.int64()), ("sketch", pa.binary())]))
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([len(a)], pa.int32()), pa.array([len(a)], pa.int32()), pa.array([1]), pa.array([J.sketch_of(J.parities(a))], pa.binary()), pa.array([[entry]], kind)], names=["node", "n", "room", "label", "sketch", "list"])
        (kept,) = J._pruned(80)([batch])
        assert kept.to_pylist() in ([{"node": 1, "list": [9]}], [])
        dropped += not kept.num_rows
        assert kept.num_rows or not J.reaches(own, other, 80)
    assert dropped > 30

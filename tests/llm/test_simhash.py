from collections import defaultdict

import numpy as np
import pytest
import xxhash

from lodestrata.llm import simhash
from tests.llm.common import empty_docs, odd_docs


def plain_print(text):
    words = ((text or "").encode().lower()).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles)
        out |= (2 * ones > len(shingles)) << bit
    return out


def plain_components(prints):
    """{row: component} by comparing every pair."""
    ids = list(range(len(prints)))

    def root(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = root(i), root(j)
                ids[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_fingerprint_against_plain(spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(40).collect()] + ["", None, "one", "one two", "A b C d"]
    for t in texts:
        assert simhash.fingerprint(t) & (2**64 - 1) == plain_print(t)


@pytest.mark.parametrize("cross", [simhash.CROSS, 0])
def test_groups_against_all_pairs(spark, cross):
    rng = np.random.default_rng(3)
    prints = []
    for _ in range(25):
        base = int(rng.integers(0, 2**63))
        for _ in range(int(rng.integers(1, 12))):
            flips = rng.choice(64, int(rng.integers(0, 5)), replace=False)
            prints.append(base ^ sum(1 << int(i) for i in flips))
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id long, fp long")
    groups = {r.fp: r.component_id for r in simhash._groups(table, cross).collect()}
    assert [groups[p] for p in signed] == plain_components(prints)


@pytest.mark.parametrize("n", [500, 2000])
def test_links_of_near_copies_are_linear(spark, n):
    """One family within 3 bits of each other and one that shares a half without being near: pairs don't grow with n."""
    rng = np.random.default_rng(n)
    base = int(rng.integers(0, 2**62))
    near = [base] + [base ^ sum(1 << int(i) for i in rng.choice(63, 1 + k % 2, replace=False)) for k in range(n)]
    far = [(7 << 32) | int(x) for x in rng.integers(0, 2**31, n)]
    table = spark.createDataFrame([(p,) for p in dict.fromkeys(near + far)], "fp long")
    found = simhash.links(table).collect()
    assert len(found) <= 40 * table.count()
    assert {x for r in found for x in r} >= set(near)


def test_query_on_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    ids = sorted(rows)
    comps = plain_components([int(rows[i].fingerprint, 16) for i in ids])
    assert [rows[i].component_id for i in ids] == [ids[c] for c in comps]
    kept = sorted(r.doc_id for r in simhash.dedup(docs).collect())
    assert kept == sorted(set(r.component_id for r in rows.values()))


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 11
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.fingerprint, r.component_id))
    assert by[3] == by[4] == by[5] == {("0" * 16, 3)}
    assert by[1] == by[8]
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i) == [1, 2, 3, 6, 7] or sorted(i for i in ids if i) == [1, 3, 6, 7]
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0
    assert simhash.dedup(empty_docs(spark)).count() == 0

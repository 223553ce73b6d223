import re
from collections import defaultdict

import numpy as np
import pytest

from lodestrata.llm import mixing
from tests.llm.common import empty_docs, odd_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_sainte_lague(weights, seats):
    got = [0] * len(weights)
    for _ in range(seats):
        i = max(range(len(weights)), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


def test_sainte_lague_against_one_seat_at_a_time():
    rng = np.random.default_rng(1)
    for _ in range(60):
        weights = [float(x) for x in rng.integers(0, 50, int(rng.integers(1, 9)))]
        seats = int(rng.integers(0, 90))
        if sum(weights):
            assert mixing.sainte_lague(weights, seats) == plain_sainte_lague(weights, seats)


def plain_targets(sizes):
    """Reshares the excess round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, left = {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        for s in over:
            capped[s] = 2 * sizes[s]
            left -= capped[s]


@pytest.mark.parametrize("options", [{}, {"block_words": 32, "shard_words": 5000, "shard_docs": 7}])
def test_mix_of_documents(spark, data, options):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = mixing.mix(docs, **options).collect()
    texts = {r.doc_id: r for r in docs.collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.size == len(WORD.findall(texts[r.doc_id].text))
        assert 0 <= r.taken <= 2 * r.size
        sizes[texts[r.doc_id].source] += r.size
        taken[texts[r.doc_id].source] += r.taken
    goals = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - goals[r.source]) < 1e-6 * max(1, goals[r.source])
    for s, goal in goals.items():
        assert abs(taken[s] - goal) <= 128 + 0.02 * goal
    again = mixing.mix(docs.repartition(5), **options).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == 11
    assert {r.size for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    kept = mixing.mixed_documents(docs)
    assert kept.columns == docs.columns
    assert {3, 4, 5} <= {r.doc_id for r in kept.collect()}
    assert mixing.mix(empty_docs(spark)).count() == 0
    assert mixing.mixed_documents(empty_docs(spark)).count() == 0


def test_mixed_documents_come_near_the_targets(spark):
    rows = [(i, "w " * (50 + i % 90), "en", "ab"[i % 7 == 0], 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    goals = {r.source: r.target for r in mixing.mix(docs).collect()}
    got = defaultdict(int)
    for r in mixing.mixed_documents(docs).collect():
        got[r.source] += len(r.text.split())
    for s, goal in goals.items():
        assert abs(got[s] - goal) < 0.05 * goal


@pytest.mark.parametrize("options", [{}, {"shard_docs": 50}])
def test_long_documents_come_near_the_targets(spark, options):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(1500, 2500)), "en", "abc"[i % 3], 1) for i in range(960)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    goals = {r.source: r.target for r in mixing.mix(docs).collect()}
    got, times = defaultdict(int), defaultdict(int)
    for r in mixing.mixed_documents(docs, **options).collect():
        got[r.source] += len(r.text.split())
        times[r.doc_id] += 1
    assert max(times.values()) <= 2
    for s, goal in goals.items():
        assert abs(got[s] - goal) < 0.02 * goal


def test_shard_quotas_in_groups(spark):
    rows = [(s, i, 100 + (i * 37) % 50, 3 * 40) for s in ("a", None) for i in range(40)]
    cells = spark.createDataFrame(rows, "source string, shard long, shard_size long, blocks long")
    for size in (1000, 7):
        found = mixing.shard_quotas(cells, size).collect()
        assert len(found) == 80
        for s in ("a", None):
            assert sum(r.quota for r in found if r.source == s) == 120
            assert all(2 <= r.quota <= 4 for r in found)

"""Signatures of whole sets don't move: sets meet by their prefixes, whatever order these are in."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import spotsigs
from tests.growth import moved
from tests.llm.test_spotsigs import plain_likeness, plain_signatures


@pytest.mark.parametrize("late", [1, 32])
def test_sets_move_as_prefixes(spark, monkeypatch, late):
    """Texts of rare and of common words, families of near copies, and exact copies."""
    monkeypatch.setattr(spotsigs, "LATE", late, raising=False)
    r = random.Random(late)
    words = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in "bdfgkl"]
    line = lambda n, k: [w for _ in range(n) for w in ("the", *r.choices(words[:k], k=2))]
    texts = [line(60, len(words)) for _ in range(120)] + [line(r.randrange(3, 12), 4) for _ in range(40)]
    family = line(60, len(words))
    for _ in range(40):
        near = list(family)
        near[r.randrange(len(near))] = r.choice(words)
        texts.append(near)
    texts = [" ".join(t) for t in texts] + [" ".join(family)] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = []
    rows, _ = moved(spark, lambda: got.extend(spotsigs.near_duplicates(docs).collect()))
    sets = [plain_signatures(t) for t in texts]
    label, links = list(range(len(texts))), [set() for _ in texts]
    for i in range(len(texts)):
        for j in range(i):
            if plain_likeness(sets[i], sets[j]) >= 0.8:
                if sets[i] != sets[j]:
                    links[i].add(frozenset(sets[j].items()))
                    links[j].add(frozenset(sets[i].items()))
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert {g.doc_id: (g.component_id, g.n_links) for g in got} == {i: (label[i], len(links[i])) for i in range(len(texts))}
    whole = spotsigs.with_signatures(docs, "text", "sigs").agg(F.sum(F.size("sigs"))).first()[0]
    assert rows < whole, (rows, whole)

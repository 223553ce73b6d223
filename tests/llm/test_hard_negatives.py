"""Hard negatives against a plain version."""

from __future__ import annotations

import math

import duckdb
import numpy as np
from lodestrata.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    seen = {}
    for r in rows:
        v = r["embedding"]
        if r["vec_id"] is None or r["label"] is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]
        seen[r["vec_id"], label, tuple(math.floor(256 * float(x)) for x in v)] = None
    rows = list(seen)
    out = []
    for i, (a, label, v) in enumerate(rows):
        if a % 100:
            continue
        score = [(sum(x * y for x, y in zip(v, w)), b, other) for j, (b, other, w) in enumerate(rows) if j != i and len(w) == len(v)]
        order = sorted(score, key=lambda s: (-s[0], s[1]))
        for s, p, _ in [x for x in order if x[2] == label][:5]:
            window = [x for x in order if x[2] != label and 80 * s <= 100 * x[0] <= 100 * s][:5]
            out += [(a, p, k, n, s, t) for k, (t, n, _) in enumerate(window, 1)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def vectors(n, dim, labels, seed=0, step=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=dim)
    return [(i * step, [float(np.float32(x)) for x in base + 0.5 * rng.normal(size=dim)], int(rng.integers(labels))) for i in range(n)]


#: Blocks so small that few rows fill many.
SMALL = H.Sizes(rows=40, anchors=4, dimensions=5, strip=3)


def test_plain(spark):
    rows = vectors(400, 12, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain([dict(zip(("vec_id", "embedding", "label"), r)) for r in rows])
    assert want and found(H.hard_negatives(df, sizes=SMALL)) == want


def test_hot_and_rare_labels(spark):
    """One label holds most rows, many hold one, and one anchor has no other row of its label."""
    rows = [(i, v, 3 if i % 20 else 1000 + i) for i, v, _ in vectors(500, 6, 1, seed=2)]
    want = plain([dict(zip(("vec_id", "embedding", "label"), r)) for r in rows])
    assert want and found(H.hard_negatives(spark.createDataFrame(rows, SCHEMA), sizes=SMALL)) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [*vectors(120, 4, 3, seed=3), (100, None, 1), (200, [1.0, None, 2.0, 3.0], 1), (300, [nan, 1.0, 1.0, 1.0], 1), (400, [inf, 1.0, 1.0, 1.0], 1), (None, [1.0] * 4, 1), (600, [1.0] * 4, None), (700, [], 1)]
    rows += rows[:20] + [(0, [1.0, 1.0], 1), (800, [2.0, 2.0], 1), (801, [2.0, 1.5], 2), (803, [0.0] * 4, 0), (1100, [0.0] * 4, 0), (1101, [0.0] * 4, 0), (1102, [0.0] * 4, 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "vec_id AS dim", "1 AS block", "2 AS row", "'x' AS m", "3 AS value", "true AS small")
    want = plain([dict(zip(("vec_id", "embedding", "label"), r)) for r in rows])
    assert want and found(H.hard_negatives(df, sizes=SMALL)) == want


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 2.0], i % 2) for i in range(1, 300)] + [(0, [1.0, 2.0], 9)]
    got = found(H.hard_negatives(spark.createDataFrame(rows, SCHEMA), sizes=SMALL))
    assert got == plain([dict(zip(("vec_id", "embedding", "label"), r)) for r in rows])


def test_empty_table(spark):
    assert H.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert H.hard_negatives(spark.createDataFrame([(100, [1.0], 1)], SCHEMA)).count() == 0


def test_products_stay_exact_beyond_doubles():
    rng = np.random.default_rng(1)
    for most in (1 << 10, 1 << 28):
        a, b = (rng.integers(-most, most, size=(7, 32)) for _ in range(2))
        assert (H._product(a, b) == np.array([[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a])).all()


def test_against_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    r = con.sql(H.SQL)
    assert found(H.hard_negatives(spark.read.parquet(f"{data}/embeddings.parquet"))) == sorted(r.fetchall())

import numpy as np

from lodestrata.llm import graph_ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(rows, every, k):
    """{(query, rank): (vec_id, score)} over all rows."""
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], float)
    n = np.linalg.norm(v, axis=1)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = v @ v[q] / (n * n[q])
        order = [i for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def test_recall_on_embeddings(spark, data):
    data = data.replace("sf0.001", "sf0.1")
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    want = exact([(r.vec_id, r.embedding) for r in df.collect()], 50, 5)
    rows = graph_ann.nearest(df, 50, 5, shard_points=700).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.95
    for q, near in got.items():
        assert [s for _, s in near] == sorted((s for _, s in near), reverse=True)


def test_recall_at_the_registered_setting(spark, data):
    df = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    want = exact([(r.vec_id, r.embedding) for r in df.collect()], 50, 5)
    got = {}
    for r in graph_ann.nearest(df, 50, 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) / (5 * len(want)) >= 0.95


def test_visited_marks_in_parts(monkeypatch):
    v = np.random.default_rng(0).normal(size=(600, 8))
    graph = graph_ann.Graph(v)
    whole = graph.search(graph.unit[:100], 40)
    monkeypatch.setattr(graph_ann, "SEEN_BYTES", 1)
    parts = graph.search(graph.unit[:100], 40)
    assert (whole[0] == parts[0]).all()


def test_scaled_copies_of_one_direction(spark):
    # 30 lengths of one direction and 300 others: the smallest ids of the direction are nearest.
    rng = np.random.default_rng(1)
    way = np.array([3.0, 4.0, 0.0, 0.0])
    rows = [(i, (way * 2.0 ** (i % 30 - 15)).tolist(), 0) for i in range(30)] + [(1000 + i, rng.normal(size=4).tolist(), 0) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r["rank"], r.vec_id) for r in graph_ann.nearest(df, 50, 5).where("query_id = 0").collect())
    assert got == [(i, i) for i in range(1, 6)]


def test_copies_ties_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0], 0) for i in range(0, 40)] + [(50, [0.0, 1.0], 0), (51, [0.0, 2.0], 0), (100, [0.0, 0.0], 0), (150, None, 0), (200, [nan, 1.0], 0), (250, [inf, 1.0], 0), (300, [1.0, 2.0, 3.0], 0), (None, [1.0, 1.0], 0), (0, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS shard", "2 AS score", "3 AS v", "4 AS dim")
    got = {}
    for r in graph_ann.nearest(df, 50, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [0, 50]
    assert sorted(got[0]) == [(k, k, 1.0) for k in range(1, 6)]
    assert sorted(got[50])[0] == (1, 51, 1.0) and [v for _, v, _ in sorted(got[50])[1:]] == [0, 1, 2, 3]
    withnull = spark.createDataFrame([(0, [1.0, None], 0), (1, [1.0, 1.0], 0)], SCHEMA)
    assert graph_ann.nearest(withnull, 50, 5).count() == 0
    assert graph_ann.nearest(df.limit(0), 50, 5).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [-1.0, 0.0], 0)], SCHEMA)
    assert [(r["rank"], r.vec_id) for r in sorted(graph_ann.nearest(few, 50, 5).collect(), key=lambda r: r["rank"])] == [(1, 1), (2, 2)]

"""Searches around many centres: the same as by walking to everything, without doing it."""

import random

import duckdb
from pyspark.sql import functions as F

from lodestrata.operators import fulltext, graphwalk
from lodestrata.plans import graph
from tests.growth import moved


def test_nearest_edges_against_whole_walks(spark):
    """Hubs, loops, parallel edges, repeated ids, null ends and ids, centres without edges."""
    for seed, asked in enumerate([((0, 3), (4, 50)), ((2, 4), (3, 2))]):
        r = random.Random(seed)
        edges = [(i, r.randrange(40), -1 - r.randrange(40)) for i in range(50)] + [(100 + i, 0, i) for i in range(30)]
        edges += [(7, 3, 4), (7, 3, 4), (8, 5, 5), (200, None, 6), (201, 6, None), (202, None, None), (None, 9, -2), (203, 50, 51), (204, 51, 52), (205, 52, 53), (206, 53, 54), (207, 54, 55)]
        e = spark.createDataFrame(edges, "id long, a long, b long")
        centres = spark.createDataFrame([(i,) for i in [*range(0, 40, 3), 50, 50, 999, None]], "c long")
        for depth, limit in asked:
            reached = graphwalk.distances(e, "a", "b", centres, "c", depth)
            whole = graphwalk.ranked(graphwalk.edges_by_distance(e, "a", "b", "id", reached), ["centre"], [F.col("distance"), F.col("edge").asc_nulls_last()], limit)
            got = graphwalk.nearest_edges(e, "a", "b", "id", centres, "c", depth, limit)
            columns = ("centre", "edge", "distance", "rank")
            assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, whole.select(*columns).collect()))


def test_best_of_recurring_texts_against_all_rows(spark):
    r = random.Random(1)
    texts = ["red widget", "blue ring", "red ring ring", "", None, "old red widget of stone", "ring"]
    docs = spark.createDataFrame([(i, r.choice(texts)) for i in range(90)] + [(90, "red stone")], "doc long, text string")
    asked = spark.createDataFrame([("red ring",), ("stone",), ("blue widget old of",), ("none",)], "q string")
    terms = fulltext.questions(asked, "q", F.col("q"), [], 1, 4)
    for limit in (1, 5, 200):
        whole = fulltext.best(fulltext.bm25(docs, "doc", F.col("text"), terms), limit)
        got = fulltext.best_of_recurring(docs, "doc", "text", terms, limit)
        assert whole.count() and sorted(got.select("question", "doc", "score", "rank").collect()) == sorted(whole.select("question", "doc", "score", "rank").collect())


def _graph(folder, suppliers):
    """Twelve relations a supplier to the objects that all share; every twentieth supplier is a centre."""
    folder.mkdir()
    con = duckdb.connect()
    con.sql(f"""CREATE TABLE lineitem AS SELECT s * 12 + i AS l_orderkey, CASE WHEN i % 3 = 0 THEN 5 ELSE 1 END AS l_linenumber, 1 + 3 * ((s * 7 + i * i * 5) % 40) AS l_partkey, s AS l_suppkey, 20.0::DOUBLE AS l_quantity, 10.0::DOUBLE AS l_extendedprice, 0.05::DOUBLE AS l_discount,
        0.05::DOUBLE AS l_tax, DATE '1996-06-15' AS l_shipdate, 'N' AS l_returnflag, 'O' AS l_linestatus FROM range({suppliers}) t(s), range(12) u(i)""")
    con.sql("CREATE TABLE orders AS SELECT l_orderkey AS o_orderkey, l_orderkey % 50 AS o_custkey FROM lineitem")
    con.sql(f"CREATE TABLE supplier AS SELECT s AS s_suppkey FROM range({suppliers}) t(s)")
    con.sql("CREATE TABLE part AS SELECT p AS p_partkey, ['red', 'blue', 'old'][1 + p % 3] || ' ' || ['ring', 'rod'][1 + p % 2] AS p_name FROM range(150) t(p)")
    for t in ("lineitem", "orders", "supplier", "part"):
        con.sql(f"COPY {t} TO '{folder}/{t}.parquet'")
    return str(folder), con


def test_edges_near_centres_grow_with_the_table(spark, tmp_path):
    rows = []
    for n in (200, 1600):
        d, con = _graph(tmp_path / str(n), n)
        got = []
        rows.append(moved(spark, lambda d=d, got=got: got.extend(graph.edges_near_centre(spark, d).collect()))[0])
        assert sorted(map(tuple, got)) == sorted(con.sql(f"SELECT centre, edge, score, rank FROM ({graph.ORACLES['edges_near_centre']})").fetchall())
    assert rows[1] < 9 * rows[0], rows


def test_distances_against_plain_walks(spark):
    """Loops, parallel edges, null ends, centres that no edge touches, blocks of centres that aren't whole."""
    r = random.Random(5)
    edges = [(r.randrange(60), -1 - r.randrange(60)) for _ in range(70)] + [(0, i) for i in range(100, 140)] + [(5, 5), (None, 6), (6, None), (7, -3), (7, -3)]
    ways = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            ways.setdefault(a, set()).add(b)
            ways.setdefault(b, set()).add(a)
    centres = [*range(0, 60, 2), 2, None, 900]
    wanted = {}
    for c in {*centres} - {None}:
        at = {c}
        for step in range(4):
            wanted.update({(c, n): step for n in at if (c, n) not in wanted})
            at = {m for n in at for m in ways.get(n, ())}
    e, s = spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(c,) for c in centres], "c long")
    got = graphwalk.distances(e, "a", "b", s, "c", 3).select("centre", "node", "distance").collect()
    assert len(got) == len(wanted) and {(c, n): k for c, n, k in got} == wanted
    assert graphwalk.distances(e, "a", "b", s.limit(0), "c", 3).count() == 0


def test_sets_in_batches():
    """Short sets and bitmaps, and sets of one node in several batches."""
    import numpy as np
    import pyarrow as pa

    from lodestrata.operators import marks

    r = np.random.default_rng(2)
    sets = [set(r.choice(marks.BLOCK, n, replace=False).tolist()) for n in (0, 1, 511, 512, 513, marks.BLOCK, 3, 3000, 40, 9)]
    raw = [marks.packed(np.packbits(np.isin(np.arange(marks.BLOCK), list(s)), bitorder="little")) for s in sets]
    back = np.unpackbits(marks.bitmaps(pa.array(raw, pa.binary())), axis=1, bitorder="little")
    assert [set(np.flatnonzero(b).tolist()) for b in back] == sets and max(map(len, raw)) == marks.BYTES
    nodes = [4, 4, 4, 5, 5, 6, 6, 6, 6, 7]
    new = [True, False, True, True, True, False, True, True, True, False]
    batch = pa.record_batch({"node": nodes, "block": pa.array([0] * 10, pa.int64()), "bits": pa.array(raw, pa.binary()), "new": new})
    for size in (1, 3, 10):
        cut = [batch.slice(i, size) for i in range(0, 10, size)]
        fresh, joined = {}, {}
        for n, s, is_new in zip(nodes, sets, new):
            fresh.setdefault(n, [set(), set()])[not is_new].update(s)
            joined.setdefault(n, set()).update(s)
        for run, wanted in ((marks.news, {n: a - b for n, (a, b) in fresh.items() if a - b}), (marks.united, joined)):
            got = {}
            for out in run(iter(cut)):
                for n, b in zip(out.column(0).to_pylist(), marks.bitmaps(out.column(2))):
                    assert n not in got
                    got[n] = set(np.flatnonzero(np.unpackbits(b, bitorder="little")).tolist())
            assert got == wanted


def test_distances_store_no_pairs(spark, tmp_path):
    """What is moved grows with the table, while what comes out grows with centres times nodes."""
    found = []
    for n in (200, 1600):
        d, con = _graph(tmp_path / str(n), n)
        got = []
        rows = moved(spark, lambda d=d, got=got: got.extend(graph.graph_distances(spark, d).collect()))[0]
        assert sorted(map(tuple, got)) == sorted(con.sql(f"SELECT centre, node, distance FROM ({graph.ORACLES['graph_distances']})").fetchall())
        found.append((rows, len(got)))
    assert found[1][1] > 30 * found[0][1] and found[1][0] < 9 * found[0][0], found

"""The sweep against all pairs, one key with very many rows, and the order of two periods against the plain rule."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import judging as J
from lodestrata.operators import intervals

SCHEMA = "k int, id long, a date, b date, v long"


def day(n):
    return datetime.date(1999, 1, 1) + datetime.timedelta(n)


def test_against_all_pairs(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        a = r.randrange(300)
        b = a + r.choice([0, 1, 7, 40, 200, -3])
        rows.append((r.randrange(3), i, None if r.random() < 0.05 else day(a), None if r.random() < 0.05 else day(b), None if r.random() < 0.05 else r.randrange(1000)))
    rows += [(9, 1000, datetime.date(1200, 1, 1), datetime.date(9999, 12, 31), 5), (9, 1001, day(3), day(3), 6), (9, 1002, datetime.date(9000, 1, 1), datetime.date(9000, 1, 2), 7)]
    loose = lambda x: x[2] is None or x[3] is None or x[3] < x[2]
    for got in intervals.extremes_of_overlapping(spark.createDataFrame(rows, SCHEMA), ["k"], "a", "b", "v", "id").collect():
        x = (got.k, got.id, got.a, got.b, got.v)
        met = [y for y in rows if y[0] == x[0] and (loose(x) or loose(y) or x[2] <= y[3] and y[2] <= x[3])]
        values = [y[4] for y in met if y[4] is not None]
        assert (got.least, got.most, got.first_id, got.last_id) == (min(values, default=None), max(values, default=None), min(y[1] for y in met), max(y[1] for y in met))


def test_nodes_make_up_the_days(spark):
    rows = spark.range(200).selectExpr("id AS s", "id + (id * 37) % 50 - 1 AS e").select("s", "e", intervals.nodes(F.col("s"), F.col("e")).alias("n")).collect()
    for r in rows:
        days = sorted(x for n in r.n for x in range(n["at"] << n["level"], (n["at"] + 1) << n["level"]))
        assert days == list(range(r.s, r.e + 1))


def test_one_key_with_very_many_rows(spark):
    """100,000 figures of one key: 10 billion pairs that a join would make."""
    rows = spark.range(100_000).selectExpr("1 AS k", "id", "date_add(DATE '1990-01-01', CAST(id % 3000 AS INT)) AS a", "date_add(DATE '1990-01-01', CAST(id % 3000 + 30 AS INT)) AS b", "id % 3000 AS v")
    got = intervals.extremes_of_overlapping(rows, ["k"], "a", "b", "v", "id").agg(F.count("*"), F.max(F.col("most") - F.col("v")), F.max(F.col("v") - F.col("least"))).first()
    assert tuple(got) == (100_000, 30, 30)


def plain_order(nf, nt, np_, of, ot, op):
    if ot and nf and ot <= nf:
        return "supersede"
    if nt and of and nt <= of:
        return "history"
    if nf is None or of is None:
        return "conflict"
    early, late = sorted((nf, of))
    months = (late.year - early.year) * 12 + late.month - early.month - (late.day < early.day)
    if (np_ or op) and months <= 12 or ot and ot > nf or nt and nt > of or nf.year == of.year:
        return "conflict"
    return "supersede" if nf.year > of.year else "history"


def test_succession(spark):
    r = random.Random(5)
    pick = lambda: None if r.random() < 0.3 else day(r.randrange(1500))
    rows = [tuple(f() for f in (pick, pick, lambda: r.random() < 0.3) * 2) for _ in range(600)]
    df = spark.createDataFrame(rows, "nf date, nt date, np boolean, of date, ot date, op boolean")
    side = lambda p: F.struct(F.col(p + "f").alias("valid_from"), F.col(p + "t").alias("valid_to"), F.col(p + "p").alias("from_proxy"))
    got = df.select("*", side("n").alias("new"), side("o").alias("old")).select("*", J.succession("new", "old", J.Policy()).alias("out")).collect()
    assert all(x.out == plain_order(*x[:6]) for x in got) and len({x.out for x in got}) == 3


@pytest.mark.parametrize("percent", [True, False])
def test_bounds_of_agreement(spark, percent):
    policy = J.Policy()
    pairs = [(a, b) for a in (-5000, -100, -99, -98, 0, 49, 98, 99, 100, 102, 103, 4950, 5000) for b in (-5100, -100, -98, 0, 1, 50, 98, 100, 102, 5000, 5050)]
    df = spark.createDataFrame(pairs, "a long, b long")
    low, high = J.agreeing_values(F.col("a"), F.lit(percent), policy)
    within = (F.col("b") >= low - 1e-6) & (F.col("b") <= high + 1e-6)
    assert df.where(within != J.values_agree(F.col("a"), F.col("b"), F.lit(percent), policy)).collect() == []

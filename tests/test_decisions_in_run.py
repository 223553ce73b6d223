"""Decisions within runs: what is alone with its key costs no sweep."""

import random

from lodestrata.plans import judging
from tests.growth import moved
from tests.test_decisions import folder, outcomes  # noqa: F401


def test_lone_figures_move_once(spark, folder):  # noqa: F811
    """Most runs have one figure of a key; some have more, of one city or of two (an order that stands twice)."""
    r = random.Random(3)
    lines = [{"l_orderkey": i, "l_discount": r.choice([0.02, 0.021, 0.04]), "l_partkey": 6 * r.randrange(1, 9), "l_suppkey": r.randrange(4), "l_quantity": r.choice([2.0, 20.0, 48.0]), "l_linenumber": i % 7, "l_extendedprice": float(i)} for i in range(1, 2500)]
    lines += [{"l_orderkey": i, "l_discount": d, "l_quantity": q, "l_linenumber": 8 + j, "l_extendedprice": 1.0 + j} for i in range(1, 30) for j, (d, q) in enumerate(r.choices([(0.02, 20.0), (0.022, 48.0), (0.05, 20.0)], k=3))]
    d, con = folder(lines)
    con.sql("INSERT INTO orders VALUES (3, 7), (5, 105), (9, NULL)")
    con.sql(f"COPY orders TO '{d}/orders.parquet'")
    got = set(outcomes(spark, (d, con), "statistic_decisions_in_run"))
    assert got >= {"novel", "agrees", "conflicts"}
    rows, _ = moved(spark, lambda: judging.statistic_decisions_in_run(spark, d).collect())
    assert rows < 12 * len(lines), rows

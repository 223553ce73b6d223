"""Decisions on figures and relations meet all claims of their key, of other runs and cities too."""

import datetime
import random

import duckdb
import pytest

from lodestrata.plans import judging


@pytest.fixture
def folder(tmp_path):
    """Builds a folder of orders and their lines; lines are given by what differs from a plain one."""

    def build(lines):
        con = duckdb.connect()
        con.sql("CREATE TABLE lineitem (l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_shipdate DATE, l_returnflag VARCHAR, l_linestatus VARCHAR)")
        plain = {"l_linenumber": 1, "l_partkey": 6, "l_suppkey": 0, "l_quantity": 20.0, "l_extendedprice": 10.0, "l_discount": 0.05, "l_tax": 0.05, "l_shipdate": "1996-06-15", "l_returnflag": "N", "l_linestatus": "O"}
        for at, line in enumerate(lines, 1):
            row = {"l_orderkey": at, **plain, **line}
            con.execute(f"INSERT INTO lineitem ({', '.join(row)}) VALUES ({', '.join('?' * len(row))})", list(row.values()))
        con.sql("CREATE TABLE orders AS SELECT DISTINCT l_orderkey AS o_orderkey, 100 + l_orderkey AS o_custkey FROM lineitem")
        for t in ("lineitem", "orders"):
            con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
        return str(tmp_path), con

    return build


def outcomes(spark, built, name):
    """Outcomes in order of claim_id, which are those of the SQL."""
    d, con = built
    got = sorted(map(tuple, judging.QUERIES[name](spark, d).select("claim_id", "outcome").collect()))
    assert got == sorted(con.sql(f"SELECT claim_id, outcome FROM ({judging.ORACLES[name]})").fetchall())
    return [outcome for _, outcome in got]


def test_figures_of_other_runs_and_cities_count(spark, folder):
    """Three runs: two figures that differ by two points, and one of its own key."""
    built = folder([{"l_discount": 0.02}, {"l_discount": 0.04}, {"l_partkey": 12}])
    assert outcomes(spark, built, "statistic_decisions_in_run") == ["novel"] * 3
    assert outcomes(spark, built, "statistic_decisions") == ["conflicts", "conflicts", "novel"]
    assert outcomes(spark, folder([{}, {}]), "statistic_decisions") == ["agrees", "agrees"]


def test_relations_of_other_runs_and_cities_count(spark, folder):
    """GOVERNS of one object: two subjects without an end, years apart, and one object of its own."""
    edge = {"l_partkey": 1, "l_tax": 0.05}
    built = folder([{**edge, "l_suppkey": 1, "l_shipdate": "1993-01-01"}, {**edge, "l_suppkey": 2}, {**edge, "l_partkey": 4}])
    assert outcomes(spark, built, "relation_decisions_in_run") == ["novel"] * 3
    assert outcomes(spark, built, "relation_decisions") == ["history", "supersedes", "novel"]


def test_relations_of_all_kinds(spark, folder):
    """Ends, proxies, ends of months, leap years, missing values and repeated rows, within runs and across them."""
    r, lines = random.Random(7), []
    for i in range(700):
        day = datetime.date(1995, 1, 1) + datetime.timedelta(r.randrange(800)) if r.random() < 0.6 else r.choice([datetime.date(y, m, d) for y in (1995, 1996, 1997) for m, d in ((1, 31), (2, 28), (3, 1), (3, 31), (12, 31), (1, 1))] + [datetime.date(1996, 2, 29)])
        lines.append({
            "l_orderkey": r.choice([i + 1, 7]), "l_linenumber": r.choice([1, 5, 6, 2]), "l_partkey": 1 + 3 * r.randrange(60) if r.random() < 0.98 else None, "l_suppkey": r.randrange(6) if r.random() < 0.9 else None,
            "l_quantity": r.choice([5.0, 20.0, None]), "l_extendedprice": i + 1.0 if r.random() < 0.98 else None, "l_discount": r.choice([0.0, 0.05, 0.05]), "l_tax": r.choice([0.0, 0.05, 0.05, 0.05, None]), "l_shipdate": day if r.random() < 0.95 else None,
        })
    lines += lines[:40]
    built = folder(lines)
    key = lambda x: (x[0] is None, x)
    d, con = built
    for name in ("relation_decisions", "relation_decisions_in_run"):
        got = sorted(map(tuple, judging.QUERIES[name](spark, d).select("claim_id", "outcome").collect()), key=key)
        assert got == sorted(con.sql(f"SELECT claim_id, outcome FROM ({judging.ORACLES[name]})").fetchall(), key=key), name
        assert {x for _, x in got} == {"conflicts", "history", "supersedes", "agrees", "novel"}

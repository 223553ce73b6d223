"""Every query with an oracle against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lodestrata.plans import catalogue


def plain(v):
    return (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, data, duck, name):
    df, rel = catalogue.queries()[name](spark, data), duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    places = [rel.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[i]) for i in places) for r in rel.fetchall()), key=repr)
    assert got == want


def test_entry_and_guard(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_hashed_vectors_against_plain(spark, data):
    import re
    import zlib

    texts = {r.item_id: r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    for r in catalogue.queries()["hashed_vectors"](spark, data).collect():
        counts = [0] * 16
        for w in re.findall("[a-z]+", texts[r.item_id].lower()):
            counts[zlib.crc32(w.encode()) % 16] += 1
        length = math.sqrt(sum(c * c for c in counts))
        assert [float(x) for x in r.vector.split()] == pytest.approx([c / length for c in counts], abs=1e-4)

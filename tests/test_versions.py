"""Tables that change together: whole versions, writers that die, writers that meet, purges."""

import pytest

from lodestrata.sources import versions as V


def test_versions(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    assert V.latest(spark, store) == 0 and V.tables(spark, store) == {}
    one = V.commit(spark, store, {"claims": spark.range(3), "edges": spark.range(2)}, 0)
    claims = V.read(spark, store, "claims", one)
    two = V.commit(spark, store, {"claims": claims.union(spark.range(10, 12))}, one)
    assert (one, two) == (1, 2) and V.read(spark, store, "claims").count() == 5 and claims.count() == 3
    assert V.read(spark, store, "edges").count() == 2
    with pytest.raises(V.Conflict):
        V.commit(spark, store, {"edges": None}, one)
    assert sorted(V.tables(spark, store)) == ["claims", "edges"]
    three = V.commit(spark, store, {"edges": None}, two)
    assert sorted(V.tables(spark, store)) == ["claims"] and sorted(V.tables(spark, store, two)) == ["claims", "edges"]
    gone = V.purge(spark, store, 1)
    assert three == 3 and [g.split("-")[0] for g in gone] == ["claims", "edges"]
    assert V.read(spark, store, "claims").count() == 5


def test_a_writer_that_dies_changes_nothing(spark, tmp_path):
    """The second of two tables can't be written: neither changes, and the next commit is the next version."""
    store = f"file://{tmp_path}/store"
    one = V.commit(spark, store, {"claims": spark.range(3), "edges": spark.range(2)}, 0)
    broken = spark.range(5).selectExpr("CAST(raise_error('killed') AS BIGINT) AS id")
    with pytest.raises(Exception, match="killed"):
        V.commit(spark, store, {"claims": spark.range(9), "edges": broken}, one)
    assert V.latest(spark, store) == 1 and V.read(spark, store, "claims").count() == 3 and V.read(spark, store, "edges").count() == 2
    assert V.commit(spark, store, {"edges": spark.range(7)}, one) == 2
    assert V.purge(spark, store, 2) and V.read(spark, store, "edges", 1).count() == 2

"""State machines of runs as streams, with late, early and repeated events, and their batch forms."""

import datetime

import pytest

from lodestrata.streaming import runs


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


@pytest.fixture
def rocks(spark):
    spark.conf.set(runs.STORE, runs.ROCKS)
    yield spark
    spark.conf.unset(runs.STORE)


def streamed(spark, tmp_path, schema, batches, build):
    """The rows that a stream gives, each batch a file of its own and a trigger of its own, in order."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    return spark.read.parquet(out).collect()


LEASE = "run long, id long, at timestamp, owner string, kind string"


def test_leases(rocks, tmp_path):
    batches = [
        [(1, 1, at(0), "a", "claim"), (1, 2, at(1), "b", "claim"), (1, 3, at(4), "a", "heartbeat"), (2, 4, at(0), "c", "claim")],
        [(1, 3, at(4), "a", "heartbeat"), (1, 5, at(2), "a", "heartbeat"), (1, 6, at(9), "b", "claim"), (1, 7, at(9), "a", "heartbeat")],
        [(1, 8, at(10), "b", "claim"), (1, 9, at(11), "b", "finish"), (1, 10, at(12), "a", "claim"), (2, 11, at(3), "c", "finish")],
        [(3, 12, at(100), "z", "claim")],
        [(3, 13, at(101), "z", "heartbeat")],
    ]
    rows = streamed(rocks, tmp_path, LEASE, batches, lambda s: runs.streamed_leases(s, 300))
    got = {r.id: r.outcome for r in rows if r.id > 0}
    assert len([r for r in rows if r.id > 0]) == len(got)
    assert got == {1: "granted", 2: "refused", 3: "renewed", 4: "granted", 5: "late", 6: "refused", 7: "renewed", 8: "refused", 9: "refused", 10: "renewed", 11: "finished", 12: "granted", 13: "renewed"}
    # The watermark passed the end of run 1's lease; run 2 was finished, run 3 is alive.
    assert [(r.run, r.owner, r.at) for r in rows if r.outcome == "stranded"] == [(1, "a", at(17))]


def test_takeover_in_batch(spark):
    rows = [(1, 1, at(0), "a", "claim"), (1, 2, at(5), "b", "claim"), (1, 3, at(5.1), "b", "claim"), (1, 4, at(6), "a", "heartbeat"), (1, 4, at(6), "a", "heartbeat"), (1, 5, at(7), "b", "finish"), (1, 6, at(30), "a", "claim"), (2, 7, at(1), "a", "heartbeat")]
    got = [(r.id, r.outcome) for r in runs.leases(spark.createDataFrame(rows, LEASE), 300).orderBy("id").collect()]
    assert got == [(1, "granted"), (2, "refused"), (3, "taken over"), (4, "refused"), (5, "finished"), (6, "over"), (7, "refused")]
    assert runs.leases(spark.createDataFrame([], LEASE), 300).count() == 0


def test_budgets(rocks, tmp_path):
    schema = "run long, id long, at timestamp, calls long, cost long"
    batches = [[(1, i, at(i), 1, 10 * i) for i in range(1, 8)], [(1, 7, at(7), 1, 70), (1, 8, at(8), 1, 80), (1, 9, at(9), 1, 90), (1, 10, at(10), 1, 0), (2, 11, at(10), 100, 0)], [(1, 12, at(11), 5, 5)]]
    rows = streamed(rocks, tmp_path, schema, batches, lambda s: runs.streamed_budgets(s, {"calls": 10, "cost": 300}))
    assert sorted(tuple(r) for r in rows) == [(1, "calls", "refused", 10, 10), (1, "calls", "warning", 9, 9), (1, "cost", "refused", 8, 360), (1, "cost", "warning", 7, 280), (2, "calls", "refused", 11, 100), (2, "calls", "warning", 11, 100)]


def test_followed(rocks, tmp_path):
    schema = "run long, seq long, at timestamp, kind string"
    batches = [
        [(1, s, at(s), "step") for s in (1, 2, 5, 3)],
        [(1, 5, at(5), "step"), (1, 4, at(4), "step"), (2, 3, at(4), "step")],
        [(1, 7, at(7), "step"), (1, 6, at(6), "end"), (9, 1, at(40), "step")],
        [(1, 8, at(39), "step"), (9, 3, at(41), "step")],
        [(9, 4, at(43), "step")],
    ]
    rows = streamed(rocks, tmp_path, schema, batches, lambda s: runs.followed(s, 2, ["end"], 600))
    assert [(r.seq, r.kind) for r in sorted((r for r in rows if r.run == 1), key=lambda r: r.seq)] == [(3, "step"), (4, "step"), (5, "step"), (6, "end")]
    assert sorted(r.seq for r in rows if r.run == 9 and r.kind == "step") == [3, 4]
    beats = [r for r in rows if r.kind == "heartbeat"]
    assert beats and {r.run for r in beats} == {2} and {r.seq for r in beats} == {3}


def test_the_store_is_asked_for(spark):
    stream = spark.readStream.format("rate").load().selectExpr("value AS run", "value AS id", "timestamp AS at", "'a' AS owner", "'claim' AS kind")
    with pytest.raises(ValueError, match="RocksDB"):
        runs.streamed_leases(stream, 300)

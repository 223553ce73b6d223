"""Filter audit against a plain version, with copies over many partitions."""

from __future__ import annotations

import re
from itertools import permutations

import duckdb
import pytest

from lodestrata.llm import filter_audit as A
from tests.llm.common import DOCS, empty_docs, odd_docs

LABELS = "doc_id long, quality int, toxic int"


def plain_mask(text: str, doc_id, least) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    failed = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), doc_id is not None and least is not None and least < doc_id]
    return sum(1 << i for i, x in enumerate(failed) if x)


def plain(docs, labels):
    least, good, toxic, rows = {}, set(), set(), {}
    for d in docs:
        if d.doc_id is not None:
            least[d.text or ""] = min(d.doc_id, least.get(d.text or "", d.doc_id))
    for x in labels:
        good |= {x.doc_id} if x.quality == 1 else set()
        toxic |= {x.doc_id} if x.toxic == 1 else set()
    for d in docs:
        mask = plain_mask(d.text or "", d.doc_id, least.get(d.text or ""))
        fails = {c for i, c in enumerate("ABCDE") if mask >> i & 1}
        for order in permutations("ABCDE"):
            for step, own in enumerate(order, 1):
                r = rows.setdefault((d.lang or "", "".join(order), step), [0] * 7)
                before = fails & set(order[: step - 1])
                r[0] += not before and own not in fails
                r[1] += own in fails and not before
                r[2] += own in fails and bool(before)
                r[3] += fails == {own}
                r[4] += own in fails and not before and d.doc_id is not None and d.doc_id in good
                r[5] += own in fails and not before and d.doc_id is not None and d.doc_id in toxic
                r[6] += 120 // len(fails) if own in fails else 0
    return rows


def found(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (8, 1, 1), (None, 1, 1), (3, None, 1), (99, 1, 1)], LABELS)
    assert found(A.audit(docs, labels)) == plain(docs.collect(), labels.collect())


def test_empty_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    assert A.audit(empty_docs(spark), labels).count() == 0
    assert len(found(A.audit(spark.createDataFrame([(1, "x", None, None, 1)], DOCS), labels))) == 600


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_copies_span_partitions(spark, partitions):
    same = [(i, "one text that many share", "en", "a", 1) for i in range(700, 1, -1)]
    other = [(i, f"text {i % 50}", "de", "b", 1) for i in range(1000, 1200)]
    docs = spark.createDataFrame([*same, *other, *same[:5], (None, "text 1", "de", "b", 1)], DOCS).repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = A.masks(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    first = {r.doc_id for r in rows if not r.mask & 16}
    assert first == {2, None, *range(1000, 1050)} and len(rows) == len(same) + len(other) + 6


def test_texts_that_share_a_fingerprint():
    """Two texts under one fingerprint in two partitions: each partition reports both texts."""
    import pyarrow as pa

    def part(rows):
        columns = [pa.array(["x"] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())]
        return [r for b in A._compared(iter([pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "fp", "text"])])) for r in b.to_pylist()]

    rows = part([(1, 5, b"a"), (3, 5, b"a"), (2, 5, b"b"), (9, 6, b"c"), (4, 7, b"d"), (5, 8, b"e")])
    assert [r["mask"] & 16 for r in rows if r["mask"] is not None] == [0, 16, 0, 0, 0, 0]
    assert sorted(r["first"] for r in rows if r["mask"] is None) == [1, 2, 5]


def test_against_sql(spark, data):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    want = {tuple(r[:3]): list(r[3:]) for r in con.sql(A.SQL).fetchall()}
    got = found(A.audit(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")))
    assert got == want

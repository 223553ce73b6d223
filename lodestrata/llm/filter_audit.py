"""How text filters interact: what each removes first, again or alone, in every order they could run in.

Filters fail a text (null counts as empty) on its words, the `[^\\x20\\x09-\\x0D]+` in it: A, under 200 of them; B, fewer
than half of them distinct; C, more than 3 % of its characters are A to Z; D, a character of `#$%&*|`; E, the same text
under a smaller doc_id.

E comes from one sort: rows are dealt out by ranges of (text fingerprint, doc_id), sorted by (fingerprint, text, doc_id)
in each, and compared with the row before. A group of copies may span any number of ranges, so each task also reports
the texts of its first and last fingerprint with their smallest id; a text that two tasks report has the smaller one.
That report holds two texts a task (more only where different texts share a fingerprint), so it is broadcast.

The failures of a row are a mask of five bits. Counters of (part, mask) are additive, at most 32 a part, and all that
is asked of the 120 orders follows from them.

A null doc_id is smaller than none and none is smaller than it; rows with one have no label. Rows that repeat an id and
its text don't make each other fail. A document is good (toxic) if any label row of its id says so. A null part is the
empty string. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.store import written

FILTERS = "ABCDE"
#: Bounds of the filters: words, percent of distinct words, percent of capitals, characters.
LEAST_WORDS, DISTINCT, CAPITALS, SIGNS = 200, 50, 3, b"#$%&*|"

_UPPER, _INNER = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
_ROW = pa.schema([("part", pa.string()), ("doc_id", pa.int64()), ("mask", pa.int32()), ("digest", pa.binary()), ("first", pa.int64())])
_REPEATED = 1 << FILTERS.index("E")


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails, A lowest."""
    words = text.split()
    points = len(text.translate(None, _INNER))
    capitals = len(text) - len(text.translate(None, _UPPER))
    failed = (len(words) < LEAST_WORDS, 100 * len(set(words)) < DISTINCT * len(words), 100 * capitals > CAPITALS * points, len(text.translate(None, SIGNS)) < len(text))
    return sum(1 << i for i, x in enumerate(failed) if x)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (part, doc_id, fp, text) → a row each with its mask, and reports (mask null) of the first and last fp.

    Within a partition a row repeats if its text is that of the row before and the run began with a smaller id.
    """
    text = fp = digest = least = first_fp = None
    mask, ends = 0, {}
    reports: list[tuple[bytes, int | None]] = []
    for batch in batches:
        rows: list[tuple] = []
        for part, doc_id, own_fp, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            own = own.as_buffer().to_pybytes()
            if own_fp != fp or own != text:
                if own_fp != fp:
                    if fp == first_fp:
                        reports += ends.items()
                    first_fp, fp, ends = own_fp if fp is None else first_fp, own_fp, {}
                text, mask, digest, least = own, failures(own), hashlib.sha256(own).digest(), doc_id
                ends[digest] = least
            repeated = doc_id is not None and least is not None and least < doc_id
            rows.append((part, doc_id, mask | _REPEATED * repeated, digest, None))
        yield _batch(rows)
    if fp is not None:
        yield _batch([(None, None, None, d, i) for d, i in [*reports, *ends.items()]])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _ROW)] if rows else [pa.array([], f.type) for f in _ROW], schema=_ROW)


def masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, doc_id, mask) of every row: the filters that its text fails, A the lowest bit."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("fp"), text.cast("binary").alias("text"))
    # The last key lets rows that repeat one id and text part as well.
    dealt = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange("fp", "doc_id", "at").sortWithinPartitions("fp", "text", F.col("doc_id").asc_nulls_last())
    marked = written(dealt.select("part", "doc_id", "fp", "text").mapInArrow(_compared, "part string, doc_id long, mask int, digest binary, first long"), "audit-masks")
    spans = marked.where("mask IS NULL").groupBy("digest").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("tasks")).where("tasks > 1").select("digest", "least")
    both = marked.where("mask IS NOT NULL").join(F.broadcast(spans), "digest", "left")
    return both.select("part", "doc_id", F.when(F.col("least") < F.col("doc_id"), F.col("mask").bitwiseOR(F.lit(_REPEATED))).otherwise(F.col("mask")).alias("mask"))


def counters(masked: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): additive counts of the documents of a part that fail just these filters."""
    said = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max((F.col(quality_col) == 1).cast("int")).alias("good"), F.max((F.col(toxic_col) == 1).cast("int")).alias("toxic"))
    both = masked.join(said, "doc_id", "left")
    return both.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


def interactions(counted: DataFrame) -> DataFrame:
    """One row a part, order of the filters and step, from the counters."""
    steps = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, letter in enumerate(order, 1):
            own = 1 << FILTERS.index(letter)
            steps.append((len(steps), order, step, own, before))
            before |= own
    table = counted.sparkSession.createDataFrame(steps, "place int, filter_order string, step int, own int, before int")
    # 600 rows, fixed by the filters, meet at most 32 rows a part.
    met = counted.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1)))).join(F.broadcast(table), "place")
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    removed, n = fails & ~earlier, F.col("n")
    # A document that fails k filters is removed by each of them in 120 / k of the orders.
    orders = F.lit(120) / F.bit_count("mask")

    def total(which, what=n):
        return F.sum(F.when(which, what).otherwise(0)).cast("long")

    return met.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"),
        total(removed).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(removed, F.col("good")).alias("good_lost"),
        total(removed, F.col("toxic")).alias("toxic_lost"),
        total(fails, n * orders.cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over documents, by part, order and step."""
    return interactions(written(counters(masks(docs), labels), "audit-counters"))


#: The same rows from DuckDB.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT doc_id, part,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false)::INT AS mask FROM t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT v.c || w.c || x.c || y.c || z.c AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits FROM x v, x w, x, x y, x z
    WHERE v.b + w.b + x.b + y.b + z.b = 31 AND v.b | w.b | x.b | y.b | z.b = 31),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) r(step))
SELECT part, filter_order, step, sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
    sum(CASE WHEN mask & own > 0 THEN n * (120 // bit_count(mask)) ELSE 0 END)::BIGINT AS shapley
FROM c, s GROUP BY ALL"""

"""Line dedup by a deletion-neighbourhood join.

A line (text between newlines) is compared by its words, the `[^\\x20\\x09-\\x0D]+` in it. Two lines are near when at most
one word is inserted, deleted or replaced between them. Each distinct line is keyed under its variants within that
bound: the whole line, and the line with each single word left out. Equal keys join, the word edit distance verifies
them, and a line goes when an earlier one (smaller doc_id, then line number) is near it.

* Replaced word: both lines give the same variant at the same place. All lines under such a key are near each other,
  so the earliest under it stands for all: no pairs within a group. Inserted word: the longer line's variant is the
  shorter line itself.
* Before the variants, an exact filter: one edit leaves the first or the last half of a line untouched. A line of n
  words is counted under its first and last n // 2 and (n - 1) // 2 words, so that lines whose lengths differ by one
  meet; one that shares none of these with another line has no partner and gives no keys.
* Lines with fewer than `min_words` words give no variants: one edit is too much of them. With 5 words it is a
  similarity of 0.8. Exact copies of such lines go like any other. A line that is mostly written in a script without
  blanks counts by its characters instead of words. Blank lines stay.
* The hash of a line without its ith word is made from those of the words before and after it, so all variants of a
  line cost time in proportion to its length.

Documents whose lines have all gone leave; a document that had no line to lose stays as it is. A null text stays
null; rows with a null doc_id come first in the order. Rows repeated with the same id and text are one document to
the order, so they keep the same lines. An empty table gives an empty result. Other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.store import ROW, numbered, written

MIN_WORDS = 5
#: Up to so many rows of hashes, a table is broadcast instead of moving the larger side to it.
BROADCAST_ROWS = 200_000

#: Multiplier of the polynomial hash, any odd number, and its powers as far as they were needed.
BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
#: Variants in one Arrow batch, beyond which it ends with its line.
VARIANT_ROWS = 50_000

#: Letters of scripts that put no blanks between words (Thai, Lao, Myanmar, Khmer, kana, Chinese), and
#: characters that `split` takes for white space.
_UNSPACED = re.compile("[\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af]")
_SPACES = frozenset(" \t\n\x0b\x0c\r")

_SCHEMA = f"row_id {ROW}, doc_id long, text_hash long, line_no int, h long, edges array<long>"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hash(words: list[bytes]) -> int:
    return _signed(xxhash.xxh64_intdigest(b" ".join(words)))


def within_one(a: list, b: list) -> bool:
    """Word edit distance at most 1, in linear time."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def _edges(words: list[bytes]) -> list[int]:
    halves = {len(words) // 2, (len(words) - 1) // 2}
    return [_hash([b"first", *words[:k]]) for k in halves] + [_hash([b"last", *words[-k:]]) for k in halves]


def _units(line: bytes, min_words: int) -> list[bytes]:
    """The words of a line, or its characters where it has few words and most of it is of a script without blanks."""
    words = line.split()
    if 0 < len(words) < min_words and not line.isascii():
        text = b"".join(words).decode("utf-8", "surrogatepass")
        if 2 * len(_UNSPACED.findall(text)) > len(text):
            return [c.encode("utf-8", "surrogatepass") for c in text if c not in _SPACES]
    return words


def _lines(min_words: int):
    """One row a line that can go: its place, its hash, and those of its first and last halves if it is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, hashes, edges = [], [], [], []
            for row, text in enumerate(batch.column(3)):
                for no, line in enumerate((text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    words = _units(line, min_words)
                    if words:
                        rows.append(row)
                        numbers.append(no)
                        hashes.append(_hash(words))
                        edges.append(_edges(words) if len(words) >= min_words else [])
            at = pa.array(rows, pa.int64())
            own = [batch.column(i).take(at) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(numbers, pa.int32()), pa.array(hashes, pa.int64()), pa.array(edges, pa.list_(pa.int64()))], names=["row_id", "doc_id", "text_hash", "line_no", "h", "edges"])

    return run


def _texts_of(min_words: int):
    """(doc_id, text_hash, wanted line numbers, text) → one row a line: its place, h, its words as one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, no, h, line = [], [], [], []
            for row, (numbers, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3))):
                lines = text.as_py().encode("utf-8", "surrogatepass").split(b"\n")
                for n in numbers:
                    words = _units(lines[n], min_words)
                    rows.append(row)
                    no.append(n)
                    h.append(_hash(words))
                    line.append(b" ".join(words))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(no, pa.int32()), pa.array(h, pa.int64()), pa.array(line, pa.binary())], names=["doc_id", "text_hash", "line_no", "h", "line"])

    return run


def _deletions(words: list[bytes]) -> np.ndarray:
    """Hash of the words without each one, then that of all: polynomials in an odd number over their XXH64, modulo 2**64."""
    n = len(words)
    while len(_powers) <= n:
        _powers.resize(2 * len(_powers), refcheck=False)
        half = len(_powers) // 2
        _powers[half:] = _powers[:half] * _powers[half - 1] * np.uint64(BASE)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n) * _powers[:n]
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own)])
    keys = np.append(before[:-1] + (before[-1] - before[1:]) * np.uint64(pow(BASE, -1, 1 << 64)), before[-1])
    # The high half of a polynomial depends on more of each word than its low half, by which Spark deals out keys.
    return (keys ^ (keys >> np.uint64(32))).view(np.int64)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a variant: each one-word deletion at its place, and the whole line (place -1)."""

    def out(batch: pa.RecordBatch, rows: list[int], keys: list[np.ndarray]) -> pa.RecordBatch:
        sizes = [len(k) for k in keys]
        at = pa.array(np.repeat(np.array(rows, np.int64), sizes))
        places = np.concatenate([np.append(np.arange(n - 1, dtype=np.int32), np.int32(-1)) for n in sizes])
        return pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(4)), pa.array(np.concatenate(keys)), pa.array(places)], names=["doc_id", "text_hash", "line_no", "h", "key", "place"])

    for batch in batches:
        rows, keys, waiting = [], [], 0
        for row, line in enumerate(batch.column(4)):
            rows.append(row)
            keys.append(_deletions(line.as_py().split()))
            waiting += len(keys[-1])
            if waiting >= VARIANT_ROWS:
                yield out(batch, rows, keys)
                rows, keys, waiting = [], [], 0
        if rows:
            yield out(batch, rows, keys)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [h for h, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))) if within_one(a.split(), b.split())]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], names=["h"])


def _small(table: DataFrame) -> DataFrame:
    """The written table, broadcast if it has few rows of bounded width; else Spark joins it as it sees fit."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def repeated_lines(rows: DataFrame, *, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """rows: (row_id, doc_id, text_hash, text). Returns every line that can go, and h of the lines that go whole.

    The first result has (row_id, line_no, h, first): `first` if it is the earliest of its exact copies; the second
    holds the hashes whose earliest copy has an earlier near line.
    """
    lines = written(rows.select("row_id", "doc_id", "text_hash", "text").mapInArrow(_lines(min_words), _SCHEMA), "lines")
    pos = F.struct("doc_id", "text_hash", "line_no")
    distinct = written(lines.groupBy("h").agg(F.min(F.struct(pos.alias("pos"), F.col("row_id"), F.col("edges"))).alias("x")).select("h", "x.pos", "x.row_id", "x.edges"), "lines-distinct")

    ends = distinct.select("h", F.explode("edges").alias("edge"))
    often = _small(written(ends.groupBy("edge").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("edge"), "lines-edges"))
    near = written(ends.join(often, "edge", "left_semi").select("h").distinct(), "lines-shared")
    few = near.count() <= BROADCAST_ROWS
    near = F.broadcast(near) if few else near
    wanted = distinct.join(near, "h", "left_semi").groupBy("row_id").agg(F.collect_list(F.col("pos.line_no")).alias("numbers"))
    # Its lists hold as many numbers together as `near` has rows.
    wanted = written(wanted, "lines-wanted").hint("broadcast" if few else "merge")
    found = rows.join(wanted, "row_id").select("doc_id", "text_hash", "numbers", "text")
    texts = written(found.mapInArrow(_texts_of(min_words), "doc_id long, text_hash long, line_no int, h long, line binary"), "lines-texts")

    keys = texts.mapInArrow(_variants, "doc_id long, text_hash long, line_no int, h long, key long, place int")
    keys = written(keys.select("h", pos.alias("pos"), "key", "place"), "lines-keys")
    cut, whole = keys.where("place >= 0"), keys.where("place = -1").select("key", F.col("h").alias("short"), F.col("pos").alias("short_pos"))
    best = cut.groupBy("key", "place").agg(F.min(F.struct("pos", "h")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    best = _small(written(best.select("key", "place", F.col("best.pos").alias("best_pos"), F.col("best.h").alias("other")), "lines-replaced"))
    replaced = cut.join(best, ["key", "place"]).where(F.col("best_pos") < F.col("pos")).select("h", "other")
    longer = written(cut.join(_small(whole), "key").select("h", "pos", "short", "short_pos"), "lines-inserted")
    inserted = longer.where(F.col("short_pos") < F.col("pos")).select("h", F.col("short").alias("other"))
    first_longer = longer.where(F.col("pos") < F.col("short_pos")).groupBy("short").agg(F.min_by("h", "pos").alias("other")).select(F.col("short").alias("h"), "other")
    pairs = replaced.union(inserted).union(first_longer).distinct()
    left, right = texts.select("h", F.col("line").alias("a")), texts.select(F.col("h").alias("other"), F.col("line").alias("b"))
    gone = pairs.join(left, "h").join(right, "other").select("h", "a", "b").mapInArrow(_verify, "h long").distinct()
    first = distinct.select(F.col("h").alias("of"), F.col("pos").alias("first_pos"))
    marked = lines.withColumn("pos", pos).join(first, lines["h"] == first["of"]).select("row_id", "line_no", "h", F.col("pos").eqNullSafe(F.col("first_pos")).alias("first"))
    return marked, written(gone, "lines-near")


def _rebuild(text_at: int, gone_at: int, report: bool):
    """Texts without the lines that go. Rows with nothing left leave, or, for the report, get a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed, left = [], [], []
            for text, gone in zip(batch.column(text_at), batch.column(gone_at).to_pylist()):
                text = text.as_py()
                stays = True
                if gone:
                    drop = set(gone)
                    lines = [x for i, x in enumerate(text.split("\n")) if i not in drop]
                    stays = any(x.strip() for x in lines)
                    text = "\n".join(lines) if stays else None
                texts.append(text)
                removed.append(len(gone or ()))
                left.append(stays)
            columns, names = list(batch.columns), list(batch.schema.names)
            columns[text_at] = pa.array(texts, pa.string())
            columns[gone_at], names[gone_at] = pa.array(removed, pa.int32()), "removed" if report else "__gone"
            out = pa.RecordBatch.from_arrays(columns, names=names)
            yield out if report else out.filter(pa.array(left, pa.bool_()))

    return run


def _with_lost(tagged: DataFrame, id_col: str, text_col: str, options: dict) -> DataFrame:
    """tagged with the numbers of each row's lost lines as its last column; the texts move once."""
    rows = tagged.select(F.col("__row").alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    marked, near = repeated_lines(rows, **options)
    near = near.select(F.col("h").alias("of"), F.lit(True).alias("near"))
    lost = marked.join(near, marked["h"] == near["of"], "left").where("near OR NOT first")
    numbers = lost.groupBy(F.col("row_id").alias("__row")).agg(F.collect_list("line_no").alias("__gone"))
    return tagged.join(numbers, "__row", "left")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without their repeated lines; rows with nothing left go. All columns stay, in order."""
    found = _with_lost(numbered(docs, "__row"), id_col, text_col, options).select(*docs.columns, "__gone")
    schema = T.StructType([*docs.schema.fields, T.StructField("__gone", T.IntegerType())])
    return found.mapInArrow(_rebuild(docs.columns.index(text_col), len(docs.columns), False), schema).select(*docs.columns)


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, removed lines, and the text that stays (null where nothing does) of every row."""
    tagged = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "__row")
    found = _with_lost(tagged, "doc_id", "text", options).select("doc_id", "text", "__gone")
    return found.mapInArrow(_rebuild(1, 2, True), "doc_id long, text string, removed int").select("doc_id", "removed", "text")

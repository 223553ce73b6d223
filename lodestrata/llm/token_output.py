"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

File format. The output is a Parquet table of blocks in ascending `doc_id` order (`part`, then `seq`); Spark's
committer writes it, so any store and any lost executor will do. A block holds whole documents:
`doc_ids`, `doc_lens` (ids per document), `ranked` (little-endian uint32: the block's token ids, most frequent
first, ties to the smaller id), `control` (2 bits per id, 4 ids per byte, low bits first: bytes of the rank - 1)
and `data` (the ranks' low bytes, little-endian). Frequent ids get short codes. The rank table is the block's
own, so one pass over the texts is enough and a block can be decoded alone.

Nulls and ties: a null text is an empty one; a null doc_id comes first; repeated rows are documents of their
own, ordered by text. An empty table gives an empty output. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.store import written
from lodestrata.llm.tokens import encoder

#: Ids after which a block is closed; a single longer document makes a longer block.
BLOCK_TOKENS = 500_000

#: Vocabularies up to this size are counted in an array, larger ids by sorting.
COUNTED = 1 << 22

BLOCKS = "part int, seq int, n_docs long, n_tokens long, doc_ids array<long>, doc_lens array<long>, ranked binary, control binary, data binary"
DOCS = "part int, seq int, doc_id long, in_block long, n_tokens long, ids_crc32 long"

#: For each control byte, the lengths of its four ids.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """ids (uint32) → rank table, control bytes, data bytes."""
    if ids.max(initial=0) < COUNTED:
        counts = np.bincount(ids)
        values = np.flatnonzero(counts).astype(np.uint32)
        counts, places = counts[values], ids
    else:
        values, places, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((values, -counts))
    rank_of = np.zeros(int(places.max(initial=0)) + 1, np.uint32)
    rank_of[values[order] if places is ids else order] = np.arange(len(values), dtype=np.uint32)
    ranks = rank_of[places]
    lens = (1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lens - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < lens[:, None]]
    return values[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def decode_block(ranked: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The block's n ids, by table lookup: control byte → lengths → positions → masked 4-byte words."""
    if not n:
        return np.zeros(0, np.uint32)
    lens = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    starts = np.cumsum(lens) - lens
    padded = data + b"\0\0\0"
    words = np.ndarray((len(data),), "<u4", padded, strides=(1,))
    return np.frombuffer(ranked, "<u4")[words[starts] & MASKS[lens]]


def _encode(path: str, end_id: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(path, True), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        docs: list = []
        lens: list[int] = []
        held = 0

        def block() -> pa.RecordBatch:
            ranked, control, data = encode_block(np.concatenate(ids))
            row = {"part": part, "seq": seq, "n_docs": len(docs), "n_tokens": held, "doc_ids": docs, "doc_lens": lens, "ranked": ranked, "control": control, "data": data}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_SCHEMA)

        for batch in batches:
            keys, texts, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            for flat, n in enc.encode([t or "" for t in texts]):
                ends = np.cumsum(n)
                for i, (start, end) in enumerate(zip(ends - n, ends)):
                    ids += [flat[start:end], np.array([end_id], np.uint32)]
                    docs.append(keys[at + i])
                    lens.append(int(n[i]) + 1)
                    held += lens[-1]
                    if held >= block_tokens:
                        yield block()
                        ids, docs, lens, held, seq = [], [], [], 0, seq + 1
                at += len(n)
        if docs:
            yield block()

    return run


_BLOCK_SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("ranked", pa.binary()), ("control", pa.binary()), ("data", pa.binary())])


def write_blocks(docs: DataFrame, tokenizer: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Encode all documents and write the blocks; returns the written table, read back."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(_encode(tokenizer, end_id, block_tokens), BLOCKS), "token-blocks")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            x = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
            ids = decode_block(x["ranked"], x["control"], x["data"], x["n_tokens"])
            ends = np.cumsum(x["doc_lens"])
            starts = ends - x["doc_lens"]
            crc = [zlib.crc32(ids[s:e].astype("<u4").data) for s, e in zip(starts, ends)]
            n = len(ends)
            yield pa.RecordBatch.from_arrays([pa.array([x["part"]] * n, pa.int32()), pa.array([x["seq"]] * n, pa.int32()), pa.array(x["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(x["doc_lens"], pa.int64()), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "in_block", "n_tokens", "ids_crc32"])


def block_starts(blocks: DataFrame) -> DataFrame:
    """part, seq, block_start: ids before each block. Sums by part first; one row a part is then summed on."""
    meta = blocks.select("part", "seq", "n_tokens")
    parts = meta.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    meta = meta.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("in_part"))
    return meta.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("in_part")).alias("block_start"))


def read_blocks(blocks: DataFrame) -> DataFrame:
    """Decode the files: doc_id, start, n_tokens, ids_crc32 of every document."""
    found = blocks.mapInArrow(_decode, DOCS)
    starts = written(block_starts(blocks), "token-starts")
    return found.join(starts, ["part", "seq"]).select("doc_id", (F.col("block_start") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32")

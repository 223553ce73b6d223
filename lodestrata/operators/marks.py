"""Sets of numbers under BLOCK, one a row: for Python workers that unite them without meeting their members as rows.

A set is a bitmap of BLOCK bits or, if that is shorter, its numbers in two bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Numbers of a set; bytes of its bitmap; sets that a task unites before it hands them on (16 MB of bitmaps).
BLOCK, BYTES, HELD = 8192, 1024, 16384
#: Sets of one batch of results, which can have BLOCK numbers each.
SLICE = 64


def packed(bits: np.ndarray) -> bytes:
    """One set from its bitmap."""
    held = np.flatnonzero(np.unpackbits(bits, bitorder="little")) if np.bitwise_count(bits).sum() < BYTES // 2 else None
    return bits.tobytes() if held is None else held.astype("<u2").tobytes()


def bitmaps(column: pa.Array) -> np.ndarray:
    """The sets of a column as bitmaps, a row each."""
    out = np.zeros((len(column), BYTES), np.uint8)
    for at, value in enumerate(column):
        held = value.as_buffer()
        if len(held) == BYTES:
            out[at] = np.frombuffer(held, np.uint8)
        else:
            places = np.frombuffer(held, "<u2")
            np.bitwise_or.at(out[at], places >> 3, np.left_shift(1, places & 7).astype(np.uint8))
    return out


def _codes(column: pa.Array) -> tuple[np.ndarray, list]:
    coded = pc.dictionary_encode(column)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _rows(schema: pa.Schema, keys: list, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 1000):
        nodes, blocks = zip(*keys[at : at + 1000])
        yield pa.RecordBatch.from_arrays([pa.array(nodes, schema.field(0).type), pa.array(blocks, pa.int64()), pa.array([packed(s) for s in sets[at : at + len(nodes)]], pa.binary())], names=["node", "block", "bits"])


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, block, bits), repeated → the union of each node and block, once a task as long as HELD are enough."""
    slots, acc, schema = {}, np.zeros((HELD, BYTES), np.uint8), None
    for batch in batches:
        if not batch.num_rows:
            continue
        schema = batch.schema
        (nodes, node_of), (blocks, block_of) = _codes(batch.column(0)), _codes(batch.column(1))
        pairs = nodes * len(block_of) + blocks
        order = np.argsort(pairs, kind="stable")
        first = np.flatnonzero(np.diff(pairs[order], prepend=-1))
        sets = np.bitwise_or.reduceat(bitmaps(batch.column(2))[order], first, axis=0)
        keys = [(node_of[p // len(block_of)], block_of[p % len(block_of)]) for p in pairs[order][first].tolist()]
        if len(slots) + len(keys) > HELD:
            yield from _rows(schema, list(slots), acc)
            slots, acc[:] = {}, 0
        at = [slots.setdefault(k, len(slots)) for k in keys]
        acc[at] |= sets
    if slots:
        yield from _rows(schema, list(slots), acc)


def news(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, block, bits, new), sorted by node and block → what the new sets of a node and block have and the others don't."""
    key, schema, both = None, None, np.zeros((2, BYTES), np.uint8)

    def told(keys: list, fresh: np.ndarray, known: np.ndarray) -> Iterator[pa.RecordBatch]:
        left = fresh & ~known
        some = np.flatnonzero(left.any(axis=1))
        return _rows(schema, [keys[i] for i in some], left[some])

    for batch in batches:
        if not batch.num_rows:
            continue
        schema = batch.schema
        (nodes, node_of), (blocks, block_of) = _codes(batch.column(0)), _codes(batch.column(1))
        pairs = nodes * len(block_of) + blocks
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        sets, new = bitmaps(batch.column(2)), batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
        fresh = np.bitwise_or.reduceat(np.where(new[:, None], sets, np.uint8(0)), first, axis=0)
        known = np.bitwise_or.reduceat(np.where(new[:, None], np.uint8(0), sets), first, axis=0)
        keys = [(node_of[p // len(block_of)], block_of[p % len(block_of)]) for p in pairs[first].tolist()]
        if key == keys[0]:
            fresh[0] |= both[0]
            known[0] |= both[1]
        elif key is not None:
            yield from told([key], both[:1], both[1:])
        # The last of a batch can go on in the next.
        yield from told(keys[:-1], fresh[:-1], known[:-1])
        key, both = keys[-1], np.stack([fresh[-1], known[-1]])
    if key is not None:
        yield from told([key], both[:1], both[1:])


def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, block, bits, distance) → node, block, distance and the numbers of the set as an array."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            found = np.unpackbits(bitmaps(part.column(2)), axis=1, bitorder="little")
            ends = np.concatenate([[0], np.cumsum(found.sum(axis=1, dtype=np.int64))]).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(found)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), held], names=["node", "block", "distance", "held"])

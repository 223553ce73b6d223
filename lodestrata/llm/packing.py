"""Best-fit packing with swap-based local search.

Documents are tokenized, closed with an end id and cut into pieces only where they are longer than a sequence.
Pieces are dealt to shards of bounded size; in a shard, best-fit decreasing fills the bins and a local search
moves a piece, exchanges one for one or two for one between underfull bins, each step raising the sum of squared
fills, until bins run empty and no step is left, or a lower bound of the number of bins is met. Every piece is placed,
and the cost of sharding is at most one open bin a shard.

Nulls and ties: a null text is an empty one (its end id alone); repeated rows and rows with a null id are packed
like any other. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.store import written
from lodestrata.llm.tokens import encoder

#: Pieces in a shard, and so in the memory of one task.
SHARD_PIECES = 40_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, False)
        for batch in batches:
            keys, texts, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            out: list[tuple] = []
            for flat, n in enc.encode([t or "" for t in texts]):
                ends = np.cumsum(n)
                for i, (a, b) in enumerate(zip(ends - n, ends)):
                    ids = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        out.append((keys[at + i], piece, start, len(part), zlib.crc32(part.data)))
                at += len(n)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize every document and cut it: one row a piece. The ids stay in the task, no shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_cut(tokenizer, end_id, capacity), PIECES)


class _Bins:
    """Bins by free room. `mask` has bit f set where some bin has f tokens free."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.free = capacity, [], []
        self.by_free: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.mask = 0

    def _put(self, b: int) -> None:
        f = self.free[b]
        self.by_free[f].add(b)
        self.mask |= 1 << f

    def _take(self, b: int) -> None:
        f = self.free[b]
        self.by_free[f].discard(b)
        if not self.by_free[f]:
            self.mask &= ~(1 << f)

    def change(self, b: int, out: list[int], into: list[int], size: np.ndarray) -> None:
        self._take(b)
        for x in out:
            self.items[b].remove(x)
        self.items[b] += into
        self.free[b] += int(sum(size[x] for x in out) - sum(size[x] for x in into))
        if self.items[b]:
            self._put(b)

    def best(self, need: int, but: int = -1) -> int:
        """The fullest bin with that room, or -1."""
        m = self.mask >> need
        while m:
            low = (m & -m).bit_length() - 1
            for b in self.by_free[need + low]:
                if b != but:
                    return b
            m &= m - 1
        return -1

    def add(self, x: int, size: np.ndarray) -> None:
        b = self.best(int(size[x]))
        if b < 0:
            b = len(self.items)
            self.items.append([])
            self.free.append(self.capacity)
        else:
            self._take(b)
        self.items[b].append(x)
        self.free[b] -= int(size[x])
        self._put(b)


class _Swaps:
    """What underfull bins could give up, one piece or two, under the room that this leaves and their free room now."""

    def __init__(self, bins: _Bins, size: np.ndarray):
        self.bins, self.size = bins, size
        self.cells: dict[tuple[int, int], set[int]] = {}
        self.rooms, self.frees = 0, [0] * (bins.capacity + 1)
        for b in range(len(bins.items)):
            self.put(b)

    def _gifts(self, b: int) -> set[int]:
        """Sizes of its pieces and sums of two; a bin holds few different sizes, however many pieces."""
        own = Counter(int(self.size[i]) for i in self.bins.items[b])
        kinds = list(own)
        return set(kinds).union(y + z for k, y in enumerate(kinds) for z in kinds[k + (own[y] == 1) :])

    def put(self, b: int) -> None:
        f = self.bins.free[b]
        for v in self._gifts(b) if f else ():
            self.cells.setdefault((v + f, f), set()).add(b)
            self.frees[v + f] |= 1 << f
            self.rooms |= 1 << (v + f)

    def take(self, b: int) -> None:
        f = self.bins.free[b]
        for v in self._gifts(b) if f else ():
            cell = self.cells[v + f, f]
            cell.discard(b)
            if not cell:
                del self.cells[v + f, f]
                self.frees[v + f] &= ~(1 << f)
                if not self.frees[v + f]:
                    self.rooms &= ~(1 << (v + f))

    def find(self, b: int, need: int) -> tuple[int, int] | None:
        """A bin at least as full as b, and the size it gives up, less than `need`, for `need`: the fullest result."""
        m, below = self.rooms >> need, (2 << self.bins.free[b]) - 1
        while m:
            spare = (m & -m).bit_length() - 1
            frees = self.frees[need + spare] & below & -(2 << spare)
            while frees:
                f = (frees & -frees).bit_length() - 1
                for c in self.cells[need + spare, f]:
                    if c != b:
                        return c, need + spare - f
                frees &= frees - 1
            m &= m - 1
        return None

    def pieces(self, c: int, total: int) -> list[int]:
        """One or two pieces of a bin of that total size."""
        seen: dict[int, int] = {}
        for i in self.bins.items[c]:
            y = int(self.size[i])
            if y == total:
                return [i]
            if total - y in seen:
                pair = [seen[total - y], i]
            seen[y] = i
        return pair

    def move(self, b: int, c: int, x: int, back: list[int]) -> None:
        """Piece x from b to c, and `back` from c to b."""
        self.take(b)
        self.take(c)
        self.bins.change(b, [x], back, self.size)
        self.bins.change(c, back, [x], self.size)
        self.put(b)
        self.put(c)


def least_bins(size: np.ndarray, capacity: int) -> int:
    """A lower bound of the number of bins: pieces over half a bin meet no other such, and smaller ones fill what they leave."""
    down = np.sort(np.asarray(size, np.int64))
    total = np.concatenate([[0], np.cumsum(down)])
    best = -(-int(total[-1]) // capacity)
    at = lambda x, side: np.searchsorted(down, x, side)
    small = np.unique(down[down <= capacity // 2])
    half, wide, low = at(capacity // 2, "right"), at(capacity - small, "right"), at(small, "left")
    big = np.maximum(wide, half)
    alone, shared = len(down) - big, big - half
    room = shared * capacity - (total[big] - total[half])
    over = np.maximum(0, -(-(total[half] - total[low] - room) // capacity))
    return max(best, int((alone + shared + over).max(initial=0)), len(down) - int(half))


def _search(bins: _Bins, size: np.ndarray, least: int) -> None:
    """Local search over all underfull bins, emptiest first, until no change is left or no fewer bins are possible.

    Each change raises the sum of squared fills, a whole number with an upper bound, so the search ends.
    """
    open_ = sum(map(bool, bins.items))
    if open_ <= least:
        return
    swaps, moved = _Swaps(bins, size), True

    def step(b: int) -> bool:
        for x in sorted({int(size[i]): i for i in bins.items[b]}.items(), reverse=True):
            sx, i = x
            c = bins.best(sx, b)
            if c >= 0 and sx - bins.free[c] > -bins.free[b]:
                swaps.move(b, c, i, [])
                return True
            if found := swaps.find(b, sx):
                swaps.move(b, found[0], i, swaps.pieces(*found))
                return True
        return False

    while moved and open_ > least:
        moved = False
        for b in sorted((b for b in range(len(bins.items)) if bins.items[b] and bins.free[b] > 0), key=lambda b: (-bins.free[b], b)):
            while bins.items[b] and bins.free[b] and step(b):
                moved = True
            open_ -= not bins.items[b]
            if open_ <= least:
                break


def pack(sizes: np.ndarray, capacity: int, search: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece."""
    size = np.asarray(sizes, np.int64)
    bins = _Bins(capacity)
    for x in np.lexsort((np.arange(len(size)), -size)):
        bins.add(int(x), size)
    if search:
        _search(bins, size, least_bins(size, capacity))
    where, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    n = 0
    for items in bins.items:
        at = 0
        for x in items:
            where[x], offset[x] = n, at
            at += int(size[x])
        n += bool(items)
    return where, offset


def pack_pieces(pieces: DataFrame, capacity: int, *, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset. The pieces are written once, so that their number and order hold."""
    pieces = written(pieces, "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        where, offset = pack(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=(int(rows["shard"].iloc[0]) << 32) + where, offset=offset).drop(columns="shard")

    return dealt.groupBy("shard").applyInPandas(one, f"{PIECES}, sequence_id long, offset long")


def best_fit(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, **columns: str) -> DataFrame:
    """The whole operator: one row a piece with its sequence and place."""
    return pack_pieces(cut_pieces(docs, tokenizer, end_id, capacity, **columns), capacity)

"""Documents joined by the Jaccard index of their sets of word shingles: a T-occurrence search in the manner of DivideSkip.

A set is the hashed distinct shingles of a text. A partner of a set of n elements at `percent` or more shares at least
T = ceil(percent * n / 100) of them, so of the n inverted lists the T - 1 longest are set aside and the n - T + 1 others
still hold every partner at least once. Those short lists are merged by heap, and what comes out is probed: each element
of the one set is looked for in the other by binary search, until the required overlap is reached or out of reach.

* Order of the elements: by hash, those with long lists last. Which are long is learnt from the lists themselves: one
  with sets of more than `LATE` components goes last, and its sets take their next element instead. All sets use one
  order, so nothing is lost, whatever is said of an element: what tells tasks is a bitmap of fixed size, in which
  elements share bits.
* Lists are cut by the length of sets, in steps of 1/16 of a natural logarithm. If the first element that two sets share
  has ra and rb elements of each from there on, at most min(ra, rb) are common, so sizes na <= nb fit only if na + nb <=
  min(ra, rb) * (100 + percent) / percent. The smaller set asks the lists of the lengths that this lets be, so it asks
  with a ninth of its elements at 80 percent, and mostly with fewer lengths. Lists are held in parts of `PART` entries.
  Entries carry a sketch of 64 bytes (see below), so that those without a chance are pruned where list and set meet.
* Equal sets are one node. Groups of near copies would fill each other's lists, so first each set meets the least of
  those with the same first (second, third) element, and later, while lists are full, the hub of one of its lists: the
  set there whose own lists are the longest together. What that links is one component from then on, and only sets of different
  components meet. Links are those that connect the same documents as all links would.
* Before a pair is probed, a bit string of the parities of its hashes bounds the overlap from above; it drops no pair
  that reaches it and leaves about one other in a thousand. Whole sets are made from the texts of these alone, once.
* Texts never move: those wanted are picked by a broadcast bitmap of their rows, of fixed size (2**26 bits), and what is
  made from them is joined exactly. At sizes that fill the bitmap it picks more texts than needed, never fewer.

Sets that share a rare element, fit each other's length and stay apart cost a merge step each: their number can grow
with the square of such a family.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.components import components
from lodestrata.llm.shingles import SEED, majority, rolled_hashes
from lodestrata.llm.store import ROW, discard, numbered, tidy, written

SHINGLE, PERCENT = 5, 80
#: Components of a list from which on it is long.
LATE = 32
#: First elements by which sets meet the least of those with the same; turns at most in which each set meets one other
#: of its lists, and the pairs a set under which they aren't needed.
FIRSTS, HUB_TURNS, FEW = 3, 1, 4
#: Entries of a part of a list, on the average; bits of the number of a bitmap's place; bytes of a sketch.
PART, PLACE_BITS, SKETCH = 1024, 26, 64


def least_shared(n: int, percent: int) -> int:
    """Elements that a set of n shares at least with a partner."""
    return -(-percent * n // 100)


def required(na: int, nb: int, percent: int) -> int:
    """Common elements with which sets of these sizes are partners."""
    return -(-percent * (na + nb) // (100 + percent))


def parities(own: np.ndarray) -> bytes:
    """One bit for each place that hashes are dealt to, twice as many places as hashes: whether an odd number is there.

    Places in which two sets differ are at most as many as the elements that only one of them has.
    """
    places = max(8 * SKETCH, 1 << int(2 * len(own)).bit_length())
    return np.packbits(np.bincount((own >> np.uint64(32)).astype(np.int64) % places, minlength=places) & 1, bitorder="little").tobytes()


def sketch_of(parity: bytes) -> bytes:
    """The parities of SKETCH bytes' places: the halves of a longer string laid upon each other."""
    bits = np.frombuffer(parity, np.uint8)
    while len(bits) > SKETCH:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits.tobytes()


def _sets(shingle: int, percent: int, printed: bool):
    """(row, text) → row, node (hash of the set), fp (SimHash, if wanted), n, the n - T + 1 smallest hashes, parities, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, sizes, heads, bits, sketches = [], [], [], [], [], []
            for text in batch.column(1):
                hashes = rolled_hashes(text.as_py(), shingle)
                own = np.unique(hashes)
                nodes.append(int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view("<i8")))
                prints.append(majority(hashes) if printed else None)
                sizes.append(len(own))
                heads.append(own[: len(own) - least_shared(len(own), percent) + 1].view("<i8"))
                bits.append(parities(own))
                sketches.append(sketch_of(bits[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(heads, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "node", "fp", "n", "heads", "bits", "sketch"])

    return run


def sets(texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, printed: bool = False) -> DataFrame:
    """texts: doc_id (as `numbered` names rows), text. One row each, written: node, fp, n, heads, bits, sketch."""
    return written(texts.mapInArrow(_sets(shingle, percent, printed), f"doc_id {ROW}, node long, fp long, n int, heads array<long>, bits binary, sketch binary"), "like-rows")


def _heads(shingle: int, percent: int, late: pa.Table):
    """(row, text) → row, the n - T + 1 first elements in the order that has those of the bitmap last."""
    bitmap = np.zeros(1 << (PLACE_BITS - 6), np.uint64)
    bitmap[late["word"].to_numpy()] = late["held"].to_numpy().view(np.uint64)
    mask = np.uint64((1 << PLACE_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for text in batch.column(1):
                own = np.unique(rolled_hashes(text.as_py(), shingle))
                place = own & mask
                last = (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
                heads.append(np.concatenate([own[~last], own[last]])[: len(own) - least_shared(len(own), percent) + 1].view("<i8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.list_(pa.int64()))], names=["doc_id", "heads"])

    return run


def _place(value: str) -> Column:
    return F.col(value).bitwiseAND((1 << PLACE_BITS) - 1)


def _bitmap(values: DataFrame, value: str) -> DataFrame:
    """(word, held): the places of the values in a bitmap of 2**PLACE_BITS bits, at most 2**20 rows."""
    places = values.select(_place(value).alias("place")).distinct()
    bit = F.expr("shiftleft(1L, CAST(place & 63 AS int))")
    return places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("held"))


def _picked(rows: DataFrame, value: str, bitmap: DataFrame, inside: bool = True) -> DataFrame:
    """The rows whose value has its place in the bitmap: all with a value that went into it, and some others. Or the rest."""
    placed = rows.withColumn("bit", _place(value)).withColumn("word", F.shiftright("bit", 6))
    found = placed.join(F.broadcast(bitmap), "word", "left").withColumn("hit", F.expr("coalesce(shiftrightunsigned(held, CAST(bit & 63 AS int)) & 1L, 0L) = 1L"))
    return found.where("hit" if inside else "NOT hit").select(*rows.columns)


def _whole_sets(shingle: int):
    """(row, text) → row, the hashes of its set in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(rolled_hashes(t.as_py(), shingle)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["doc_id", "s"])

    return run


def may_reach(percent: int):
    """(a, b, na, nb, parities of each) → the pairs that can be partners, by their sizes and parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                # The longer one folds onto half as many places until both have as many.
                short, long_ = sorted((x, y), key=len)
                p, q, size = int.from_bytes(short, "little"), int.from_bytes(long_, "little"), 8 * len(long_)
                while size > 8 * len(short):
                    size //= 2
                    q = (q >> size) ^ (q & ((1 << size) - 1))
                keep.append((na + nb - (p ^ q).bit_count()) // 2 >= required(na, nb, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


#: Elements probed between two looks at whether the overlap can still be reached.
STEP = 256


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are partners: the smaller's elements are probed in the larger until that is settled."""
    if len(x) > len(y):
        x, y = y, x
    need, common = required(len(x), len(y), percent), 0
    for at in range(0, len(x), STEP):
        part = x[at : at + STEP]
        place = np.searchsorted(y, part)
        common += int((y[np.minimum(place, len(y) - 1)] == part).sum())
        if common >= need or common + len(x) - at - len(part) < need:
            break
    return common >= need


def _probed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [reaches(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _pruned(percent: int):
    """Rows of an asking set and a part of a list → node, list: the entries that can be partners, in order.

    Left out are those of its own component, smaller ones, those that can't reach the overlap from this element on, and
    those whose sketch differs in too many places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, values = batch.column("list"), batch.column("list").flatten()
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            node, n, room, label = (values.field(i).to_numpy() for i in range(4))
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            own = {c: batch.column(c).to_numpy() for c in ("node", "n", "room", "label")}
            own_n = own["n"].astype(np.int64)[row]
            fits = (own["label"][row] != label) & ((own_n < n) | ((own_n == n) & (own["node"][row] < node)))
            fits &= (100 + percent) * np.minimum(own["room"][row], room).astype(np.int64) >= percent * (own_n + n)
            left = np.flatnonzero(fits)
            apart = np.bitwise_count(_sketches(values.field(4))[left] ^ _sketches(batch.column("sketch"))[row[left]]).sum(1, dtype=np.int64)
            # A pair of enough common elements differs in no more places than elements are not common.
            both = own_n[left] + n[left]
            left = left[(100 + percent) * (both - apart) >= 2 * percent * both]
            kept = np.bincount(row[left], minlength=batch.num_rows)
            some = np.flatnonzero(kept)
            offsets = np.concatenate([[0], np.cumsum(kept[some])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(some)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(node[left]))], names=["node", "list"])

    return run


def _sketches(column: pa.BinaryArray) -> np.ndarray:
    """Sketches of SKETCH bytes each as rows of 64-bit words, without copies."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, SKETCH).view("<u8") if len(column) else np.zeros((0, SKETCH // 8), "<u8")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short lists by the set that asks → pairs (a, b): its lists merged by heap, each partner once."""
    for batch in batches:
        left, right = [], []
        rows = zip(batch.column("node").to_pylist(), batch.column("list").to_pylist())
        for a, lists in groupby(rows, key=lambda r: r[0]):
            found = [b for b, _ in groupby(heapq.merge(*(x for _, x in lists)))]
            left += [a] * len(found)
            right += found
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _length(n: Column) -> Column:
    """The step of a set's size; never smaller for a larger size."""
    return F.floor(F.log(n.cast("double")) * 16).cast("int")


class Join:
    """The tables of one join. rows as `sets` makes them, which it takes over; texts as `sets` takes them."""

    def __init__(self, rows: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, late: int = LATE):
        self.shingle, self.percent, self.late = shingle, percent, late
        self.texts = texts.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
        first = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
        self.whole = written(rows.join(first, ["node", "doc_id"]).withColumn("h", F.xxhash64("doc_id")), "like-nodes")
        #: doc_id, node, n of every row.
        self.rows = written(rows.select("doc_id", "node", "n"), "like-members")
        discard(rows)
        self.nodes = self.whole.select("node", "n", "fp", "doc_id", "h")
        tidy(rows.sparkSession)
        #: Whole sets made so far.
        self.known: DataFrame | None = None

    def _texts_of(self, wanted: DataFrame) -> DataFrame:
        """doc_id and text of the wanted nodes (with doc_id, h) and some others."""
        return _picked(self.texts, "h", _bitmap(wanted, "h")).select("doc_id", "text")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b), a < b: those of the pairs of nodes that are partners."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        bits = self.whole.select("node", "n", "bits")
        bound = pairs.join(bits.toDF("a", "na", "x"), "a").join(bits.toDF("b", "nb", "y"), "b").select("a", "b", "na", "nb", "x", "y")
        pairs = written(bound.mapInArrow(may_reach(self.percent), "a long, b long"), "like-pairs")
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        if self.known is not None:
            wanted = wanted.join(self.known.select("node"), "node", "left_anti")
        of = written(wanted.join(self.nodes.select("node", "doc_id", "h"), "node"), "like-wanted")
        made = self._texts_of(of).mapInArrow(_whole_sets(self.shingle), f"doc_id {ROW}, s binary")
        own = written(made.join(of.select("doc_id", "node"), "doc_id").select("node", "s"), "like-sets")
        self.known = own if self.known is None else self.known.union(own)
        met = pairs.join(self.known.toDF("a", "x"), "a").join(self.known.toDF("b", "y"), "b")
        found = written(met.select("a", "b", "x", "y").mapInArrow(_probed(self.percent), "a long, b long"), "like-links")
        for done in (pairs, of):
            discard(done)
        tidy(self.texts.sparkSession)
        return found

    def links(self, start: DataFrame | None = None) -> DataFrame:
        """(a, b): partners that connect all partners. start: pairs of nodes to try first."""
        found = self.verified(self._firsts() if start is None else self._firsts().union(start))
        keys = self._in_order(found)
        placed, sums = self._apart(keys, found)
        for _ in range(HUB_TURNS):
            n, cross = sums.agg(F.sum("n"), F.sum("cross")).first()
            if not n or cross <= FEW * n:
                break
            found = found.union(self.verified(self._hubs(placed, sums)))
            before = placed, sums
            placed, sums = self._apart(placed.select("key", "node", "n", "place"), found)
            for done in before:
                discard(done)
        return found if placed.isEmpty() else found.union(self.verified(self._searched(placed, sums)))

    def _firsts(self) -> DataFrame:
        """Each set with the least of those that have the same first (second, third) element."""
        at = self.whole.select("node", F.posexplode(F.slice("heads", 1, FIRSTS)).alias("place", "key"))
        least = at.groupBy("place", "key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("times")).where("times > 1")
        return at.join(least, ["place", "key"]).select("a", F.col("node").alias("b"))

    def _in_order(self, found: DataFrame) -> DataFrame:
        """(key, node, n, place) of the elements by which sets can meet, those with long lists last.

        Lists are counted by one set of each component. Sets with a long one among their elements get their elements in
        the new order, others have the same ones in either; so have those that a full bitmap picks besides.
        """
        others = written(components(found).where("node <> label").select("node"), "like-others")
        first = self.whole.select("node", "n", "heads")
        postings = _postings(first.join(others, "node", "left_anti"))
        times = postings.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > self.late)
        late = written(_bitmap(times, "key"), "like-late")
        changed = written(self.nodes.join(_picked(_postings(first), "key", late).select("node").distinct(), "node", "left_semi").select("h"), "like-changed")
        tidy(self.texts.sparkSession)
        rows = written(_bitmap(changed, "h"), "like-rows-changed")
        made = _picked(self.texts, "h", rows).select("doc_id", "text").mapInArrow(_heads(self.shingle, self.percent, late.toArrow()), f"doc_id {ROW}, heads array<long>")
        own = written(made.join(_picked(self.nodes, "h", rows), "doc_id").select("node", "n", "heads"), "like-heads")
        keys = _postings(own.union(_picked(self.whole, "h", rows, inside=False).select("node", "n", "heads")))
        several = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key"), "like-several")
        tidy(self.texts.sparkSession)
        keys = written(_picked(keys, "key", _bitmap(several, "key")).join(several, "key").select("key", "node", "n", "place"), "like-keys")
        for done in (own, several, others, changed):
            discard(done)
        tidy(self.texts.sparkSession)
        return keys

    def _apart(self, keys: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """keys with the component of each node, where a key still holds several; and what each such key holds."""
        labelled = keys.join(components(found), "node", "left").select("key", "node", "n", "place", F.coalesce("label", "node").alias("label"))
        parts = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
        n, squares = F.sum("c"), F.sum(F.col("c") * F.col("c"))
        sums = parts.groupBy("key").agg(n.alias("n"), F.max_by("label", F.struct("c", "label")).alias("main"), ((n * n - squares) / 2).alias("cross"))
        sums = written(sums.where("cross > 0"), "like-parts")
        return written(labelled.join(sums.select("key"), "key", "left_semi"), "like-apart"), sums

    def _fits(self) -> Column:
        return (100 + self.percent) * F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= self.percent * (F.col("na") + F.col("nb"))

    def _hubs(self, placed: DataFrame, sums: DataFrame) -> DataFrame:
        """Each set with the hub of one of its keys, the one of most of them.

        The hub of a key is the set whose lists are the longest together: of copies with edits, one with few of its own.
        """
        weight = placed.join(sums.select("key", F.col("n").alias("held")), "key").groupBy("node").agg(F.sum("held").alias("weight"))
        hub = F.max_by(F.struct("node", "n", "place", "label"), F.struct("weight", "node")).alias("hub")
        hubs = placed.join(weight, "node").groupBy("key").agg(hub).selectExpr("key", "hub.node", "hub.n", "hub.place", "hub.label").toDF("key", "a", "na", "pa", "la")
        met = hubs.join(placed.toDF("key", "b", "nb", "pb", "lb"), "key").where("la <> lb").where(self._fits())
        return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a"))

    def _searched(self, placed: DataFrame, sums: DataFrame) -> DataFrame:
        """(a, b): sets of different components that share a short list, fit each other's length and may reach the overlap."""
        p = self.percent
        rows = placed.join(sums.select("key", "main", F.ceil(F.col("n") / PART).alias("parts")), "key").join(self.whole.select("node", "sketch"), "node")
        rows = rows.select("key", "node", "n", (F.col("n") - F.col("place")).alias("room"), "label", "sketch", (F.col("label") == F.col("main")).alias("main"), "parts")
        part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        listed = rows.groupBy("key", _length(F.col("n")).alias("length"), "main", part.alias("part"))
        lists = listed.agg(F.sort_array(F.collect_list(F.struct("node", "n", "room", "label", "sketch"))).alias("list"))
        most = F.floor((100 + p) * F.col("room") / p).cast("int") - F.col("n")
        asks = rows.where(most >= F.col("n")).select("key", "node", "n", "room", "label", "sketch", F.explode(F.sequence(_length(F.col("n")), _length(most))).alias("length"), F.col("main").alias("own"))
        # Sets of a list's largest component don't ask each other.
        asks = asks.withColumn("main", F.explode(F.when(F.col("own"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))).drop("own")
        met = asks.join(lists, ["key", "length", "main"]).select("node", "n", "room", "label", "sketch", "list")
        short = met.mapInArrow(_pruned(p), "node long, list array<long>")
        return short.repartition("node").sortWithinPartitions("node").mapInArrow(_merged, "a long, b long")


def _postings(heads: DataFrame) -> DataFrame:
    return heads.select("node", "n", F.posexplode("heads").alias("place", "key")).select("key", "node", "n", "place")


def joined(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, late: int = LATE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id reachable by links, itself included.

    Texts with fewer words than a shingle are one shingle; those without words (null too) have the empty set and link
    with nothing. Rows that repeat an id or text are rows of their own; a component's id is null only if all of its
    ids are. An empty table gives an empty result; other columns are ignored.
    """
    tagged = numbered(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "row")
    texts = tagged.select(F.col("row").alias("doc_id"), "text")
    join = Join(sets(texts, shingle, percent), texts, shingle, percent, late)
    labels = components(join.links())
    of = join.rows.join(labels, "node", "left").select("doc_id", "n", F.coalesce("label", "node").alias("label"))
    ids = tagged.select(F.col("row").alias("doc_id"), "id")
    some = written(of.join(ids, "doc_id").select("id", "n", "label"), "like-labels")
    first = some.where("n > 0").groupBy("label").agg(F.min("id").alias("component_id"))
    return some.join(first, "label", "left").select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))

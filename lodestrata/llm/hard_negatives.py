"""Hard negatives by a blocked matrix product of anchors and rows, summed over chunks of dimensions.

Anchors and rows are dealt to blocks, and both matrices are cut into chunks of columns. A tile of rows
meets the tiles of anchors of its chunk; each meeting gives partial integer scores, which are shuffled by (anchor
block, row block, strip of anchors) and added up in the order of their chunks. From each whole strip only the best
rows of an anchor (or of an anchor's window under a positive) go on, and the best of all strips remain.

Two rounds, and no score twice: a label with rows enough for one has blocks of its own, the other labels share blocks
by hash. Positives come from blocks that can hold the anchor's label, and negatives from all but those that hold only
that label. Blocks are bounded whatever label is hot; a task holds one strip of scores and one batch of tiles.

Scores: components become floor(256 * x) in double precision, as a long (beyond its range, the nearest), and products
and sums are those of longs (beyond their range they wrap). They are taken in doubles where that is exact.

No part take rows with a null id, a null label, a null or empty vector, or any null or non-finite component. Rows meet
only those with as many components. Rows that repeat an id, label and vector are one; rows that share an id but not the
rest are different rows, each an anchor of its own if the id is one. Ties go to the smaller id. An anchor without
positives, or a positive with no negative in its window, gives no row. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from lodestrata.llm.store import written

#: Every so manieth id is an anchor; every so manieth has its label moved on by one, modulo LABELS.
ANCHOR_EVERY, MOVED_EVERY, LABELS = 100, 7, 10
POSITIVES = NEGATIVES = 5
#: A negative's score is at least LEAST and at most MOST percent of the positive's.
LEAST, MOST = 80, 100



class Sizes(NamedTuple):
    """Rows and anchors of a block, dimensions of a chunk, anchors of a strip."""

    rows: int = 4096
    anchors: int = 512
    dimensions: int = 32
    strip: int = 32


_GROUP = ["dim", "small", "value"]
_BLOCK = "dim int, block int, small boolean, value long, k int, m binary, ids array<long>, rows array<long>, labels array<long>"
_LONGS = pa.list_(pa.int64())
#: For each anchor, for each positive: its id and row, or its score.
_NESTED, _NESTED_SQL = pa.list_(pa.list_(_LONGS)), "array<array<array<bigint>>>"
_STRIP = pa.schema([(c, pa.int32()) for c in ("dim", "i", "j", "s", "k")] + [("scores", pa.binary())] + [(c, _LONGS) for c in ("ids", "rows", "labels", "of", "of_rows", "of_labels")] + [(c, _NESTED) for c in ("positives", "bounds")])


def usable(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, dim, v, row): the rows that take part, each once; row tells those of one id apart."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("e"))
    odd = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & ~odd)
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = rows.select("vec_id", moved.alias("label"), F.size("e").alias("dim"), F.transform("e", lambda x: F.floor(x * 256)).alias("v"))
    return rows.withColumn("row", F.xxhash64("label", "v")).dropDuplicates(["vec_id", "row"])


def _is_anchor() -> Column:
    return F.col("vec_id") % ANCHOR_EVERY == 0


def _blocks_of(n: str, size: int) -> Column:
    return F.ceil(F.col(n) / size).cast("int")


def _grouped(rows: DataFrame, sizes: Sizes) -> tuple[DataFrame, DataFrame]:
    """rows with their group, and the groups with the numbers of their row and anchor blocks.

    A group is a label with `sizes.rows` rows or more, or a share of the others of as many rows. Groups are at most two for
    each `sizes.rows` rows (and one a length of vectors), so numbering them in one window is a small job.
    """
    labels = written(rows.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n")), "negatives-labels")
    big = written(labels.where(F.col("n") >= sizes.rows).select("dim", "label", F.lit(False).alias("small")), "negatives-big")
    shares = labels.where(F.col("n") < sizes.rows).groupBy("dim").agg(F.ceil(F.sum("n") / sizes.rows).alias("shares"))
    placed = rows.join(big, ["dim", "label"], "left").join(shares, "dim", "left")
    share = F.pmod(F.xxhash64("label"), "shares")
    placed = placed.withColumn("small", F.col("small").isNull()).withColumn("value", F.when(F.col("small"), share).otherwise(F.col("label"))).drop("shares")
    groups = placed.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"), F.count_if(_is_anchor()).alias("anchors"))
    groups = groups.select(*_GROUP, _blocks_of("n", sizes.rows).alias("blocks"), _blocks_of("anchors", sizes.anchors).alias("anchor_blocks"))
    before = Window.partitionBy("dim").orderBy("small", "value").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("dim")
    groups = groups.select("*", F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("start"), F.coalesce(F.sum("anchor_blocks").over(before), F.lit(0)).alias("anchor_start"), F.sum("blocks").over(whole).alias("all_blocks"))
    return placed, written(groups, "negatives-groups")


def _tiles(rows: DataFrame, groups: DataFrame, start: str, blocks: str, extra: dict[str, str], sizes: Sizes) -> DataFrame:
    """A row for each block and chunk: its matrix; ids, labels and extra columns come with chunk 0."""
    block = F.col(start) + F.pmod(F.xxhash64("vec_id", "row"), F.col(blocks))
    dealt = rows.join(groups, _GROUP).select(*_GROUP, block.cast("int").alias("block"), "vec_id", "row", "label", "v", *extra)

    def cut(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        matrix = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        chunks = range(0, dim, sizes.dimensions)
        head = [[table[c][0].as_py()] * len(chunks) for c in ("dim", "block", "small", "value")]
        once = [[table[c].to_pylist(), *[None] * (len(chunks) - 1)] for c in ("vec_id", "row", "label", *extra)]
        cut_up = [matrix[:, at : at + sizes.dimensions].astype("<i8").tobytes() for at in chunks]
        types = [pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 3, *[_NESTED] * len(extra)]
        names = ["dim", "block", "small", "value", "k", "m", "ids", "rows", "labels", *extra]
        return pa.table([pa.array(x, t) for x, t in zip([*head, list(range(len(chunks))), cut_up, *once], types)], names=names)

    return dealt.groupBy("dim", "block").applyInArrow(cut, ", ".join([_BLOCK, *(f"{n} {t}" for n, t in extra.items())]))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed in longs; in doubles where every sum stays exact."""
    most = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (a, b)]
    if most[0] * most[1] * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _multiplied(sizes: Sizes):
    """Tiles of anchors and rows of one chunk → strips of partial scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at] for n in batch.schema.names}
                width = min(sizes.dimensions, row["dim"].as_py() - sizes.dimensions * row["k"].as_py())
                a, b = (np.frombuffer(row[n].as_buffer(), "<i8").reshape(-1, width) for n in ("a", "b"))
                scores = _product(a, b)
                starts = range(0, len(a), sizes.strip)
                whole = {c: [row[c].as_py()] * len(starts) for c in ("dim", "i", "j", "k", "ids", "rows", "labels")}
                of = {c: row[c].as_py() for c in ("of", "of_rows", "of_labels", "positives", "bounds")}
                cut = {c: [None if v is None else v[s : s + sizes.strip] for s in starts] for c, v in of.items()}
                blobs = [scores[s : s + sizes.strip].astype("<i8").tobytes() for s in starts]
                values = whole | cut | {"s": range(len(starts)), "scores": blobs}
                yield pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) for f in _STRIP], schema=_STRIP)

    return run


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; ties by id, then row."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= least)
        return kept[np.lexsort((rows[kept], ids[kept], -scores[kept]))[:k]]
    return np.lexsort((rows, ids, -scores))[:k]


def _positives_of(strip: dict) -> Iterator[tuple]:
    for a, (anchor, row, label) in enumerate(zip(strip["of"], strip["of_rows"], strip["of_labels"])):
        at = np.flatnonzero((strip["labels"] == label) & ((strip["ids"] != anchor) | (strip["rows"] != row)))
        for p in at[_best(strip["scores"][a, at], strip["ids"][at], strip["rows"][at], POSITIVES)]:
            yield anchor, row, 0, 0, 0, strip["ids"][p], strip["rows"][p], strip["scores"][a, p]


def _negatives_of(strip: dict) -> Iterator[tuple]:
    for a, (anchor, row, label) in enumerate(zip(strip["of"], strip["of_rows"], strip["of_labels"])):
        for (positive, positive_row), (score,) in zip(strip["positives"][a], strip["bounds"][a]):
            own = strip["scores"][a]
            # Below zero the window is empty; above, the product of a long and 100 could wrap, so whole percents are compared.
            least = -(-LEAST * score // 100)
            at = np.flatnonzero((own >= least) & (own <= MOST * score // 100) & (strip["labels"] != label))
            for p in at[_best(own[at], strip["ids"][at], strip["rows"][at], NEGATIVES)]:
                yield anchor, row, positive, positive_row, score, strip["ids"][p], strip["rows"][p], own[p]


_FOUND = ["anchor_id", "anchor_row", "positive_id", "positive_row", "positive_score", "id", "row", "score"]


def _summed(choose):
    """Strips in the order of their keys and chunks → the rows that `choose` takes from each whole strip."""

    def out(strip: dict) -> pa.RecordBatch:
        found = list(choose(strip))
        columns = zip(*found) if found else [[]] * len(_FOUND)
        return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in columns], names=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, strip = None, {}
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("dim", "i", "j", "s"))))
            for at, own in enumerate(keys):
                part = np.frombuffer(batch.column("scores")[at].as_buffer(), "<i8")
                if own == key:
                    strip["scores"] += part.reshape(strip["scores"].shape)
                    continue
                if key is not None:
                    yield out(strip)
                # The first of a key is chunk 0, which has the ids.
                key, strip = own, {c: np.array(batch.column(c)[at].as_py(), np.int64) for c in ("ids", "rows", "labels")}
                strip |= {c: batch.column(c)[at].as_py() for c in ("of", "of_rows", "of_labels", "positives", "bounds")}
                strip["scores"] = part.reshape(len(strip["of"]), -1).copy()
        if key is not None:
            yield out(strip)

    return run


def _scored(anchors: DataFrame, rows: DataFrame, choose, sizes: Sizes) -> DataFrame:
    """anchors: tiles with the row block `j` that each meets. What `choose` takes from every strip."""
    a = anchors.select("dim", "j", "k", F.col("block").alias("i"), F.col("m").alias("a"), F.col("ids").alias("of"), F.col("rows").alias("of_rows"), F.col("labels").alias("of_labels"), "positives", "bounds")
    b = rows.select("dim", F.col("block").alias("j"), "k", F.col("m").alias("b"), "ids", "rows", "labels")
    strips = a.join(b, ["dim", "j", "k"]).mapInArrow(_multiplied(sizes), from_arrow_schema(_STRIP))
    key = ["dim", "i", "j", "s"]
    dealt = strips.repartition(*key).sortWithinPartitions(*key, "k")
    return dealt.mapInArrow(_summed(choose), ", ".join(f"{c} long" for c in _FOUND))


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k highest of each key, ranked; tasks keep k a key before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(table: DataFrame, *, sizes: Sizes = Sizes(), **columns: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: see the module."""
    rows, groups = _grouped(written(usable(table, **columns), "negatives-rows"), sizes)
    rows = written(rows, "negatives-placed")
    tiles = written(_tiles(rows, groups, "start", "blocks", {}, sizes), "negatives-tiles")
    anchors = rows.where(_is_anchor())
    none = F.lit(None).cast(_NESTED_SQL)
    at = groups.select(*_GROUP, "start", "blocks", "all_blocks")

    own = _tiles(anchors, groups, "anchor_start", "anchor_blocks", {}, sizes).join(at, _GROUP)
    own = own.withColumn("j", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("blocks") - 1).cast("array<int>")))
    found = _scored(own.withColumn("positives", none).withColumn("bounds", none), tiles, _positives_of, sizes)
    anchor = ["anchor_id", "anchor_row"]
    best = _first(found, anchor, POSITIVES).groupBy(*anchor).agg(F.sort_array(F.collect_list(F.struct("rank", "id", "row", "score"))).alias("p"))
    best = written(best.select(F.col("anchor_id").alias("vec_id"), F.col("anchor_row").alias("row"), F.transform("p", lambda x: F.array(x["id"], x["row"])).alias("positives"), F.transform("p", lambda x: F.array(x["score"])).alias("bounds")), "negatives-positives")

    with_best = _tiles(anchors.join(best, ["vec_id", "row"]), groups, "anchor_start", "anchor_blocks", {"positives": _NESTED_SQL, "bounds": _NESTED_SQL}, sizes).join(at, _GROUP)
    others = with_best.withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("all_blocks") - 1).cast("int"))))
    others = others.where(F.col("small") | (F.col("j") < F.col("start")) | (F.col("j") >= F.col("start") + F.col("blocks")))
    found = _scored(others, tiles, _negatives_of, sizes)
    last = _first(found, [*anchor, "positive_id", "positive_row"], NEGATIVES)
    return last.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The same rows from DuckDB.
SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5"""

"""SimHash near-dedup through deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Of two fingerprints that differ in at most 3 bits, one half differs
in at most one bit. So each distinct fingerprint is indexed, for each half, under the half itself and under its 32
one-wildcard variants (one bit left out); an equality join on these keys finds the candidates, and the bit count of
their difference verifies them. A wildcard variant that only one side of the wildcard bit has is dropped.

Equal fingerprints are one node, so copies make no pairs. Near copies make few: a key is never joined with itself
whole, its fingerprints are linked in a number linear in them that connects the same components (see `links`).

Nulls, empty texts and ties: a text with no words (or null) has fingerprint zero and is linked like any other; a
component's id is the smallest doc_id in it (null only if all are); repeated rows keep their own rows. An empty
table gives an empty result. Extra columns are left out of `fingerprints` and `near_duplicates`, kept in `dedup`.

`dedup` with `percent` links by the exact Jaccard index of the sets of shingles instead: no bound on the bits is wide
enough to hold all such pairs and narrow enough to index, so the fingerprints bring the closest together, and what they
leave apart meets in the search of `shingle_join`; none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.components import components
from lodestrata.llm.shingle_join import Join, sets
from lodestrata.llm.shingles import majority, shingle_hashes
from lodestrata.llm.store import ROW, numbered, written

MAX_DISTANCE = 3
#: Fingerprints of a key that all others under it meet, and pairs a fingerprint up to which the rest meet pair by pair.
KEY_HUBS, CROSS = 4, 32


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash over the shingles of a text; repeats count."""
    return majority(shingle_hashes(text, shingle))


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row."""
    return _printed(docs, F.col(id_col).cast("long"), text_col, shingle, "long")


def _printed(docs: DataFrame, key: Column, text_col: str, shingle: int, kind: str) -> DataFrame:
    rows = docs.select(key.alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), f"doc_id {kind}, fp long")


def _keys(prints: DataFrame) -> DataFrame:
    """(fp, key, side): 33 keys a half. Hole 0 is the half itself (side null), hole i leaves out bit i - 1, whose value is side.

    A key holds the 32 bits that are left, the hole and the half, so that equal keys mean equal variants.
    """
    rows = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("i")).selectExpr("fp", "i div 33 AS half", "i % 33 AS hole")
    rows = rows.selectExpr("fp", "half", "hole", "shiftrightunsigned(fp, CAST(32 * half AS int)) & 4294967295L AS bits", "IF(hole = 0, 0L, shiftleft(1L, CAST(hole - 1 AS int))) AS bit")
    return rows.selectExpr("fp", "(bits & ~bit) | shiftleft(hole, 32) | shiftleft(half, 38) AS key", "IF(hole = 0, NULL, (bits & bit) <> 0) AS side")


def links(prints: DataFrame, cross: int = CROSS) -> DataFrame:
    """(a, b), a < b: pairs of distinct fingerprints that connect all within 3 bits of each other.

    Their number, and that of the pairs tried, is at most a constant times the keys, whatever shares a key: first
    every fingerprint of a key meets a few (hubs) of it; then, where a key still holds several components, those of
    different components meet if that is `cross` pairs a fingerprint at most, else they go through `_ball_links`.
    """
    keys = _keys(prints.select("fp").distinct())
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("low"), F.max("side").alias("high"))
    shared = written(counts.where("n > 1 AND (low IS NULL OR low <> high)").select("key"), "simhash-shared")
    kept = written(keys.join(shared, "key").select("key", "fp"), "simhash-keys")

    def verified(pairs: DataFrame) -> DataFrame:
        near = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE)
        return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    hubs = kept.groupBy("key").agg(F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("fp", F.lit(k)).alias("r"), "fp"))["fp"] for k in range(KEY_HUBS)])).alias("hubs"))
    met = kept.select("key", F.col("fp").alias("b")).join(hubs.select("key", F.explode("hubs").alias("a")), "key").where("a <> b")
    found = written(verified(met), "simhash-hubs")

    labels = components(found)
    placed = kept.join(labels, kept["fp"] == labels["node"], "left").select("key", "fp", F.coalesce("label", "fp").alias("label"))
    apart = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    placed = written(placed.join(apart, "key", "left_semi"), "simhash-apart")
    if placed.isEmpty():
        return found
    parts = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    sums = parts.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.max_by("label", F.struct("c", "label")).alias("main"))
    sums = written(sums.select("key", "main", ((F.col("n") * F.col("n") - F.col("squares")) / 2 > cross * F.col("n")).alias("many")), "simhash-parts")
    # One side without the largest component of a key: at most four times as many comparisons as pairs between components.
    few = placed.join(sums.where("NOT many"), "key")
    left = few.where("label <> main").select("key", F.col("fp").alias("a"), F.col("label").alias("la"))
    right = few.select("key", F.col("fp").alias("b"), F.col("label").alias("lb"))
    found = found.union(verified(left.join(right, "key").where("la <> lb")))
    many = written(placed.join(sums.where("many"), "key", "left_semi").select("fp").distinct(), "simhash-many")
    return found if many.isEmpty() else found.union(_ball_links(many))


def _ball_links(prints: DataFrame) -> DataFrame:
    """Links with the same components as all pairs within 3 bits, in a number linear in the fingerprints.

    Two fingerprints at most 3 bits apart have a point within 1 of one and 2 of the other. All within 1 of a point
    are within 3 of all within 2 of it, so each of the latter is linked to the smallest of the former. A point has at
    most 1 + 64 + 2016 fingerprints around it, however large the group.
    """
    one = F.expr("transform(sequence(0, 63), i -> shiftleft(1L, i))")
    two = F.expr("flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> shiftleft(1L, i) | shiftleft(1L, j))))")
    points = prints.select("fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), one, two)).alias("flip"))
    points = points.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), (F.bit_count("flip") <= 1).alias("close"))
    hub = F.min(F.when(F.col("close"), F.col("fp"))).over(Window.partitionBy("point"))
    found = points.select("fp", hub.alias("hub")).where("hub IS NOT NULL AND hub <> fp")
    return found.select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, cross: int = CROSS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    prints = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "simhash")
    groups = _groups(prints, cross)
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _groups(prints: DataFrame, cross: int) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint."""
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    labels = components(links(prints, cross))
    joined = first.join(labels, first["fp"] == labels["node"], "left").select("fp", "first", "label")
    linked = joined.where("label IS NOT NULL")
    least = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    alone = joined.where("label IS NULL").select("fp", F.col("first").alias("component_id"))
    return written(alone.union(linked.join(least, "label").select("fp", "component_id")), "simhash-groups")


def _like_groups(rows: DataFrame, texts: DataFrame, shingle: int, percent: int, cross: int) -> DataFrame:
    """(row, group) of every row: sets that the fingerprints bring together are tried first, then all others meet."""
    join = Join(rows, texts, shingle, percent)
    of_print = join.nodes.groupBy("fp").agg(F.min("node").alias("a"))
    close = links(join.nodes.select("fp"), cross).toDF("fa", "fb").join(of_print.toDF("fa", "a"), "fa").join(of_print.toDF("fb", "b"), "fb").select("a", "b")
    same = join.nodes.select("fp", F.col("node").alias("b")).join(of_print, "fp").select("a", "b")
    labels = components(join.links(close.union(same)))
    return join.rows.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("group"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int | None = None, cross: int = CROSS) -> DataFrame:
    """The rows of docs with one document kept of each group: that of the smallest id, one row of it if repeated.

    Groups connect fingerprints within 3 bits, or, with `percent`, sets of shingles whose Jaccard index reaches it.
    Rows with a null id stay only in a group that has no other, the first by text. All columns stay.
    """
    tagged = numbered(docs, "__row")
    ids = tagged.select(F.col("__row").alias("doc_id"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("h"))
    order = F.struct(F.col("id").isNull(), "id", "h", "doc_id")
    if percent is None:
        prints = written(_printed(tagged, F.col("__row"), text_col, shingle, ROW), "simhash-rows")
        grouped = prints.join(_groups(prints, cross).withColumnRenamed("component_id", "group"), "fp")
    else:
        texts = tagged.select(F.col("__row").alias("doc_id"), F.col(text_col).alias("text"))
        grouped = _like_groups(sets(texts, shingle, percent, True), texts, shingle, percent, cross)
    keep = grouped.join(ids, "doc_id").groupBy("group").agg(F.min(order).alias("best")).select(F.col("best.doc_id").alias("__row"))
    return tagged.join(keep, "__row", "left_semi").drop("__row")

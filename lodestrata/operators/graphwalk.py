"""Distances in a graph from many centres at once, in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators import marks
from lodestrata.operators.steps import counted, kept
from lodestrata.runtime import ship

#: Sets of a frontier (1 kB each at most) up to which it goes to the edges, not the edges to it.
SENT = 65_536


def distances(edges: DataFrame, a: str, b: str, centres: DataFrame, centre: str, depth: int) -> DataFrame:
    """(centre, node, distance): every node up to `depth` edges (either way) from each centre, the centre itself included.

    Rows of the result are as many as centres times nodes where all is connected, so they are made last and neither
    moved nor stored: until then a node has the set of centres that reach it, a bit each, in blocks of centres. A round
    takes the sets that are new to a node to its neighbours, unites them there, and keeps what those don't have yet. So
    what is moved is at most a bit a centre for each edge, much less where tasks unite sets of one node, and nothing but
    the sets if few are new: they go to the edges, which lie by their ends. Parallel edges count once. Null ends and
    null centres are left out.
    """
    ship(edges.sparkSession)
    one_way = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).where("node IS NOT NULL AND next IS NOT NULL AND node <> next")
    ways = kept(one_way.union(one_way.select("next", "node")).distinct().repartition("next").sortWithinPartitions("next"))
    start = kept(centres.select(F.col(centre).alias("centre")).where("centre IS NOT NULL").distinct())
    dealt = start.repartition(max(1, -(-start.count() // marks.BLOCK)), "centre").withColumn("at", F.monotonically_increasing_id())
    block, bit = F.expr(f"at DIV {marks.BLOCK}"), F.expr(f"CAST(at % {marks.BLOCK} AS INT)")
    known = counted(dealt.select("centre", block.alias("block"), bit.alias("bit")))
    little = F.unhex(F.concat(F.lpad(F.hex(F.col("bit") % 256), 2, "0"), F.lpad(F.hex(F.expr("bit DIV 256")), 2, "0")))
    own = known.select(F.col("centre").alias("node"), "block", little.alias("bits"))
    kind = ways.schema["node"].dataType.simpleString()
    seen = frontier = kept(own.withColumn("distance", F.lit(0)))
    for step in range(1, depth + 1):
        few = frontier.count() <= SENT
        near = ways.join(F.broadcast(frontier) if few else frontier, "node").select(F.col("next").alias("node"), "block", "bits")
        near = near.mapInArrow(marks.united, f"node {kind}, block long, bits binary")
        both = near.withColumn("new", F.lit(True)).union(seen.select("node", "block", "bits", F.lit(False)))
        both = both.repartition("node", "block").sortWithinPartitions("node", "block")
        frontier = kept(both.mapInArrow(marks.news, f"node {kind}, block long, bits binary").withColumn("distance", F.lit(step)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    held = seen.mapInArrow(marks.members, f"node {kind}, block long, distance int, held array<int>")
    return held.select("node", "block", "distance", F.explode("held").alias("bit")).join(known, ["block", "bit"]).select("centre", "node", "distance")


def edges_by_distance(edges: DataFrame, a: str, b: str, edge: str, reached: DataFrame) -> DataFrame:
    """(centre, edge, distance): the edges that touch a reached node, by the nearer of their ends."""
    ends = edges.select(F.col(edge).alias("edge"), F.explode(F.array_distinct(F.array(a, b))).alias("node"))
    return ends.join(reached, "node").groupBy("centre", "edge").agg(F.min("distance").alias("distance"))


def nearest_edges(edges: DataFrame, a: str, b: str, edge: str, centres: DataFrame, centre: str, depth: int, limit: int) -> DataFrame:
    """(centre, edge, distance, rank): the `limit` edges nearest to each centre by the nearer of their ends, ties by id.

    The same as the first of `edges_by_distance` over `distances`, without walking to all that a centre reaches: a centre
    with `limit` edges is done, as no further step finds a nearer one. One that isn't has fewer edges than that so far,
    so it has met fewer nodes too, and of each node the first 2 * limit edges are enough: those it knows already are
    under `limit`. So a round moves at most limit * 2 * limit rows a centre, whatever edges its nodes have.
    """
    one_way = edges.select(F.col(edge).alias("edge"), F.col(a).alias("node"), F.col(b).alias("next"))
    by_id = Window.partitionBy("node").orderBy(F.col("edge").asc_nulls_last())
    ways = one_way.union(one_way.select("edge", "next", "node")).where("node IS NOT NULL").withColumn("nth", F.dense_rank().over(by_id))
    ways = kept(ways.where(F.col("nth") <= 2 * limit).select("node", "edge", "next"))
    start = centres.select(F.col(centre).alias("centre")).where("centre IS NOT NULL").distinct()
    seen = frontier = kept(start.select("centre", F.col("centre").alias("node")))
    found = None
    for step in range(depth + 1):
        met = frontier.join(ways, "node")
        touched = met.select("centre", "edge", F.lit(step).alias("distance"))
        both = touched if found is None else found.drop("rank").union(touched)
        nearest = both.groupBy("centre", "edge").agg(F.min("distance").alias("distance"))
        found = kept(ranked(nearest, ["centre"], [F.col("distance"), F.col("edge").asc_nulls_last()], limit))
        if step == depth:
            break
        undone = found.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < limit).select("centre")
        further = met.join(undone, "centre", "left_semi").where("next IS NOT NULL").select("centre", F.col("next").alias("node")).distinct()
        frontier = kept(further.join(seen, ["centre", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return found


def ranked(found: DataFrame, keys: list[str], order: list, limit: int) -> DataFrame:
    """found with the rank of each row of its keys, the first `limit`."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= limit)

"""What overlaps a period, without meeting its rows: aggregates over the nodes of a binary tree of days.

A closed interval of days is cut into the fewest whole nodes of the tree (at most two a level). Two intervals overlap
just if a node of the one lies above, below or at a node of the other. So what overlaps an interval can be summed up from
three tables of aggregates, one row a key and node: what was put at a node, the same summed over all nodes below, and
over all nodes above. Rows cost the logarithm of their length; no two rows of a key ever meet, and a key with very many
rows is spread over its nodes and added up in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of the tree: days from the first to the 2**LEVELS-th that it spans. Day 0 is the first of the year 1600.
LEVELS, ORIGIN = 18, "1600-01-01"


def day(date: Column) -> Column:
    """The number of a date's day; dates outside the tree count as its first or last day."""
    n = F.datediff(date, F.lit(ORIGIN).cast("date"))
    return F.least(F.greatest(n, F.lit(0)), F.lit((1 << LEVELS) - 1))


def nodes(start: Column, end: Column) -> Column:
    """The fewest nodes (level, at) that make up the days from start to end; none if end is before start.

    Level by level: a begin that is a right child and an end that is a left child are nodes of their own, and what is
    left between them halves.
    """
    begun = F.struct(start.cast("int").alias("l"), (end.cast("int") + 1).alias("r"), F.array().cast("array<struct<level:int,at:int>>").alias("found"))

    def step(s: Column, level: Column) -> Column:
        open_ = s["l"] < s["r"]
        left = open_ & (s["l"] % 2 == 1)
        l2 = s["l"] + F.when(left, 1).otherwise(0)
        right = (l2 < s["r"]) & (s["r"] % 2 == 1)
        r2 = s["r"] - F.when(right, 1).otherwise(0)
        node = lambda at: F.struct(level.alias("level"), at.cast("int").alias("at"))
        none = F.array().cast("array<struct<level:int,at:int>>")
        grown = F.concat(s["found"], F.when(left, F.array(node(s["l"]))).otherwise(none), F.when(right, F.array(node(r2))).otherwise(none))
        return F.struct(F.floor(l2 / 2).cast("int").alias("l"), F.floor(r2 / 2).cast("int").alias("r"), grown.alias("found"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), begun, step)["found"]


def _climb(df: DataFrame) -> DataFrame:
    """Each row once for its node and once for each node above: up, up_at."""
    risen = df.withColumn("up", F.explode(F.sequence(F.col("level"), F.lit(LEVELS))))
    return risen.withColumn("up_at", F.expr("shiftright(at, up - level)"))


def extremes_of_overlapping(rows: DataFrame, keys: list[str], start: str, end: str, value: str, id_col: str) -> DataFrame:
    """rows with least, most (value) and first_id, last_id of the rows of their key whose period overlaps theirs, their own included.

    start and end are dates; a row with a null one, or an end before its start, is taken to overlap all rows of its key.
    A null value counts for the ids alone.
    """
    parts = {"least": F.min, "most": F.max, "first_id": F.min, "last_id": F.max}
    own = {"least": value, "most": value, "first_id": id_col, "last_id": id_col}
    gathered = lambda: [agg(n).alias(n) for n, agg in parts.items()]
    bounds = [F.col(c).alias(n) for n, c in own.items()]
    known = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end))

    dated = rows.where(known).select(*keys, F.col(id_col).alias("__id"), *bounds, F.explode(nodes(day(F.col(start)), day(F.col(end)))).alias("node"))
    dated = dated.select(*keys, "__id", *parts, "node.level", "node.at")
    at = dated.groupBy(*keys, "level", "at").agg(*gathered())
    climbed = _climb(at)
    below = climbed.groupBy(*keys, F.col("up").alias("level"), F.col("up_at").alias("at")).agg(*gathered())
    asked = at.select(*keys, "level", "at")
    up = at.select(*keys, F.col("level").alias("up"), F.col("at").alias("up_at"), *parts)
    above = _climb(asked).join(up, [*keys, "up", "up_at"]).select(*keys, "level", "at", *parts)
    around = above.unionByName(below.join(asked, [*keys, "level", "at"], "left_semi")).groupBy(*keys, "level", "at").agg(*gathered())

    met = dated.select(*keys, "__id", "level", "at").join(around, [*keys, "level", "at"]).groupBy(*keys, "__id").agg(*gathered())
    loose = rows.where(~known).select(*keys, *bounds).groupBy(*keys).agg(*gathered())
    whole = rows.select(*keys, *bounds).groupBy(*keys).agg(*gathered())
    named = lambda df, prefix: df.select(*keys, *[F.col(n).alias(f"__{prefix}_{n}") for n in parts])
    met = met.select(*keys, F.col("__id").alias(id_col), *[F.col(n).alias(f"__met_{n}") for n in parts])
    joined = rows.join(met, [*keys, id_col], "left").join(named(loose, "loose"), keys, "left").join(named(whole, "whole"), keys)
    pick = {"least": F.least, "most": F.greatest, "first_id": F.least, "last_id": F.greatest}
    out = [F.when(known, f(F.col(f"__met_{n}"), F.col(f"__loose_{n}"))).otherwise(F.col(f"__whole_{n}")).alias(n) for n, f in pick.items()]
    return joined.select(*rows.columns, *out)


def sums_around(points: DataFrame, asked: DataFrame, keys: list[str], day: str, values: list[str]) -> DataFrame:
    """keys and day of points and asked, with <value>_upto and <value>_after: sums over the points of the key up to the day, itself included, and after it.

    Points are summed up by day first, so that a key has one row a day in the window, however many points it has.
    """
    none = asked.select(*keys, day, *[F.lit(0).cast("long").alias(v) for v in values])
    days = points.select(*keys, day, *values).unionByName(none).groupBy(*keys, day).agg(*[F.sum(v).alias(v) for v in values])
    whole = Window.partitionBy(*keys)
    upto = {v: F.sum(v).over(whole.orderBy(day)) for v in values}
    return days.select(*keys, day, *[s.alias(f"{v}_upto") for v, s in upto.items()], *[(F.sum(v).over(whole) - s).alias(f"{v}_after") for v, s in upto.items()])

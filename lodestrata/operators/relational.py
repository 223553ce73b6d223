"""Joins, set operations, change sets and counts that the plans compose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def touching(left: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """Rows once for each distinct entity among `keys`: a disjunctive join as an explode and an equi-join."""
    return left.withColumn(entity, F.explode(F.array_distinct(F.array(*keys))))


def change_set(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and change (inserted, updated, deleted) of each row that differs; equal rows don't appear. One full outer join."""
    o = old.select(F.col(key).alias("o_key"), F.struct(*columns).alias("o"))
    n = new.select(F.col(key).alias("n_key"), F.struct(*columns).alias("n"))
    both = o.join(n, F.col("o_key") == F.col("n_key"), "full_outer")
    change = F.when(F.col("o_key").isNull(), "inserted").when(F.col("n_key").isNull(), "deleted").when(~F.col("o").eqNullSafe(F.col("n")), "updated")
    return both.select(F.coalesce("o_key", "n_key").alias(key), change.alias("change")).where("change IS NOT NULL")


def zero_filled(df: DataFrame, column: str, words: list[str], out: str = "n") -> DataFrame:
    """Count of each word of a closed vocabulary, 0 where it doesn't occur. One aggregation over all words at once."""
    counts = df.agg(*[F.count_if(F.col(column) == w).alias(f"c{i}") for i, w in enumerate(words)])
    rows = F.array(*[F.struct(F.lit(w).alias(column), F.col(f"c{i}").alias(out)) for i, w in enumerate(words)])
    return counts.select(F.explode(rows).alias("x")).select("x.*")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, kept with the number of rows folded into it as `repeats`."""
    w = Window.partitionBy(*keys)
    return df.withColumn("repeats", F.count(F.lit(1)).over(w)).withColumn("__rn", F.row_number().over(w.orderBy(*order))).where("__rn = 1").drop("__rn")


def reason(*rules: tuple[str, Column]) -> Column:
    """First rule that fails a row, in order; null if none does."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules])


def overlapping_pairs(df: DataFrame, keys: list[str], id_col: str, start: str, end: str, keep: list[str]) -> DataFrame:
    """Pairs (a_, b_) of rows with equal keys whose half-open periods overlap, each once. An equi-join on the keys."""
    a = df.select(*[F.col(c).alias(f"a_{c}") for c in dict.fromkeys([*keys, id_col, start, end, *keep])])
    b = df.select(*[F.col(c).alias(f"b_{c}") for c in dict.fromkeys([*keys, id_col, start, end, *keep])])
    on = [F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys] + [F.col(f"a_{id_col}") < F.col(f"b_{id_col}"), F.col(f"a_{start}") < F.col(f"b_{end}"), F.col(f"b_{start}") < F.col(f"a_{end}")]
    return a.join(b, on)


def keyset_page(df: DataFrame, order: str, after: object, size: int) -> DataFrame:
    """The rows after a key, in order: a pushed filter and a bounded sort."""
    return df.where(F.col(order) > F.lit(after)).orderBy(order).limit(size)


def spread(df: DataFrame, group: str, order: list[Column], first: int, n: int) -> DataFrame:
    """n rows with at most `first` a group before any group gets more; `place` numbers them.

    Only the first n rows of each group can be in the result, so tasks keep n rows a group before the shuffle.
    """
    inner = Window.partitionBy(group).orderBy(*order)
    cut = df.withColumn("__k", F.row_number().over(inner)).where(F.col("__k") <= n)
    best = cut.orderBy(F.col("__k") > first, *order).limit(n)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.col("__k") > first, *order))).drop("__k")

"""Write operators as DataFrames: what a sink has to insert, keep, replace or remove.

Parquet has no MERGE, so each returns the rows to write or the keys to drop; content-derived ids make them idempotent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_write_wins(old: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows of `new` to append: keys that `old` doesn't have, the first of each."""
    w = Window.partitionBy(key).orderBy(*order)
    fresh = new.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    return fresh.join(old.select(key), key, "left_anti").select(*new.columns)


def last_write_wins(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table after the upsert: rows of `new`, and rows of `old` whose key it doesn't have."""
    return old.join(new.select(key), key, "left_anti").select(*new.columns).union(new)


def cascade_counts(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows per table that deleting the parents would remove, the parents last: a dry run."""
    out = None
    for name, (child, column) in children.items():
        hit = child.join(parents.select(F.col(key).alias(column)).distinct(), column, "left_semi").agg(F.count(F.lit(1)).alias("n"))
        one = hit.select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    own = parents.agg(F.count(F.lit(1)).alias("n")).select(F.lit("parents").alias("name"), "n")
    return own if out is None else out.union(own)


def unordered_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """Both sides with the smaller first, so that a pair has one key."""
    return F.least(a, b), F.greatest(a, b)


def in_given_order(df: DataFrame, key: str, wanted: list) -> DataFrame:
    """The rows of the wanted keys, with their place in the list. The list is the caller's literal, and is broadcast."""
    places = df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, wanted))).alias("place", "__key"))
    return df.join(F.broadcast(places), F.col(key) == F.col("__key")).drop("__key")

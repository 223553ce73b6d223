"""Numbers and running sums along a key's order, in slices, so that a key with very many rows is no single group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], slice_: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """df with the sum of `value` up to each row in its key's order; `slice_` must rise with the order.

    Rows are summed within (key, slice); what the slices before hold is added from one row a slice.
    """
    cut = df.withColumn("__slice", slice_).withColumn("__value", value)
    totals = cut.groupBy(*keys, "__slice").agg(F.sum("__value").alias("__sum"))
    before = totals.select(*keys, "__slice", F.coalesce(F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.sum("__value").over(Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn(out, own).join(before, [*keys, "__slice"]).withColumn(out, F.col(out) + F.col("__before")).drop("__slice", "__value", "__before")

"""Names that are alike by their trigrams: found through their rarest grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import values as V


def _least(size: Column, percent: int) -> Column:
    return F.ceil(size * percent / 100).cast("int")


def similar(names: DataFrame, asked: DataFrame, name: str, percent: int) -> DataFrame:
    """(asked, name, similarity): names whose sets of trigrams have a Jaccard index of `percent` or more with an asked one's.

    Names alike share all but a part of their grams, so one of the first n - ceil(percent * n / 100) + 1 of each, in any
    common order. The order here is by how many names have a gram, so names meet under their rare grams and not under
    those that all have; and only names whose sizes let them be alike. An asked name doesn't meet itself. Names come once,
    however often they are in a table; null ones and those without grams are left out.
    """
    both = names.select(F.col(name).alias("name"), F.lit(False).alias("asks")).union(asked.select(name, F.lit(True)))
    once = both.where("name IS NOT NULL").groupBy("name").agg(F.bool_or("asks").alias("asks"), F.bool_or(~F.col("asks")).alias("held"))
    once = once.withColumn("grams", V.trigrams(F.col("name"))).withColumn("size", F.size("grams")).where("size > 0")
    apart = once.select("name", F.explode("grams").alias("gram"))
    often = apart.groupBy("gram").agg(F.count(F.lit(1)).alias("times"))
    ordered = apart.join(often, "gram").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("times", "gram"))).alias("o"))
    first = once.join(ordered, "name").select("name", "asks", "held", "grams", "size", F.explode(F.slice("o", 1, F.col("size") - _least(F.col("size"), percent) + 1)).alias("x"))
    first = first.select("name", "asks", "held", "grams", "size", "x.gram")
    a = first.where("asks").select(F.col("name").alias("asked"), F.col("grams").alias("a_grams"), F.col("size").alias("a_size"), "gram")
    met = a.join(first.where("held").select("name", "grams", "size", "gram"), "gram")
    fits = (F.col("asked") != F.col("name")) & (F.col("size") >= _least(F.col("a_size"), percent)) & (F.col("a_size") >= _least(F.col("size"), percent))
    met = met.where(fits).groupBy("asked", "name").agg(F.first("a_grams").alias("a_grams"), F.first("grams").alias("grams"))
    common = F.size(F.array_intersect("a_grams", "grams"))
    all_ = F.size("a_grams") + F.size("grams") - common
    return met.where(100 * common >= percent * all_).select("asked", "name", F.round(common / all_, 6).alias("similarity"))


def searched(names: DataFrame, asked: DataFrame, name: str, id_col: str, key: Column, percent: int, exact: int, fuzzy: int) -> DataFrame:
    """(asked, id, arm, similarity, place): first the `exact` smallest ids whose key is that of the name asked for, then the
    `fuzzy` most alike of the others, ties by id.

    names: id and name. Rows of one name are alike alike; each arm keeps its own number of rows, in the tasks before the
    shuffle too.
    """
    keyed = names.select(F.col(id_col).alias("id"), F.col(name).alias("name"), key.alias("key"))
    asks = asked.select(F.col(name)).where(F.col(name).isNotNull()).distinct().select(F.col(name).alias("asked"), key.alias("a_key"))
    same = asks.join(keyed, F.col("a_key") == F.col("key")).select("asked", "id", F.lit("exact").alias("arm"), F.lit(1.0).alias("similarity"))
    other = similar(names, asked, name, percent).join(asks, "asked").join(keyed, "name").where(~F.col("key").eqNullSafe(F.col("a_key"))).select("asked", "id", F.lit("fuzzy").alias("arm"), "similarity")
    w = Window.partitionBy("asked").orderBy(F.col("similarity").desc(), "id")
    cut = lambda df, most: df.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")
    both = cut(same, exact).union(cut(other, fuzzy))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy("arm", F.col("similarity").desc(), "id")))

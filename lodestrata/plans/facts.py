"""The fact model: latest run per city, claims with evidence, ranked facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.ranking import latest_by, top_k
from lodestrata.sources.tables import table


def fact_view_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts (lineitem) of each city's (customer) latest run (order) that stand, with source and statistic; best two a city."""
    runs = latest_by(table(spark, sf_dir, "orders").where("o_orderstatus IN ('F', 'O')"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    claims = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'")
    source = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    view = runs.select("o_custkey", "o_orderkey").join(claims, F.col("o_orderkey") == F.col("l_orderkey")).join(source, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    best = top_k(view, ["o_custkey"], [F.col("s_acctbal").desc(), F.col("p_retailprice").desc(), F.col("l_linenumber"), F.col("l_partkey")], 2)
    return best.select(F.col("o_custkey").alias("city"), F.col("o_orderkey").alias("run"), F.col("l_linenumber").alias("claim_no"), F.col("s_name").alias("source"), F.col("p_name").alias("statistic"), F.col("rank"))


QUERIES = {"fact_view_topk": fact_view_topk}

ORACLES = {
    "fact_view_topk": """
        WITH run AS (
          SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn
          FROM orders WHERE o_orderstatus IN ('F', 'O')),
        v AS (
          SELECT o_custkey, o_orderkey, l_linenumber, s_name, p_name,
            row_number() OVER (PARTITION BY o_custkey ORDER BY s_acctbal DESC, p_retailprice DESC, l_linenumber, l_partkey) rk
          FROM run JOIN lineitem ON l_orderkey = o_orderkey AND rn = 1
          JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey
          WHERE l_returnflag <> 'R')
        SELECT o_custkey AS city, o_orderkey AS run, l_linenumber AS claim_no, s_name AS source, p_name AS statistic, CAST(rk AS INT) AS rank
        FROM v WHERE rk <= 2""",
}

"""Parsing of raw documents: bytes in several charsets, tables with spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import documents as D
from lodestrata.sources.tables import table


def decoded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as bytes in four charsets, declared or not, read back."""
    t = table(spark, d, "benchmark").select("item_id", F.translate("text", "œŒŸ", "oOY").alias("text"))
    k = F.col("item_id") % 4
    raw = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.encode("text", "ISO-8859-1")).when(k == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).otherwise(F.concat(F.lit("<meta charset='iso-8859-1'>").cast("binary"), F.encode("text", "ISO-8859-1")))
    return D.decoded(t.select("item_id", raw.alias("raw"), F.when(k == 1, "text/html; charset=ISO-8859-1").alias("type")), "item_id", "raw", "type").select(F.col("id").alias("item_id"), "text")


def spanned_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables made of nations: the region's cell spans its rows, the head is two wide; one line a row."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    cells = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    rows = F.array_join(F.transform("x", lambda s, i: F.concat(F.lit("<tr>"), F.when(i == 0, F.concat(F.lit("<td rowspan="), F.size("x"), F.lit(">"), "r_name", F.lit("<sup><a href=#1>1</a></sup></td>"))).otherwise(""), F.lit("<td>"), s["n_name"], F.lit("<td>10<sup>"), s["n_nationkey"], F.lit("</sup></tr>"))), "")
    html = F.concat(F.lit("<p>x<table><tr><th colspan=2>Place<th>n</tr>"), rows, F.lit("</table>"))
    t = r.join(cells, F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", html.alias("html"))
    return D.html_tables(t, "r_regionkey", "html").select(F.col("id").alias("r_regionkey"), "row_no", F.array_join("cells", "|").alias("line"))


QUERIES = {f.__name__: f for f in (decoded_texts, spanned_tables)}

ORACLES = {
    "decoded_texts": "SELECT item_id, CASE WHEN item_id % 4 = 3 THEN '<meta charset=''iso-8859-1''>' ELSE '' END || translate(text, 'œŒŸ', 'oOY') AS text FROM benchmark",
    "spanned_tables": """WITH r AS (SELECT r_regionkey, r_name, n_nationkey, n_name, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS INT) AS row_no FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT r_regionkey, row_no, r_name || '|' || n_name || '|10^' || n_nationkey AS line FROM r UNION ALL SELECT r_regionkey, 0, 'Place||n' FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)""",
}

"""Assembly of what is shown or kept: dates at their precision, report sections, merged attributes, traces, escapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.sources.tables import table

#: Formats of a date by its precision, and keys of a payload whose values no trace may show.
FORMATS = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}
SECRET_KEYS = r"(?i)^(.*_)?(token|password|secret|key)$"
TRACE_CHARS = 80


def at_precision(when: Column, precision: Column) -> Column:
    """The date as far as it is known; null if either is, or the precision is none of the three."""
    out = F.lit(None).cast("string")
    for name, form in FORMATS.items():
        out = F.when(precision == name, F.date_format(when, form)).otherwise(out)
    return out


def escaped(text: Column) -> Column:
    """Untrusted text as it can stand inside markup."""
    for sign, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(reference))
    return text


def rendered_dates(spark: SparkSession, d: str) -> DataFrame:
    """Order dates at a precision that follows the status."""
    precision = F.when(F.col("o_orderstatus") == "F", "day").when(F.col("o_orderstatus") == "O", "month").otherwise("year")
    return table(spark, d, "orders").select("o_orderkey", at_precision(F.col("o_orderdate"), precision).alias("period"))


def escaped_texts(spark: SparkSession, d: str) -> DataFrame:
    """Pages as escaped text, by hash and length."""
    text = escaped(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.sha2(text, 256).alias("sha"), F.length(text).cast("long").alias("n"))


def trace_lines(spark: SparkSession, d: str) -> DataFrame:
    """Payload entries, and the user's token, as a trace keeps them: secret ones masked, long ones cut with their length."""
    entries = F.map_concat(F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>")), F.create_map(F.lit("user_token"), F.col("user_id").cast("string")))
    rows = table(spark, d, "events").select("event_id", F.explode(entries).alias("key", "value"))
    long = F.concat(F.substring("value", 1, TRACE_CHARS), F.lit("… "), F.length("value").cast("string"))
    shown = F.when(F.col("key").rlike(SECRET_KEYS), "[redacted]").when(F.length("value") > TRACE_CHARS, long).otherwise(F.col("value"))
    return rows.select("event_id", "key", shown.alias("shown"))


def merged_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Each user's attributes after all changes in order: of equal keys the last one wins."""
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return rows.groupBy("user_id", "key").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def report_sections(spark: SparkSession, d: str) -> DataFrame:
    """A Markdown section per region: its nations with customers and orders, most orders first.

    Counts are made per nation before the lines of a section meet, so a section is as long as its list of nations.
    """
    o, c = table(spark, d, "orders").select("o_custkey"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    own = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    per = c.join(own, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"))
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rows = n.join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "n_nationkey", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("orders", F.lit(0)).alias("orders"))
    line = F.concat(F.lit("- "), escaped(F.col("n_name")), F.lit(": "), F.col("customers").cast("string"), F.lit(" customers, "), F.col("orders").cast("string"), F.lit(" orders"))
    lines = F.array_sort(F.collect_list(F.struct((-F.col("orders")).alias("o"), "n_nationkey", line.alias("line"))))
    sections = rows.groupBy("r_name").agg(lines.alias("lines"))
    return sections.select("r_name", F.concat(F.lit("## "), escaped(F.col("r_name")), F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("section"))


def wording_of_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Answers repaired from stored values: a customer's note names the latest order's month, or says there is none."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    last = o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("x"))
    c = table(spark, d, "customer").select("c_custkey", "c_name").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    note = F.when(F.col("x").isNull(), F.concat("c_name", F.lit(" has no order on record."))).otherwise(F.concat("c_name", F.lit(" last ordered in "), at_precision(F.col("x.o_orderdate"), F.lit("month")), F.lit(".")))
    return c.select("c_custkey", note.alias("note"))


def renumbered_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources of each language numbered by their first document, with the documents that cite them."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source").where("source IS NOT NULL")
    first = docs.groupBy("lang", "source").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("cited"))
    return first.select("lang", "source", F.row_number().over(Window.partitionBy("lang").orderBy("first")).alias("number"), "cited")


QUERIES = {f.__name__: f for f in (rendered_dates, escaped_texts, trace_lines, merged_attributes, report_sections, wording_of_gaps, renumbered_sources)}

_ENTRIES = "SELECT event_id, user_id, ts, key, json_extract_string(props, '$.\"' || key || '\"') AS value FROM (SELECT *, unnest(json_keys(props)) AS key FROM events)"
_PER = "SELECT c_nationkey, count(*) AS customers, sum(coalesce(n, 0)) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey GROUP BY 1"
_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

ORACLES = {
    "rendered_dates": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'O' THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END AS period FROM orders",
    "escaped_texts": f"SELECT page_id, sha256({_ESCAPED.format('html')}) AS sha, length({_ESCAPED.format('html')}) AS n FROM pages",
    "trace_lines": f"SELECT event_id, key, CASE WHEN regexp_matches(key, '{SECRET_KEYS}') THEN '[redacted]' WHEN length(value) > {TRACE_CHARS} THEN value[:{TRACE_CHARS}] || '… ' || length(value) ELSE value END AS shown FROM (SELECT event_id, key, value FROM ({_ENTRIES}) UNION ALL SELECT event_id, 'user_token', CAST(user_id AS VARCHAR) FROM events)",
    "merged_attributes": f"SELECT user_id, key, arg_max(value, (ts, event_id)) AS value FROM ({_ENTRIES}) GROUP BY 1, 2",
    "report_sections": f"""SELECT r_name, '## ' || {_ESCAPED.format('r_name')} || chr(10) || string_agg('- ' || {_ESCAPED.format('n_name')} || ': ' || CAST(coalesce(customers, 0) AS BIGINT) || ' customers, ' || CAST(coalesce(orders, 0) AS BIGINT) || ' orders', chr(10) ORDER BY coalesce(orders, 0) DESC, n_nationkey) AS section
        FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN ({_PER}) ON n_nationkey = c_nationkey GROUP BY r_name""",
    "wording_of_gaps": "SELECT c_custkey, c_name || coalesce(' last ordered in ' || strftime(m, '%Y-%m') || '.', ' has no order on record.') AS note FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "renumbered_sources": "SELECT lang, source, CAST(row_number() OVER (PARTITION BY lang ORDER BY f) AS INT) AS number, cited FROM (SELECT lang, source, min(doc_id) AS f, count(*) AS cited FROM documents WHERE source IS NOT NULL GROUP BY 1, 2)",
}

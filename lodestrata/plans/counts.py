"""Counts, roll-ups, change sets and evaluation figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.values import collapse
from lodestrata.operators import relational as R
from lodestrata.sources.tables import table

EVENT_TYPES = ["view", "click", "purchase", "refund", "error", "login", "signup"]


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    """Users and rows by outcome (event type), a missing one as none."""
    return table(spark, d, "events").groupBy(F.coalesce("event_type", F.lit("none")).alias("outcome")).agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("n"))


def zero_filled_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.zero_filled(table(spark, d, "events"), "event_type", EVENT_TYPES)


def day_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events since the start of each user's last day."""
    e = table(spark, d, "events").select("user_id", "ts")
    last = e.groupBy("user_id").agg(F.date_trunc("day", F.max("ts")).alias("day"))
    return e.join(last, "user_id").where("ts >= day").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def prefix_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Orders by priority class (the number before the dash), one column a status."""
    o = table(spark, d, "orders").withColumn("bucket", F.substring_index("o_orderpriority", "-", 1))
    return o.groupBy("bucket").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(f"n_{s.lower()}") for s in "FOP"])


def coverage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Conditional counts per region, and the total, which a flag tells from a region without name."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("answered"), F.count_if(F.col("o_orderstatus") == "P").alias("partial"), F.count_if(F.col("o_totalprice") > 200000).alias("wide"), (F.grouping("r_name") == 1).alias("total"))


def fold_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Equal texts folded: first document of each, and how many there are."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(collapse(F.col("text")), 256).alias("key"))
    return docs.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("repeats"))


def top_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The three most frequent sources of rejected documents."""
    j = table(spark, d, "labels").where("quality = 0").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "source").limit(3)


def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Rate, recall and mean per source of documents that a length rule finds against the quality labels."""
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    found = F.col("n_chars") >= 500
    good = F.col("quality") == 1
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(found & good).alias("hits"), F.round(F.count_if(found & good) / F.greatest(F.count_if(good), F.lit(1)), 6).alias("recall"), F.round(F.avg(F.when(found, 1.0).otherwise(0.0)), 6).alias("survival"))


def _changed_customers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    changed = F.when(F.col("c_acctbal") < 0, F.lit("CHANGED")).otherwise(F.col("c_mktsegment"))
    shifted = F.when(F.col("c_mktsegment") == "BUILDING", -F.col("c_custkey")).otherwise(F.col("c_custkey"))
    return c.select(shifted.alias("c_custkey"), "c_name", changed.alias("c_mktsegment"))


def sync_changeset(spark: SparkSession, d: str) -> DataFrame:
    return R.change_set(table(spark, d, "customer"), _changed_customers(spark, d), "c_custkey", ["c_name", "c_mktsegment"])


def sync_counts(spark: SparkSession, d: str) -> DataFrame:
    return sync_changeset(spark, d).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def busy_by_stage(spark: SparkSession, d: str) -> DataFrame:
    """Value summed per type across parallel users, in whole thousandths."""
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.round(F.col("value") * 1000).cast("long")).alias("busy_ms"), F.countDistinct("user_id").alias("parallel"))


def run_compare(spark: SparkSession, d: str) -> DataFrame:
    """Two months side by side per type, with the difference."""
    e = table(spark, d, "events").withColumn("half", F.when(F.dayofmonth("ts") <= 15, 1).otherwise(2))
    return e.groupBy("event_type").agg(F.count_if(F.col("half") == 1).alias("before"), F.count_if(F.col("half") == 2).alias("after")).withColumn("change", F.col("after") - F.col("before"))


PRICES = {"PROMO": 300, "PROMO BRUSHED": 450, "STANDARD": 100, "STANDARD POLISHED": 150, "ECONOMY": 80}


def priced_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Cost per type by the longest matching prefix of a price list; unknown types cost the most."""
    price = F.lit(max(PRICES.values()))
    for prefix in sorted(PRICES, key=len):
        price = F.when(F.col("p_type").startswith(prefix), PRICES[prefix]).otherwise(price)
    return table(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.sum(price * F.col("p_size")).cast("long").alias("cost"))


def usage_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Each user's calls and value against limits, and the worst of the two ratios."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("value"))
    a, b = F.round(F.col("calls") / 100, 6), F.round(F.col("value") / 5000, 6)
    return e.select("user_id", "calls", a.alias("calls_ratio"), b.alias("value_ratio"), F.greatest(a, b).alias("worst"))


QUERIES = {f.__name__: f for f in (status_counts, outcome_counts, zero_filled_counts, day_counts, prefix_pivot, coverage_rollup, fold_repeats, top_reasons, eval_metrics, sync_changeset, sync_counts, busy_by_stage, run_compare, priced_by_prefix, usage_ratio)}

_CHANGED = "SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN -c_custkey ELSE c_custkey END AS k, c_name, CASE WHEN c_acctbal < 0 THEN 'CHANGED' ELSE c_mktsegment END AS seg FROM customer"
_CHANGES = f"""SELECT * FROM (SELECT coalesce(o.c_custkey, n.k) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'inserted' WHEN n.k IS NULL THEN 'deleted'
    WHEN o.c_name IS DISTINCT FROM n.c_name OR o.c_mktsegment IS DISTINCT FROM n.seg THEN 'updated' END AS change
    FROM customer o FULL OUTER JOIN ({_CHANGED}) n ON o.c_custkey = n.k) WHERE change IS NOT NULL"""

ORACLES = {
    "status_counts": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "outcome_counts": "SELECT coalesce(event_type, 'none') AS outcome, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1",
    "zero_filled_counts": "SELECT v.event_type, count(e.event_type) AS n FROM (VALUES " + ", ".join(f"('{w}')" for w in EVENT_TYPES) + ") v(event_type) LEFT JOIN events e USING (event_type) GROUP BY 1",
    "day_counts": "SELECT user_id, count(*) AS n FROM (SELECT user_id, ts, date_trunc('day', max(ts) OVER (PARTITION BY user_id)) AS d FROM events) WHERE ts >= d GROUP BY 1",
    "prefix_pivot": "SELECT split_part(o_orderpriority, '-', 1) AS bucket, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1",
    "coverage_rollup": "SELECT r_name, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS answered, count(*) FILTER (o_orderstatus = 'P') AS partial, count(*) FILTER (o_totalprice > 200000) AS wide, grouping(r_name) = 1 AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name)",
    "fold_repeats": "SELECT sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g'))) AS key, min(doc_id) AS doc_id, count(*) AS repeats FROM documents GROUP BY 1",
    "top_reasons": "SELECT source, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE quality = 0 GROUP BY 1 ORDER BY n DESC, source LIMIT 3",
    "eval_metrics": "SELECT source, count(*) AS n, count(*) FILTER (n_chars >= 500 AND quality = 1) AS hits, round(count(*) FILTER (n_chars >= 500 AND quality = 1) / greatest(count(*) FILTER (quality = 1), 1), 6) AS recall, round(avg(CASE WHEN n_chars >= 500 THEN 1.0 ELSE 0.0 END), 6) AS survival FROM labels JOIN documents USING (doc_id) GROUP BY 1",
    "sync_changeset": _CHANGES,
    "sync_counts": f"SELECT change, count(*) AS n FROM ({_CHANGES}) GROUP BY 1",
    "busy_by_stage": "SELECT event_type, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS busy_ms, count(DISTINCT user_id) AS parallel FROM events GROUP BY 1",
    "run_compare": "SELECT event_type, count(*) FILTER (day(ts) <= 15) AS before, count(*) FILTER (day(ts) > 15) AS after, count(*) FILTER (day(ts) > 15) - count(*) FILTER (day(ts) <= 15) AS change FROM events GROUP BY 1",
    "priced_by_prefix": "SELECT p_type, count(*) AS n, CAST(sum(p_size * CASE WHEN p_type LIKE 'STANDARD POLISHED%' THEN 150 WHEN p_type LIKE 'PROMO BRUSHED%' THEN 450 WHEN p_type LIKE 'STANDARD%' THEN 100 WHEN p_type LIKE 'ECONOMY%' THEN 80 WHEN p_type LIKE 'PROMO%' THEN 300 ELSE 450 END) AS BIGINT) AS cost FROM part GROUP BY 1",
    "usage_ratio": "SELECT user_id, calls, round(calls / 100, 6) AS calls_ratio, round(v / 5000, 6) AS value_ratio, greatest(round(calls / 100, 6), round(v / 5000, 6)) AS worst FROM (SELECT user_id, count(*) AS calls, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS v FROM events GROUP BY 1)",
}

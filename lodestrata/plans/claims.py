"""Claims: evidence views, re-validation, ranking keys, scores, conflicts, supersession, graph reads and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import scoring as S
from lodestrata.operators import ranking
from lodestrata.operators import relational as R
from lodestrata.sources.tables import table

AS_OF = "1997-01-01"


def evidence_view(spark: SparkSession, d: str) -> DataFrame:
    """Claim with source and, where there is one, statistic: the renamed projection, counted by source."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    s, p = table(spark, d, "supplier").select("s_suppkey", "s_name"), table(spark, d, "part").where("p_size > 10").select("p_partkey", "p_size")
    j = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    return j.groupBy(F.col("s_name").alias("source")).agg(F.count(F.lit(1)).alias("claims"), F.count("p_size").alias("statistics"))


def entity_touch_counts(spark: SparkSession, d: str) -> DataFrame:
    """Claims touching each entity, as part or as supplier, by type."""
    li = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("subject"), F.concat(F.lit("p"), F.col("l_partkey")).alias("object"))
    return R.touching(li, ["subject", "object"], "entity").groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


def revalidate_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why candidates are taken out, by the first rule that fails; kept ones as `kept`."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", "source")
    j = docs.join(table(spark, d, "labels"), "doc_id", "left")
    why = R.reason(("not_stored", F.col("n_chars") < 50), ("other_city", F.col("lang") != "en"), ("other_run", F.col("source").isin("src0", "src1")), ("status", F.col("toxic") == 1), ("no_supported_verdict", F.col("quality") == 0))
    return j.groupBy(F.coalesce(why, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def as_of_facts(spark: SparkSession, d: str) -> DataFrame:
    """Lines that had started and not ended at a date; an open end counts as going on."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_linestatus")
    end = F.when(F.col("l_linestatus") == "F", F.col("l_shipdate") + F.expr("INTERVAL 90 DAYS"))
    return li.where((F.col("l_shipdate") <= F.lit(AS_OF).cast("timestamp")) & (end.isNull() | (end > F.lit(AS_OF).cast("timestamp")))).select("l_orderkey", "l_linenumber")


def latest_per_slot(spark: SparkSession, d: str) -> DataFrame:
    """Latest order of each customer and priority; of equal dates the first id wins."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate")
    return ranking.top_k(o, ["o_custkey", "o_orderpriority"], [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey")], 1).drop("rank", "o_orderdate")


def latest_unless_tied(spark: SparkSession, d: str) -> DataFrame:
    """Latest line of each part, none where two share the latest date."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_quantity")
    days = li.groupBy("l_partkey", "l_shipdate").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("value"))
    last = days.where("l_shipdate IS NOT NULL").groupBy("l_partkey").agg(F.max_by(F.struct("n", "value"), "l_shipdate").alias("x"))
    return last.where("x.n = 1").select("l_partkey", F.col("x.value").alias("value"))


LEVELS = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}


def rank_key(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's orders by level, then newest, then id: best three."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("level", S.weighted_rank(LEVELS, F.col("o_orderpriority")))
    return ranking.top_k(j, ["c_nationkey"], [F.col("level"), F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey")], 3).select("c_nationkey", "o_orderkey", "level", "rank")


def confidence_score(spark: SparkSession, d: str) -> DataFrame:
    """Additive points of each line, the label, and the cap for unverified ones."""
    q, r = F.col("l_quantity"), F.col("l_returnflag")
    points = F.when(q >= 40, 3).when(q >= 20, 2).otherwise(0) + F.when(F.col("l_discount") <= 0.02, 2).otherwise(0) + F.when(r == "N", 2).when(r == "A", 1).otherwise(0) + F.when(F.col("l_tax") <= 0.03, 1).otherwise(0)
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", points.alias("points"), F.col("l_linestatus"))
    return li.select("l_orderkey", "l_linenumber", "points", S.confidence(F.col("points"), F.col("l_linestatus") == "O", S.ScoreParams()).alias("label"))


def badges(spark: SparkSession, d: str) -> DataFrame:
    """Main badge by severity and the others in order."""
    o = table(spark, d, "orders")
    rules = [("contested", F.col("o_orderstatus") == "P"), ("outdated", F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp")), ("wider_area", F.col("o_totalprice") > 250000), ("single_source", F.col("o_orderpriority") == "5-LOW")]
    return o.select("o_orderkey", S.main_badge(*rules).alias("main"), S.other_badges(*rules).alias("others"))


def slot_status(spark: SparkSession, d: str) -> DataFrame:
    """Status of each customer: answered, answered wider, blocked or unreachable (no order)."""
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    n = o.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("full"), F.count_if(F.col("o_orderstatus") == "P").alias("part"))
    j = c.join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.when(F.col("full") > 0, "answered").when(F.col("part") > 0, "answered_wider_geo").when(F.col("o_custkey").isNotNull(), "blocked").otherwise("unreachable").alias("status"))


def all_pairs_conflict(spark: SparkSession, d: str) -> DataFrame:
    """Lines of one order with equal comparability key (status and flag), overlapping 30-day periods and different quantities."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linestatus", "l_returnflag", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("claim"), "l_quantity", F.col("l_shipdate").alias("start"), (F.col("l_shipdate") + F.expr("INTERVAL 30 DAYS")).alias("end"))
    pairs = R.overlapping_pairs(li, ["l_orderkey", "l_linestatus", "l_returnflag"], "claim", "start", "end", ["l_quantity"])
    return pairs.where(F.abs(F.col("a_l_quantity") - F.col("b_l_quantity")) > 5).select(F.col("a_l_orderkey").alias("run"), F.col("a_claim").alias("claim_a"), F.col("b_claim").alias("claim_b"))


def comparability_key(spark: SparkSession, d: str) -> DataFrame:
    """Pipe-joined key of the parts, null with the missing parts named where one is empty."""
    p = table(spark, d, "part")
    parts = {"brand": F.nullif(F.col("p_brand"), F.lit("Brand#11")), "type": F.col("p_type"), "size": F.when(F.col("p_size") > 3, F.col("p_size").cast("string"))}
    missing = F.array_join(F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in parts.items()])), ",")
    key = F.when(missing == "", F.concat_ws("|", *parts.values()))
    return p.select("p_partkey", key.alias("key"), missing.alias("missing"))


def supersede_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each order's validity ends when the customer's next one starts."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(w).alias("valid_to"))


def latest_observation(spark: SparkSession, d: str) -> DataFrame:
    """Register of each supplier's newest known flag; `R` is unknown and never overrides."""
    li = table(spark, d, "lineitem").where("l_returnflag <> 'R'")
    order = F.struct("l_shipdate", -F.col("l_orderkey"), -F.col("l_linenumber"))
    return li.groupBy("l_suppkey").agg(F.max_by("l_returnflag", order).alias("flag"), F.max("l_shipdate").alias("since"))


def narrower_rows(spark: SparkSession, d: str) -> DataFrame:
    """Wide (over 200,000) orders leave where the customer has a narrower one."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    narrow = o.where("o_totalprice <= 200000")
    return narrow.union(o.where("o_totalprice > 200000 OR o_totalprice IS NULL").join(narrow.select("o_custkey").distinct(), "o_custkey", "left_anti")).select("o_custkey", "o_orderkey")


def facet_with_partners(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one language that are toxic, and all with the same text: both sides travel together."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("h"))
    hit = docs.join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id").where("lang = 'en'")
    return docs.join(hit.select("h").distinct(), "h", "left_semi").select("doc_id", "source")


def one_hop(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers one hop from each part, with the claims behind the edge and the newest."""
    li = table(spark, d, "lineitem")
    return li.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("claims"), F.max("l_shipdate").alias("valid_at"))


def rivals(spark: SparkSession, d: str) -> DataFrame:
    """Parts with more than one supplier in the same order status, with the number of rivals."""
    li = table(spark, d, "lineitem").groupBy("l_partkey", "l_linestatus").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.count(F.lit(1)).alias("n"))
    return li.where("suppliers > 1")


def city_latest_runs(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their latest order, newest first, customers without one last: a page of 40."""
    last = ranking.latest_by(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return c.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc_nulls_last(), "c_custkey").limit(40).select("c_custkey", "c_name", "o_orderkey")


def source_slots(spark: SparkSession, d: str) -> DataFrame:
    """Distinct statuses of each supplier's lines, ordered and joined."""
    li = table(spark, d, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("slot"))
    return li.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("slot")), ",").alias("slots"))


def brief(spark: SparkSession, d: str) -> DataFrame:
    """Per region the three dearest finished orders, and the region's count: the headline of a report."""
    o, c = table(spark, d, "orders").where("o_orderstatus = 'F'"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "o_orderkey", "o_totalprice")
    counts = j.groupBy("r_name").agg(F.count(F.lit(1)).alias("facts"))
    return ranking.top_k(j, ["r_name"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).join(counts, "r_name").select("r_name", "o_orderkey", "rank", "facts")


def invariants(spark: SparkSession, d: str) -> DataFrame:
    """Rows that break a row rule or a reference, by rule; every rule has its row."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey")
    bad = li.agg(F.count_if(F.col("l_quantity") <= 0).alias("quantity"), F.count_if(~F.col("l_discount").between(0, 1)).alias("discount"), F.count_if(F.col("l_shipdate").isNull()).alias("undated"))
    orphan = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("orphan").alias("rule"), "n")
    return bad.select(F.expr("stack(3, 'quantity', quantity, 'discount', discount, 'undated', undated) AS (rule, n)")).union(orphan)


QUERIES = {f.__name__: f for f in (evidence_view, entity_touch_counts, revalidate_reasons, as_of_facts, latest_per_slot, latest_unless_tied, rank_key, confidence_score, badges, slot_status, all_pairs_conflict, comparability_key, supersede_edges, latest_observation, narrower_rows, facet_with_partners, one_hop, rivals, city_latest_runs, source_slots, brief, invariants)}

_POINTS = "CASE WHEN l_quantity >= 40 THEN 3 WHEN l_quantity >= 20 THEN 2 ELSE 0 END + CASE WHEN l_discount <= 0.02 THEN 2 ELSE 0 END + CASE l_returnflag WHEN 'N' THEN 2 WHEN 'A' THEN 1 ELSE 0 END + CASE WHEN l_tax <= 0.03 THEN 1 ELSE 0 END"
_LEVEL = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 ELSE 5 END"
_LI = "SELECT *, l_partkey * 10 + l_linenumber AS claim FROM lineitem"

ORACLES = {
    "evidence_view": "SELECT s_name AS source, count(*) AS claims, count(p_size) AS statistics FROM lineitem JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10 GROUP BY 1",
    "entity_touch_counts": "SELECT entity, count(*) AS n FROM (SELECT 's' || l_suppkey AS entity FROM lineitem UNION ALL SELECT 'p' || l_partkey FROM lineitem) GROUP BY 1",
    "revalidate_reasons": "SELECT CASE WHEN n_chars < 50 THEN 'not_stored' WHEN lang <> 'en' THEN 'other_city' WHEN source IN ('src0', 'src1') THEN 'other_run' WHEN toxic = 1 THEN 'status' WHEN quality = 0 THEN 'no_supported_verdict' ELSE 'kept' END AS reason, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "as_of_facts": f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate <= TIMESTAMP '{AS_OF}' AND (l_linestatus <> 'F' OR l_shipdate + INTERVAL 90 DAY > TIMESTAMP '{AS_OF}')",
    "latest_per_slot": "SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS rn FROM orders) WHERE rn = 1",
    "latest_unless_tied": "SELECT l_partkey, max(l_quantity) AS value FROM (SELECT *, max(l_shipdate) OVER (PARTITION BY l_partkey) AS m FROM lineitem) WHERE l_shipdate = m GROUP BY 1 HAVING count(*) = 1",
    "rank_key": f"SELECT c_nationkey, o_orderkey, level, CAST(rk AS INT) AS rank FROM (SELECT c_nationkey, o_orderkey, {_LEVEL} AS level, row_number() OVER (PARTITION BY c_nationkey ORDER BY {_LEVEL}, o_orderdate DESC NULLS LAST, o_orderkey) AS rk FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rk <= 3",
    "confidence_score": f"SELECT l_orderkey, l_linenumber, p AS points, CASE WHEN p >= 7 AND l_linestatus = 'O' THEN 'Medium' WHEN p >= 7 THEN 'High' WHEN p >= 4 THEN 'Medium' ELSE 'Low' END AS label FROM (SELECT *, {_POINTS} AS p FROM lineitem)",
    "badges": """SELECT o_orderkey, b[1] AS main, array_to_string(b[2:], ',') AS others FROM (SELECT o_orderkey, list_filter([CASE WHEN o_orderstatus = 'P' THEN 'contested' END, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'outdated' END,
        CASE WHEN o_totalprice > 250000 THEN 'wider_area' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'single_source' END], lambda x: x IS NOT NULL) AS b FROM orders)""",
    "slot_status": "SELECT c_custkey, CASE WHEN f > 0 THEN 'answered' WHEN p > 0 THEN 'answered_wider_geo' WHEN n > 0 THEN 'blocked' ELSE 'unreachable' END AS status FROM (SELECT c_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'P') AS p, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)",
    "all_pairs_conflict": f"""SELECT a.l_orderkey AS run, a.claim AS claim_a, b.claim AS claim_b FROM ({_LI}) a JOIN ({_LI}) b ON a.l_orderkey = b.l_orderkey AND a.l_linestatus = b.l_linestatus AND a.l_returnflag = b.l_returnflag AND a.claim < b.claim
        WHERE a.l_shipdate < b.l_shipdate + INTERVAL 30 DAY AND b.l_shipdate < a.l_shipdate + INTERVAL 30 DAY AND abs(a.l_quantity - b.l_quantity) > 5""",
    "comparability_key": "SELECT p_partkey, CASE WHEN m = '' THEN concat_ws('|', p_brand, p_type, p_size) END AS key, m AS missing FROM (SELECT *, concat_ws(',', CASE WHEN p_brand = 'Brand#11' THEN 'brand' END, CASE WHEN p_size <= 3 THEN 'size' END) AS m FROM part)",
    "supersede_edges": "SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders",
    "latest_observation": "SELECT l_suppkey, l_returnflag AS flag, l_shipdate AS since FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS rn FROM lineitem WHERE l_returnflag <> 'R') WHERE rn = 1",
    "narrower_rows": "SELECT o_custkey, o_orderkey FROM orders o WHERE o_totalprice <= 200000 OR NOT EXISTS (SELECT 1 FROM orders n WHERE n.o_custkey = o.o_custkey AND n.o_totalprice <= 200000)",
    "facet_with_partners": "SELECT doc_id, source FROM documents WHERE text IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND lang = 'en')",
    "one_hop": "SELECT l_partkey, l_suppkey, count(*) AS claims, max(l_shipdate) AS valid_at FROM lineitem GROUP BY 1, 2",
    "rivals": "SELECT l_partkey, l_linestatus, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1",
    "city_latest_runs": "SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) ON o_custkey = c_custkey AND rn = 1 ORDER BY o_orderdate DESC NULLS LAST, c_custkey LIMIT 40",
    "source_slots": "SELECT l_suppkey, string_agg(s, ',' ORDER BY s) AS slots FROM (SELECT DISTINCT l_suppkey, l_returnflag || l_linestatus AS s FROM lineitem) GROUP BY 1",
    "brief": "SELECT r_name, o_orderkey, CAST(rk AS INT) AS rank, facts FROM (SELECT r_name, o_orderkey, row_number() OVER (PARTITION BY r_name ORDER BY o_totalprice DESC, o_orderkey) AS rk, count(*) OVER (PARTITION BY r_name) AS facts FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F') WHERE rk <= 3",
    "invariants": "SELECT 'quantity' AS rule, count(*) FILTER (l_quantity <= 0) AS n FROM lineitem UNION ALL SELECT 'discount', count(*) FILTER (NOT l_discount BETWEEN 0 AND 1) FROM lineitem UNION ALL SELECT 'undated', count(*) FILTER (l_shipdate IS NULL) FROM lineitem UNION ALL SELECT 'orphan', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
}

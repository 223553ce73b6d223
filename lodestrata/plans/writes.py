"""Idempotent writes, publication pointers, answers' checks and pairs that travel together."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators import steps
from lodestrata.operators import writes as W
from lodestrata.sources import versions
from lodestrata.sources.claims import CLAIM_SQL, claims
from lodestrata.sources.tables import table


def first_write_wins(spark: SparkSession, d: str) -> DataFrame:
    """Events, delivered twice, to append to a store that has the purchases: the others, each once."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return W.first_write_wins(e.where("event_type = 'purchase'"), e.union(e), "event_id", [F.col("user_id")])


def last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return W.last_write_wins(c.drop("c_acctbal"), c.where("c_acctbal < 0").select("c_custkey", F.lower("c_mktsegment").alias("c_mktsegment")), "c_custkey")


def cascade_dry_run(spark: SparkSession, d: str) -> DataFrame:
    """Rows that deleting nation 3's customers would remove."""
    parents = table(spark, d, "customer").where("c_nationkey = 3").select("c_custkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    mine = orders.join(parents, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    lines = table(spark, d, "lineitem").select("l_orderkey").join(mine, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    own = W.cascade_counts(parents, "c_custkey", {"orders": (orders, "o_custkey")})
    return lines.agg(F.count(F.lit(1)).alias("n")).select(F.lit("lineitem").alias("name"), "n").union(own)


def published_runs(spark: SparkSession, d: str) -> DataFrame:
    """Latest run that ended well for each customer: an open or partial one never moves the pointer."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.struct("o_orderdate", "o_orderkey"))).alias("published"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


def tenant_list(spark: SparkSession, d: str) -> DataFrame:
    """Customers with the number of their runs and of active ones, zero where there are none."""
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("o_orderstatus") == "O").alias("active"))
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("runs", F.lit(0).cast("long")).alias("runs"), F.coalesce("active", F.lit(0).cast("long")).alias("active"))


def contested_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring orders of a customer of unlike status and like price, as unordered pairs with the dearer as headline."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", F.lead("o_orderkey").over(w).alias("k"), F.lead("o_orderstatus").over(w).alias("s"), F.lead("o_totalprice").over(w).alias("p"))
    a, b = W.unordered_pair(F.col("o_orderkey"), F.col("k"))
    return o.where((F.col("s") != F.col("o_orderstatus")) & (F.abs(F.col("p") - F.col("o_totalprice")) < 20000)).select(a.alias("a"), b.alias("b"), F.when(F.col("p") > F.col("o_totalprice"), F.col("k")).otherwise(F.col("o_orderkey")).alias("headline"))


def bundle_with_partners(spark: SparkSession, d: str) -> DataFrame:
    """The 50 dearest orders, and the partner of each that is contested."""
    top = table(spark, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(50).select(F.col("o_orderkey").alias("item"))
    pairs = contested_pairs(spark, d)
    both = pairs.select(F.col("a").alias("item"), F.col("b").alias("partner")).union(pairs.select("b", "a"))
    partners = both.join(F.broadcast(top), "item", "left_semi").select(F.col("partner").alias("item"))
    return top.union(partners).distinct()


def answer_postcheck(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of assistants' turns: kept, too long, or said before in the conversation; with the share that stays."""
    t = table(spark, d, "conversations").where("role = 'assistant'")
    s = t.select("conv_id", "turn", F.posexplode(F.split("text", r"\. +")).alias("no", "sentence")).where("sentence <> ''")
    w = Window.partitionBy("conv_id", "sentence").orderBy("turn", "no")
    s = s.withColumn("repeat", F.row_number().over(w) > 1)
    fate = F.when(F.col("repeat"), "repeat").when(F.length("sentence") > 200, "long").otherwise("kept")
    n = s.withColumn("fate", fate).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("fate") == "kept").alias("kept"), F.count_if(F.col("fate") == "repeat").alias("repeats"))
    return n.withColumn("survival", F.round(F.col("kept") / F.col("n"), 6))


WANTED = [17, 3, 1999, 42, 8, 100]


def in_given_order(spark: SparkSession, d: str) -> DataFrame:
    return W.in_given_order(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", WANTED)


KEYS = ["steel", "brass", "blue", "large", "red"]


def overlap_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Parts with any of the keys among the words of their name, the 20 dearest."""
    words = F.split(F.lower("p_name"), "[^a-z0-9]+")
    return table(spark, d, "part").where(F.arrays_overlap(words, F.array(*map(F.lit, KEYS)))).orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(20).select("p_partkey")


def committed_versions(spark: SparkSession, d: str) -> DataFrame:
    """Claims, statistics and relations of two runs' worth of writes, each committed as one version over three tables; counted by version.

    The first commit inserts every claim of even runs with its statistic or relation; the second adds the odd runs' claims,
    and drops the relations that are contested, in the same version.
    """
    c = steps.kept(claims(spark, d, "claim_id", "run_id", "kind", "status", "hundredths", "unit", "relation", "subject", "object"))
    store = f"{steps.shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    parts = lambda x: {"claim": x.select("claim_id", "run_id", "status"), "statistic": x.where("kind = 'statistic'").select("claim_id", "hundredths", "unit"), "relation": x.where("kind = 'relation'").select("claim_id", "relation", "subject", "object")}
    one = versions.commit(spark, store, parts(c.where("run_id % 2 = 0")), 0)
    new, held = parts(c.where("run_id % 2 = 1")), {t: versions.read(spark, store, t, one) for t in ("claim", "statistic", "relation")}
    both = {t: held[t].union(new[t]) for t in held}
    contested = both["claim"].where("status = 'contested'").select("claim_id")
    both["relation"] = both["relation"].join(contested, "claim_id", "left_anti")
    two = versions.commit(spark, store, both, one)
    counts = [versions.read(spark, store, t, v).select(F.lit(v).alias("version"), F.lit(t).alias("name"), "claim_id") for v in (one, two) for t in held]
    return reduce(DataFrame.union, counts).groupBy("version", "name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("claim_id") % 1000).alias("ids"))


QUERIES = {f.__name__: f for f in (first_write_wins, last_write_wins, cascade_dry_run, published_runs, tenant_list, contested_pairs, bundle_with_partners, answer_postcheck, in_given_order, overlap_lookup, committed_versions)}

_PAIRS = """SELECT least(o_orderkey, k) AS a, greatest(o_orderkey, k) AS b, CASE WHEN p > o_totalprice THEN k ELSE o_orderkey END AS headline FROM
    (SELECT *, lead(o_orderkey) OVER w AS k, lead(o_orderstatus) OVER w AS s, lead(o_totalprice) OVER w AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE s <> o_orderstatus AND abs(p - o_totalprice) < 20000"""

ORACLES = {
    "committed_versions": f"""WITH {CLAIM_SQL}, v AS (SELECT 1 AS version UNION ALL SELECT 2), t AS (SELECT version, claim.* FROM v, claim WHERE version = 2 OR run_id % 2 = 0),
        n AS (SELECT version, 'claim' AS name, claim_id FROM t UNION ALL SELECT version, kind, claim_id FROM t WHERE kind = 'statistic' OR (kind = 'relation' AND (version = 1 OR status <> 'contested')))
        SELECT version, name, count(*) AS n, sum(claim_id % 1000)::BIGINT AS ids FROM n GROUP BY ALL""",
    "first_write_wins": "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'purchase'",
    "last_write_wins": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "cascade_dry_run": """WITH p AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM p))
        SELECT 'lineitem' AS name, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT * FROM o) UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'parents', count(*) FROM p""",
    "published_runs": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F') AS published, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders GROUP BY 1",
    "tenant_list": "SELECT c_custkey, count(o_orderkey) AS runs, count(*) FILTER (o_orderstatus = 'O') AS active FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "contested_pairs": _PAIRS,
    "bundle_with_partners": f"""WITH t AS (SELECT o_orderkey AS item FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50), p AS ({_PAIRS})
        SELECT item FROM t UNION SELECT b FROM p WHERE a IN (SELECT item FROM t) UNION SELECT a FROM p WHERE b IN (SELECT item FROM t)""",
    "answer_postcheck": """WITH s AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\\. +')) AS sentence, generate_subscripts(regexp_split_to_array(text, '\\. +'), 1) AS no FROM conversations WHERE role = 'assistant'),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, sentence ORDER BY turn, no) > 1 AS rep FROM s WHERE sentence <> '')
        SELECT conv_id, count(*) AS n, count(*) FILTER (NOT rep AND length(sentence) <= 200) AS kept, count(*) FILTER (rep) AS repeats, round(count(*) FILTER (NOT rep AND length(sentence) <= 200) / count(*), 6) AS survival FROM r GROUP BY 1""",
    "in_given_order": "SELECT p_partkey, p_name, CAST(list_position([" + ", ".join(map(str, WANTED)) + "], p_partkey) - 1 AS INT) AS place FROM part WHERE p_partkey IN (" + ", ".join(map(str, WANTED)) + ")",
    "overlap_lookup": f"SELECT p_partkey FROM part WHERE list_has_any(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), {KEYS}) ORDER BY p_retailprice DESC, p_partkey LIMIT 20",
}

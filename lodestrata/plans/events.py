"""The event log: gap-free sequences, limits, budgets, lifecycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators.sequencing import running
from lodestrata.sources.tables import table
from lodestrata.streaming import runs


def gapfree_seq(spark: SparkSession, d: str) -> DataFrame:
    """Sequence without gaps per user; a repeated event keeps its first place, so it is numbered once."""
    e = table(spark, d, "events").groupBy("user_id", "event_type", "ts", "props").agg(F.min("event_id").alias("event_id"))
    seq = running(e, ["user_id"], F.to_date("ts"), [F.col("ts"), F.col("event_id")], F.lit(1), "seq")
    return seq.select("user_id", "event_id", F.col("seq").cast("int").alias("seq"))


def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    """Events in the hour up to each one; exactly an hour old is expired. Refused beyond 3."""
    in_hour = "count(1) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '00:59:59.999999' HOUR TO SECOND PRECEDING AND CURRENT ROW)"
    return table(spark, d, "events").select("event_id", F.expr(in_hour).alias("n")).withColumn("refused", F.col("n") > 3)


def budget_first_crossing(spark: SparkSession, d: str) -> DataFrame:
    """The event with which each user's running value passes 85 % of a limit."""
    spent = running(table(spark, d, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], F.to_date("ts"), [F.col("ts"), F.col("event_id")], F.col("value").cast("decimal(18,4)"), "used").where(F.col("used") >= F.lit("850").cast("decimal(18,4)"))
    return spent.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("x")).select("user_id", F.col("x.event_id").alias("event_id"))


def stale_runs(spark: SparkSession, d: str) -> DataFrame:
    """Users whose last event is over a day before the newest of all."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    newest = last.agg(F.max("last").alias("newest"))
    return last.join(F.broadcast(newest)).where(F.col("last") < F.col("newest") - F.expr("INTERVAL 1 DAY")).select("user_id", "last")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of events of a user with gaps under four hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = F.col("ts") <= F.lag("ts").over(w) + F.expr("INTERVAL 4 HOURS")
    e = table(spark, d, "events").withColumn("new", F.when(near, 0).otherwise(1))
    e = e.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def single_flight(spark: SparkSession, d: str) -> DataFrame:
    """First event of each user and type on a day does the work, the rest reuse it."""
    w = Window.partitionBy("user_id", "event_type", F.to_date("ts")).orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("first", F.row_number().over(w) == 1)
    return e.groupBy("event_type").agg(F.count_if("first").alias("fetched"), F.count_if(~F.col("first")).alias("reused"))


def turn_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Conversations whose turns aren't numbered without gaps from the first, or repeat one."""
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("turn").alias("different"), (F.max("turn") - F.min("turn") + 1).alias("span"))
    return t.select("conv_id", "n", (F.col("different") == F.col("n")).alias("unique"), (F.col("span") == F.col("different")).alias("whole"))


def replay_after(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events after the tenth, up to twenty."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("seq", F.row_number().over(w)).where("seq > 10 AND seq <= 30").select("user_id", "seq", "event_id", "event_type")


def payload_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the JSON payload with how often each occurs."""
    keys = table(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


#: Seconds without a sign of life after which a lease may be taken over.
STALE_S = 6 * 3600


def lease_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of every claim, heartbeat and finish of every user's run, whose owners are three workers."""
    kind = F.when(F.col("event_id") % 31 == 0, "finish").when(F.col("event_type").isin("click", "error"), "claim").otherwise("heartbeat")
    e = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.concat(F.lit("w"), F.col("event_id") % 3).alias("owner"), kind.alias("kind"))
    return runs.leases(e, STALE_S).select("run", "id", "owner", "outcome")


#: Limits of a user's counters: events, value in hundredths; the share at which one warning comes.
LIMITS, WARN = {"calls": 60, "cost": 120_000}, 0.85


def budget_crossings(spark: SparkSession, d: str) -> DataFrame:
    """The event with which each user's counter first reaches its warning share, and its limit.

    Counters run on in slices of a day, so a user with very many events isn't one window.
    """
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.lit(1).cast("long").alias("calls"), F.round(F.col("value") * 100).cast("long").alias("cost"))
    order = [F.col("ts"), F.col("event_id")]
    parts = []
    for counter, limit in LIMITS.items():
        used = running(e, ["user_id"], F.to_date("ts"), order, F.col(counter), "used")
        for what, bound in (("warning", WARN * limit), ("refused", float(limit))):
            first = used.where(F.col("used") >= bound).groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "used")).alias("x"))
            parts.append(first.select("user_id", F.lit(counter).alias("counter"), F.lit(what).alias("what"), "x.event_id", "x.used"))
    return reduce(DataFrame.union, parts)


QUERIES = {f.__name__: f for f in (gapfree_seq, rate_limit_window, budget_first_crossing, stale_runs, sessions, single_flight, turn_numbers, replay_after, payload_reasons, lease_outcomes, budget_crossings)}

_KIND = "CASE WHEN event_id % 31 = 0 THEN 'finish' WHEN event_type IN ('click', 'error') THEN 'claim' ELSE 'heartbeat' END"
_CROSSED = " UNION ALL ".join(f"SELECT user_id, '{c}' AS counter, '{w}' AS what, arg_min(event_id, (ts, event_id)) AS event_id, arg_min({c}, (ts, event_id)) AS used FROM u WHERE {c} >= {b} GROUP BY ALL" for c, limit in LIMITS.items() for w, b in (("warning", WARN * limit), ("refused", limit)))

ORACLES = {
    "lease_outcomes": f"""WITH RECURSIVE e AS (SELECT user_id AS run, event_id AS id, epoch_us(ts) AS t, 'w' || event_id % 3 AS owner, {_KIND} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        s AS (SELECT run, 0::BIGINT AS n, NULL::BIGINT AS id, ''::VARCHAR AS who, ''::VARCHAR AS holder, 0::BIGINT AS beat, false AS over, ''::VARCHAR AS outcome FROM e GROUP BY run
          UNION ALL
          SELECT run, n, id, owner, CASE WHEN outcome IN ('granted', 'taken over') THEN owner ELSE holder END, CASE WHEN outcome IN ('granted', 'taken over', 'renewed', 'finished') THEN t ELSE beat END, over OR outcome = 'finished', outcome
          FROM (SELECT s.run, e.n, e.id, e.owner, s.holder, s.beat, s.over, e.t, CASE WHEN s.over THEN 'over' WHEN s.holder = e.owner THEN CASE WHEN e.kind = 'finish' THEN 'finished' ELSE 'renewed' END
              WHEN e.kind <> 'claim' THEN 'refused' WHEN s.holder = '' THEN 'granted' WHEN e.t - s.beat > {STALE_S * 1_000_000}::BIGINT THEN 'taken over' ELSE 'refused' END AS outcome
            FROM s JOIN e ON e.run = s.run AND e.n = s.n + 1))
        SELECT run, id, who AS owner, outcome FROM s WHERE n > 0""",
    "budget_crossings": f"WITH u AS (SELECT user_id, event_id, ts, (count(*) OVER w)::BIGINT AS calls, (sum(CAST(round(value * 100) AS BIGINT)) OVER w)::BIGINT AS cost FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) {_CROSSED}",
    "gapfree_seq": "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq FROM (SELECT user_id, event_type, ts, props, min(event_id) AS event_id FROM events GROUP BY ALL)",
    "rate_limit_window": "SELECT event_id, n, n > 3 AS refused FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM events)",
    "budget_first_crossing": "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM (SELECT user_id, event_id, ts, sum(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM events) WHERE used >= 850 GROUP BY 1",
    "stale_runs": "SELECT user_id, max(ts) AS last FROM events GROUP BY 1 HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 DAY",
    "sessions": """SELECT user_id, CAST(s AS BIGINT) AS session, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
        (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 14400000000 THEN 1 ELSE 0 END AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY 1, 2""",
    "single_flight": "SELECT event_type, count(*) FILTER (rn = 1) AS fetched, count(*) FILTER (rn > 1) AS reused FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events) GROUP BY 1",
    "turn_numbers": "SELECT conv_id, count(*) AS n, count(DISTINCT turn) = count(*) AS \"unique\", max(turn) - min(turn) + 1 = count(DISTINCT turn) AS whole FROM conversations GROUP BY 1",
    "replay_after": "SELECT user_id, CAST(seq AS INT) AS seq, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) WHERE seq > 10 AND seq <= 30",
    "payload_reasons": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1",
}

"""Claims judged whole: effective level, rank key, badges, confidence, slot status, comparability, succession."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import judging as J
from lodestrata.functions import scoring as S
from lodestrata.operators import intervals, ranking, steps
from lodestrata.sources.claims import CLAIM_SQL, claims
from lodestrata.sources.tables import table

POLICY = J.Policy()
TODAY = "2002-02-28"
_LEVEL = ("level", "fit", "fit_level")
_KEYED = (*_LEVEL, "publisher", "sampling", "ref_end", "claim_id")


def _today():
    return F.lit(TODAY).cast("date")


def effective_levels(spark: SparkSession, d: str) -> DataFrame:
    """How many claims of each level and fit count as which level."""
    return claims(spark, d, *_LEVEL).groupBy("level", "fit", J.own_level().alias("effective")).agg(F.count(F.lit(1)).alias("n"))


def ranked_claims(spark: SparkSession, d: str) -> DataFrame:
    """The two best claims of each city and slot by the whole rank key, as they go to verification."""
    c = claims(spark, d, "city_id", "slot", *_KEYED).where("slot < 8")
    return ranking.top_k(c, ["city_id", "slot"], J.rank_key(POLICY), 2).select("city_id", "slot", "claim_id", J.geography_distance(J.own_level(), POLICY.accepted).cast("int").alias("distance"), "rank")


def claim_badges(spark: SparkSession, d: str) -> DataFrame:
    """Main badge and the others, most severe first, of every claim."""
    held = J.badges(_today(), POLICY)
    return claims(spark, d).select("claim_id", S.main_badge(*held).alias("main"), S.other_badges(*held).alias("others"))


def claim_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Points, label and the reasons of every claim that may be shown."""
    c = claims(spark, d).where("status IN ('supported', 'contested')").withColumn("points", J.points(_today(), POLICY))
    reasons = F.array_join(F.array(*[F.concat(F.lit(name + "="), p.cast("string")) for name, p in J.score_parts(_today(), POLICY)]), ";")
    return c.select("claim_id", "points", J.label(F.col("points"), POLICY).alias("label"), reasons.alias("reasons"))


def fact_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards of facts: badge, confidence and the period as it is shown."""
    c = claims(spark, d).where("status IN ('supported', 'contested')").withColumn("points", J.points(_today(), POLICY))
    period = F.when(F.col("proxy"), F.concat(F.lit("published "), F.date_format("ref_end", "yyyy"))).otherwise(F.concat_ws(" to ", F.date_format("ref_start", "yyyy-MM"), F.date_format("ref_end", "yyyy-MM")))
    cards = c.select("city_id", S.main_badge(*J.badges(_today(), POLICY)).alias("main"), J.label(F.col("points"), POLICY).alias("label"), F.coalesce(period, F.lit("")).alias("period"))
    return cards.groupBy("main", "label", "period").agg(F.count(F.lit(1)).alias("n"))


def slot_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Status of every (city, slot) that was searched, its flags, and whether another round may help.

    A statistic slot (even number) is answered only by statistics, another only by what is none.
    """
    c = claims(spark, d, "city_id", "slot", "kind", "status", *_LEVEL)
    shown = F.col("status").isin("supported", "contested")
    answers = shown & ((F.col("slot") % 2 == 0) == (F.col("kind") == "statistic"))
    c = c.groupBy("city_id", "slot").agg(
        F.coalesce(F.bool_or(answers & J.own_level().isin(*POLICY.accepted)), F.lit(False)).alias("in_city"), F.coalesce(F.bool_or(shown), F.lit(False)).alias("any_shown"), F.bool_or(F.col("status") == "contested").alias("conflicting")
    )
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("city_id"), (F.col("o_orderkey") % 16).cast("int").alias("slot"), "o_orderstatus", "o_orderpriority")
    crawled = o.groupBy("city_id", "slot").agg(F.count_if(F.col("o_orderstatus") == "F").alias("fetched"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("blocked"))
    j = crawled.join(c, ["city_id", "slot"], "left")
    status = F.when(F.col("in_city"), "answered").when(F.col("any_shown"), "answered_wider_geo").when((F.col("fetched") == 0) & F.col("blocked"), "blocked").when(F.col("fetched") == 0, "unreachable").otherwise("answered_negative")
    j = j.withColumn("slot_status", status)
    return j.select("city_id", "slot", "slot_status", F.coalesce("conflicting", F.lit(False)).alias("conflicting"), F.col("slot_status").isin("answered_negative", "blocked", "unreachable").alias("retry"))


def coverage_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each (city, slot) with its three best claims in order and the note where there is none in the city."""
    c = claims(spark, d, "city_id", "slot", "status", *_KEYED).where("status <> 'insufficient'")
    best = ranking.top_k(c, ["city_id", "slot"], J.rank_key(POLICY), 3).withColumn("near", J.geography_distance(J.own_level(), POLICY.accepted) == 0)
    found = best.groupBy("city_id", "slot").agg(F.array_sort(F.collect_list(F.struct("rank", "claim_id"))).alias("x"), F.count_if("near").alias("near"))
    return found.select("city_id", "slot", F.array_join(F.transform("x", lambda s: s["claim_id"].cast("string")), ",").alias("best"), F.when(F.col("near") == 0, "Only figures for a wider area were found.").alias("note"))


def replan_slots(spark: SparkSession, d: str) -> DataFrame:
    """Slots of each city that get another round: in a given order, then by number, as many as the searches left allow."""
    priority = [11, 4, 8]
    s = slot_statuses(spark, d).where("retry").select("city_id", "slot")
    given = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("slot"))
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("city_id"), F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 2500).cast("int").alias("capacity"))
    w = Window.partitionBy("city_id").orderBy(F.when(given == 0, 99).otherwise(given), "slot")
    return s.withColumn("place", F.row_number().over(w)).join(left, "city_id").where("place <= capacity").select("city_id", "slot", "place")


def comparability_keys(spark: SparkSession, d: str) -> DataFrame:
    """Figures of each comparability key; what has none, by its reasons."""
    c = claims(spark, d, "kind", "hundredths", *J.KEY_PARTS).where("kind = 'statistic'")
    return c.groupBy(J.comparability_key().alias("key"), F.array_join(J.key_gaps(), "; ").alias("gaps")).agg(F.count(F.lit(1)).alias("n"))


def key_differences(spark: SparkSession, d: str) -> DataFrame:
    """What separates each figure from the one before it of the same source, counted."""
    c = claims(spark, d, "claim_id", "source_id", "kind", "hundredths", *J.KEY_PARTS).where("kind = 'statistic'")
    me = F.struct(*J.KEY_PARTS)
    pairs = c.select(me.alias("a"), F.lag(me).over(Window.partitionBy("source_id").orderBy("claim_id")).alias("b")).where("b IS NOT NULL")
    return pairs.groupBy(F.array_join(J.differing_parts("a", "b"), ", ").alias("parts")).agg(F.count(F.lit(1)).alias("n"))


def _decided(c: DataFrame, scope: list[str]) -> DataFrame:
    """claim_id and not_comparable, novel, agrees or conflicts of each figure against those of its key in its scope.

    A sweep, not a join: the least and the most figure among those whose period overlaps say whether any differs too
    much; where none does and there are others, it agrees with all of them.
    """
    keyed = c.withColumn("key", J.comparability_key())
    cut = keyed.where("key IS NOT NULL").withColumn("begins", F.when(~F.col("proxy"), F.coalesce("ref_start", "ref_end"))).withColumn("ends", F.when(~F.col("proxy"), F.coalesce("ref_end", "ref_start")))
    rows = cut.select(*scope, "key", "claim_id", "begins", "ends", "hundredths", "unit")
    if scope:
        # In a scope most figures are alone with their key, and novel without a sweep: they never leave the count.
        meet = rows.groupBy(*scope, "key").agg(F.min("claim_id").alias("first_id"), F.max("claim_id").alias("last_id")).where("first_id < last_id")
        rows = steps.kept(rows.join(steps.counted(meet.select(*scope, "key")), [*scope, "key"], "left_semi"))
    swept = intervals.extremes_of_overlapping(rows, [*scope, "key"], "begins", "ends", "hundredths", "claim_id")
    low, high = J.agreeing_values(F.col("hundredths"), F.col("unit") == "percent", POLICY)
    # Bounds of a share are doubles: a hair of room, as whole hundredths are compared.
    differs = (F.col("least") < low - 1e-6) | (F.col("most") > high + 1e-6)
    agrees = F.coalesce(F.col("first_id") < F.col("last_id"), F.lit(False))
    outcome = F.when(differs, "conflicts").when(agrees, "agrees").otherwise("novel")
    told = swept.select("claim_id", outcome.alias("outcome"))
    if scope:
        # A claim in several groups (of an order that stands twice, say) has one outcome.
        once = F.when(F.bool_or(differs), "conflicts").when(F.bool_or(agrees), "agrees").otherwise("novel")
        told = steps.counted(swept.groupBy("claim_id").agg(once.alias("outcome")))
    j = keyed.select("claim_id", "key").join(told, "claim_id", "left")
    return j.select("claim_id", F.when(F.col("key").isNull(), "not_comparable").otherwise(F.coalesce("outcome", F.lit("novel")) if scope else F.col("outcome")).alias("outcome"))


_FIGURE = ("claim_id", "kind", "status", "ref_start", "ref_end", "proxy", "hundredths", *J.KEY_PARTS)


def statistic_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each figure against all comparable ones, whatever their run and city."""
    return _decided(claims(spark, d, *_FIGURE).where("kind = 'statistic' AND status <> 'insufficient'"), [])


def statistic_decisions_in_run(spark: SparkSession, d: str) -> DataFrame:
    """The same against the comparable figures of its run and city alone, as a research run decides."""
    return _decided(claims(spark, d, "city_id", "run_id", *_FIGURE).where("kind = 'statistic' AND status <> 'insufficient'"), ["city_id", "run_id"])


def statistic_decisions_everywhere(spark: SparkSession, d: str) -> DataFrame:
    """The same as statistic_decisions, under the name that it had while that one was held to run and city."""
    return statistic_decisions(spark, d)


_NO_DAY = "0001-01-01"
_COUNTED = ["n", "ended", "begun", "open_plain", "open_proxy"]
_RELATION = ("claim_id", "kind", "status", "subject", "object", "relation", "valid_from", "valid_to", "from_proxy")


def _rivals(c: DataFrame, edge: list[str]) -> DataFrame:
    """claim_id with rivals, supersede and history: how many claims of its edge name another subject, and with how many of them `J.succession` orders it so.

    Counted by day instead of met: those of the edge less those of its own subject. What ended by its begin is
    superseded, what begins once it has ended makes it history; of claims without an end the years of begin decide, and
    if either begin is a proxy's, they have to be more than the policy's months apart. An end lies after its begin.
    """
    begin, end, proxy = F.col("valid_from"), F.col("valid_to"), F.coalesce("from_proxy", F.lit(False))
    side = lambda own, who, sign: F.struct(F.lit(own).alias("own"), who.cast("long").alias("who"), F.lit(sign).alias("sign"))
    mine = F.when(F.col("subject").isNull(), side("claim", F.col("claim_id"), -1)).otherwise(side("subject", F.col("subject"), -1))
    sides = c.where(F.col("claim_id").isNotNull()).select("*", F.explode(F.array(side("all", F.lit(0), 1), mine)).alias("side")).select("*", "side.*")
    keys = [*edge, "own", "who"]

    point = lambda held, day, what: F.when(held, F.struct(day.alias("day"), what.alias("what")))
    none = F.lit(_NO_DAY).cast("date")
    points = F.array(
        point(F.lit(True), none, F.lit("n")), point(end.isNotNull(), end, F.lit("ended")), point(begin.isNotNull(), begin, F.lit("begun")),
        point(begin.isNotNull() & end.isNull(), begin, F.when(proxy, "open_proxy").otherwise("open_plain")),
    )
    points = sides.select(*keys, F.explode(F.array_compact(points)).alias("p")).select(*keys, "p.day", *[(F.col("p.what") == v).cast("long").alias(v) for v in _COUNTED])

    ask = lambda held, day, what, order: F.when(held, F.struct(day.alias("day"), F.lit(what).alias("what"), F.lit(order).alias("order")))
    year, months = F.trunc(begin, "year"), POLICY.proxy_months + 1
    before, until = F.date_sub(year, 1), F.date_sub(F.add_months(year, 12), 1)
    later = F.add_months(begin, months)
    # A month without such a day ends before so many whole months have passed.
    short = F.dayofmonth(later) < F.dayofmonth(begin)
    far_before, far_until = F.least(before, F.add_months(begin, -months)), F.greatest(until, F.when(short, later).otherwise(F.date_sub(later, 1)))
    open_ = begin.isNotNull() & end.isNull()
    asked = F.array(
        ask(F.lit(True), none, "n_upto", "rivals"), ask(begin.isNotNull(), begin, "ended_upto", "supersede"), ask(end.isNotNull(), F.date_sub(end, 1), "begun_after", "history"),
        ask(open_, F.when(proxy, far_before).otherwise(before), "open_plain_upto", "supersede"), ask(open_, far_before, "open_proxy_upto", "supersede"),
        ask(open_, F.when(proxy, far_until).otherwise(until), "open_plain_after", "history"), ask(open_, far_until, "open_proxy_after", "history"),
    )
    asked = sides.select(*keys, "claim_id", "sign", F.explode(F.array_compact(asked)).alias("q")).select(*keys, "claim_id", "sign", "q.*")

    found = asked.join(intervals.sums_around(points, asked, keys, "day", _COUNTED), [*keys, "day"])
    told = F.coalesce(*[F.when(F.col("what") == f"{v}_{s}", F.col(f"{v}_{s}")) for v in _COUNTED for s in ("upto", "after")])
    return found.groupBy("claim_id").agg(*[F.sum(F.when(F.col("order") == o, F.col("sign") * told).otherwise(0)).alias(o) for o in ("rivals", "supersede", "history")])


def _related(c: DataFrame, scope: list[str]) -> DataFrame:
    """claim_id and agrees, novel, conflicts, history or supersedes of each relation against those of its object and type in its scope.

    Only LEADS and GOVERNS allow one subject at a time; of the others an equal edge agrees.
    """
    edge = [*scope, "relation", "object"]
    again = c.groupBy(*edge, "subject").agg(F.min("claim_id").alias("first_id"), F.max("claim_id").alias("last_id")).where("first_id < last_id").select(*edge, "subject", F.lit(True).alias("same"))
    counted = _rivals(c.where("relation IN ('LEADS', 'GOVERNS') AND object IS NOT NULL"), edge)
    j = c.select(*edge, "subject", "claim_id").join(again, [*edge, "subject"], "left").join(counted, "claim_id", "left")
    outcome = F.when(F.col("rivals") > F.col("supersede") + F.col("history"), "conflicts").when(F.col("history") > 0, "history").when(F.col("supersede") > 0, "supersedes").when(F.col("same") & F.col("claim_id").isNotNull(), "agrees").otherwise("novel")
    return j.select("claim_id", outcome.alias("outcome"))


def relation_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each relation against all those of its object and type, whatever their run and city."""
    return _related(claims(spark, d, *_RELATION).where("kind = 'relation' AND status <> 'insufficient'"), [])


def relation_decisions_in_run(spark: SparkSession, d: str) -> DataFrame:
    """The same against the relations of its run and city alone, as a research run decides."""
    return _related(claims(spark, d, "city_id", "run_id", *_RELATION).where("kind = 'relation' AND status <> 'insufficient'"), ["city_id", "run_id"])


QUERIES = {f.__name__: f for f in (effective_levels, ranked_claims, claim_badges, claim_confidence, fact_cards, slot_statuses, coverage_rows, replan_slots, comparability_keys, key_differences, statistic_decisions, statistic_decisions_in_run, statistic_decisions_everywhere, relation_decisions, relation_decisions_in_run)}

_ORD = "list_position(['city_wide','sub_city_area','sub_city_population','metro_region','district','state_province','national','global'], {})"
_EFF = f"""CASE WHEN fit = 'nearby' THEN CASE WHEN {_ORD.format('level')} < 5 THEN 'district' ELSE level END
  WHEN fit = 'contains_city' THEN CASE WHEN {_ORD.format('level')} < 4 THEN 'metro_region' ELSE level END
  WHEN fit = 'city' THEN CASE WHEN fit_level IS NOT NULL THEN fit_level WHEN {_ORD.format('level')} >= 4 THEN 'city_wide' ELSE level END
  ELSE level END"""
_DIST = f"least(abs({_ORD.format('eff')} - 1), abs({_ORD.format('eff')} - 3))"
_TIER = "CASE publisher WHEN 'academic' THEN 1 WHEN 'ngo' THEN 2 WHEN 'news' THEN 3 WHEN 'other' THEN 4 ELSE 0 END"
_SAMP = "CASE sampling WHEN 'census' THEN 0 WHEN 'representative_sample' THEN 1 WHEN 'modelled' THEN 2 WHEN 'non_representative' THEN 4 ELSE 3 END"
_KEY = f"{_DIST}, {_TIER}, {_SAMP}, ref_end IS NULL, ref_end DESC, claim_id"
_WITH = f"WITH {CLAIM_SQL}, e AS (SELECT *, {_EFF} AS eff FROM claim)"
_CITY = "eff IN ('city_wide', 'sub_city_population')"
_B1 = f"(NOT {_CITY} OR subgroup IS NOT NULL OR setting IN ('facility', 'school', 'workplace'))"
_B2 = "(status = 'contested')"
_B3 = "coalesce(CASE WHEN kind <> 'relation' THEN ref_end < DATE '1997-02-28' WHEN relation = 'LEADS' THEN ref_end < DATE '2000-02-28' END, false)"
_B4 = "(sampling = 'non_representative' OR coalesce(sample_size < 300, false))"
_LIST = f"list_filter([CASE WHEN {_B1} THEN 'not_city_level' END, CASE WHEN {_B2} THEN 'sources_disagree' END, CASE WHEN {_B3} THEN 'outdated' END, CASE WHEN {_B4} THEN 'limited_sample' END], lambda x: x IS NOT NULL)"
_PTS = {
    "source_tier": "CASE WHEN publisher IN ('government', 'multilateral', 'academic') THEN 2 WHEN publisher = 'ngo' THEN 1 ELSE 0 END",
    "sampling": "CASE WHEN sampling IN ('census', 'representative_sample') THEN 2 WHEN sampling = 'non_representative' THEN 0 ELSE 1 END",
    "geography": f"CASE WHEN {_CITY} THEN 2 ELSE 0 END",
    "recency": "CASE WHEN ref_end >= DATE '1997-02-28' THEN 1 ELSE 0 END",
    "denominator": "CASE WHEN denominator_stated OR measure = 'count' THEN 1 ELSE 0 END",
    "verdict": "CASE WHEN scope_verified THEN 1 ELSE 0 END",
}
_REASONS = " || ';' || ".join(f"'{n}=' || ({p})" for n, p in _PTS.items())
_POINTS = " + ".join(f"({p})" for p in _PTS.values())
_LABEL = "CASE WHEN points >= 7 AND NOT (fallback OR proxy OR ref_end IS NULL) THEN 'High' WHEN points >= 4 THEN 'Medium' ELSE 'Low' END"
_GAPS = "list_filter([CASE WHEN hundredths IS NULL THEN 'value not parsed' END, CASE WHEN age_min IS NULL THEN 'ages not stated' END, CASE WHEN sex = 'not_stated' THEN 'sex not stated' END, CASE WHEN setting = 'not_stated' THEN 'setting not stated' END], lambda x: x IS NOT NULL)"
_CKEY = f"CASE WHEN len({_GAPS}) = 0 THEN indicator || '|' || measure || '|' || unit || '|' || sex || '|' || age_min || '|' || level || '|' || setting || '|' || coalesce(subgroup, '-') END"
_STATUS = f"""c AS (SELECT city_id, slot,
    bool_or(status <> 'insufficient' AND (slot % 2 = 0) = (kind = 'statistic') AND {_CITY}) AS in_city, bool_or(status <> 'insufficient') AS shown, bool_or(status = 'contested') AS conflicting
    FROM e GROUP BY ALL),
  o AS (SELECT o_custkey AS city_id, CAST(o_orderkey % 16 AS INT) AS slot, count(*) FILTER (WHERE o_orderstatus = 'F') AS fetched, bool_or(o_orderpriority = '1-URGENT') AS blocked FROM orders GROUP BY ALL),
  st AS (SELECT o.city_id, o.slot, CASE WHEN in_city THEN 'answered' WHEN shown THEN 'answered_wider_geo' WHEN fetched = 0 AND blocked THEN 'blocked' WHEN fetched = 0 THEN 'unreachable' ELSE 'answered_negative' END AS slot_status,
    coalesce(conflicting, false) AS conflicting FROM o LEFT JOIN c USING (city_id, slot))"""
_RETRY = "slot_status IN ('answered_negative', 'blocked', 'unreachable')"

_DECIDED = f"""WITH {CLAIM_SQL}, k AS (SELECT *, {_CKEY} AS key FROM claim WHERE kind = 'statistic' AND status <> 'insufficient'),
        m AS (SELECT a.claim_id, (a.proxy OR b.proxy OR coalesce(a.ref_start, a.ref_end) IS NULL OR coalesce(b.ref_start, b.ref_end) IS NULL OR (coalesce(a.ref_start, a.ref_end) <= coalesce(b.ref_end, b.ref_start) AND coalesce(b.ref_start, b.ref_end) <= coalesce(a.ref_end, a.ref_start))) AS overlap,
            CASE WHEN a.unit = 'percent' THEN abs(a.hundredths - b.hundredths) <= 50 ELSE greatest(abs(a.hundredths), abs(b.hundredths)) = 0 OR abs(a.hundredths - b.hundredths) <= greatest(abs(a.hundredths), abs(b.hundredths)) * CAST(0.02 AS DOUBLE) END AS agree
          FROM k a JOIN k b ON {{}} AND a.claim_id <> b.claim_id),
        s AS (SELECT claim_id, bool_or(overlap AND NOT agree) AS conflict, bool_or(overlap AND agree) AS agree FROM m GROUP BY ALL)
        SELECT claim_id, CASE WHEN key IS NULL THEN 'not_comparable' WHEN conflict THEN 'conflicts' WHEN agree THEN 'agrees' ELSE 'novel' END AS outcome FROM k LEFT JOIN s USING (claim_id)"""

_RELATED = f"""WITH {CLAIM_SQL}, k AS (SELECT * FROM claim WHERE kind = 'relation' AND status <> 'insufficient'),
        m AS (SELECT a.claim_id, a.subject = b.subject AS same, CASE WHEN a.subject = b.subject OR a.relation NOT IN ('LEADS', 'GOVERNS') THEN NULL
            WHEN b.valid_to <= a.valid_from THEN 'supersede' WHEN a.valid_to <= b.valid_from THEN 'history' WHEN a.valid_from IS NULL OR b.valid_from IS NULL THEN 'conflict'
            WHEN (a.from_proxy OR b.from_proxy) AND datediff('month', least(a.valid_from, b.valid_from), greatest(a.valid_from, b.valid_from)) - CASE WHEN day(greatest(a.valid_from, b.valid_from)) < day(least(a.valid_from, b.valid_from)) THEN 1 ELSE 0 END <= 12 THEN 'conflict'
            WHEN coalesce(b.valid_to > a.valid_from, false) OR coalesce(a.valid_to > b.valid_from, false) THEN 'conflict'
            WHEN year(a.valid_from) > year(b.valid_from) THEN 'supersede' WHEN year(a.valid_from) < year(b.valid_from) THEN 'history' ELSE 'conflict' END AS o
          FROM k a JOIN k b ON {{}} AND a.claim_id <> b.claim_id),
        s AS (SELECT claim_id, bool_or(same) AS same, bool_or(o = 'conflict') AS conflict, bool_or(o = 'history') AS history, bool_or(o = 'supersede') AS supersede FROM m GROUP BY ALL)
        SELECT claim_id, CASE WHEN conflict THEN 'conflicts' WHEN history THEN 'history' WHEN supersede THEN 'supersedes' WHEN same THEN 'agrees' ELSE 'novel' END AS outcome FROM k LEFT JOIN s USING (claim_id)"""

ORACLES = {
    "effective_levels": f"{_WITH} SELECT level, fit, eff AS effective, count(*) AS n FROM e GROUP BY ALL",
    "ranked_claims": f"{_WITH}, r AS (SELECT *, CAST({_DIST} AS INT) AS distance, CAST(row_number() OVER (PARTITION BY city_id, slot ORDER BY {_KEY}) AS INT) AS rank FROM e WHERE slot < 8) SELECT city_id, slot, claim_id, distance, rank FROM r WHERE rank <= 2",
    "claim_badges": f"{_WITH} SELECT claim_id, {_LIST}[1] AS main, array_to_string({_LIST}[2:], ',') AS others FROM e",
    "claim_confidence": f"{_WITH}, p AS (SELECT *, CAST({_POINTS} AS INT) AS points, {_REASONS} AS reasons FROM e WHERE status <> 'insufficient') SELECT claim_id, points, {_LABEL} AS label, reasons FROM p",
    "fact_cards": f"""{_WITH}, p AS (SELECT *, {_POINTS} AS points FROM e WHERE status <> 'insufficient')
        SELECT {_LIST}[1] AS main, {_LABEL} AS label, CASE WHEN proxy THEN coalesce('published ' || strftime(ref_end, '%Y'), '') ELSE concat_ws(' to ', strftime(ref_start, '%Y-%m'), strftime(ref_end, '%Y-%m')) END AS period, count(*) AS n FROM p GROUP BY ALL""",
    "slot_statuses": f"{_WITH}, {_STATUS} SELECT city_id, slot, slot_status, conflicting, {_RETRY} AS retry FROM st",
    "coverage_rows": f"""{_WITH}, r AS (SELECT *, row_number() OVER (PARTITION BY city_id, slot ORDER BY {_KEY}) AS rk FROM e WHERE status <> 'insufficient')
        SELECT city_id, slot, string_agg(claim_id::VARCHAR, ',' ORDER BY rk) AS best, CASE WHEN count(*) FILTER (WHERE {_DIST} = 0) = 0 THEN 'Only figures for a wider area were found.' END AS note FROM r WHERE rk <= 3 GROUP BY ALL""",
    "replan_slots": f"""{_WITH}, {_STATUS}, w AS (SELECT city_id, slot, CAST(row_number() OVER (PARTITION BY city_id ORDER BY coalesce(list_position([11, 4, 8], slot), 99), slot) AS INT) AS place FROM st WHERE {_RETRY})
        SELECT city_id, slot, place FROM w JOIN customer ON c_custkey = city_id WHERE place <= CAST(floor(greatest(c_acctbal, 0) / 2500) AS INT)""",
    "comparability_keys": f"WITH {CLAIM_SQL} SELECT {_CKEY} AS key, array_to_string({_GAPS}, '; ') AS gaps, count(*) AS n FROM claim WHERE kind = 'statistic' GROUP BY ALL",
    "key_differences": f"""WITH {CLAIM_SQL}, p AS (SELECT *, {', '.join(f'lag({c}) OVER w AS p_{c}' for c in J.KEY_PARTS)}, lag(claim_id) OVER w AS before FROM claim WHERE kind = 'statistic' WINDOW w AS (PARTITION BY source_id ORDER BY claim_id))
        SELECT array_to_string(list_filter([{', '.join(f"CASE WHEN {c} IS DISTINCT FROM p_{c} THEN '{c}' END" for c in J.KEY_PARTS)}], lambda x: x IS NOT NULL), ', ') AS parts, count(*) AS n FROM p WHERE before IS NOT NULL GROUP BY ALL""",
    "statistic_decisions": _DECIDED.format("a.key = b.key"),
    "statistic_decisions_in_run": _DECIDED.format("a.key = b.key AND a.city_id = b.city_id AND a.run_id = b.run_id"),
    "statistic_decisions_everywhere": _DECIDED.format("a.key = b.key"),
    "relation_decisions": _RELATED.format("a.relation = b.relation AND a.object = b.object"),
    "relation_decisions_in_run": _RELATED.format("a.city_id = b.city_id AND a.run_id = b.run_id AND a.relation = b.relation AND a.object = b.object"),
}

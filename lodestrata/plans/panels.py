"""What readers see: lookups, excerpts, panels, briefs, labels; and the writes that feed them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import judging as J
from lodestrata.operators import passages
from lodestrata.plans import judging as PJ
from lodestrata.plans import text as PT
from lodestrata.sources.claims import CLAIM_SQL, claims
from lodestrata.sources.tables import table

POLICY = J.Policy()


def source_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Sources by key, with a flag instead of the text that is large."""
    return table(spark, d, "pages").where("page_id IN (1, 5, 42, 77)").select("page_id", "url", F.col("html").isNotNull().alias("has_text"))


def source_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """A stretch of each text by 0-based start and length."""
    return table(spark, d, "documents").select("doc_id", F.substring("text", (F.col("doc_id") % 50 + 1).cast("int"), F.lit(60)).alias("excerpt"))


def latest_reports(spark: SparkSession, d: str) -> DataFrame:
    """The newest stored report of each run's customer and format; of equal dates the larger id."""
    o = table(spark, d, "orders").withColumn("format", F.when(F.col("o_orderkey") % 3 == 0, "html").otherwise("md"))
    return o.groupBy("o_custkey", "format").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("report"))


def statistic_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of shown claims with a statistic, in order, of each run that has any."""
    c = claims(spark, d, "claim_id", "run_id", "kind", "status").where("kind = 'statistic' AND status IN ('supported', 'contested')")
    return c.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("claim_id")), lambda x: x.cast("string")), ",").alias("ids"))


def slot_indicators(spark: SparkSession, d: str) -> DataFrame:
    """Indicators that the claims of each slot bear, with their sources counted."""
    c = claims(spark, d, "slot", "indicator", "source_id", "kind").where("kind = 'statistic'")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"))
    return c.join(s, "source_id").groupBy("slot", "indicator").agg(F.countDistinct("source_id").alias("sources"))


def retrieval_gates(spark: SparkSession, d: str) -> DataFrame:
    """Recall of each question (1 where nothing is wanted), claims out of scope, and whether it passes both gates."""
    c = claims(spark, d, "slot", "claim_id", "status", "level")
    s = c.groupBy("slot").agg(F.count_if(F.col("level") == "city_wide").alias("wanted"), F.count_if((F.col("level") == "city_wide") & (F.col("status") == "supported")).alias("found"), F.count_if((F.col("level") == "global") & (F.col("status") == "contested")).alias("outside"))
    recall = F.when(F.col("wanted") == 0, F.lit(1.0)).otherwise(F.round(F.col("found") / F.col("wanted"), 6))
    return s.select("slot", recall.alias("recall"), "outside", ((recall >= 0.5) & (F.col("outside") < 20)).alias("passes"))


def dimension_brief(spark: SparkSession, d: str) -> DataFrame:
    """Three facts of each city and dimension: the headline slot first, of each slot its best of High or Medium confidence."""
    today = F.lit(PJ.TODAY).cast("date")
    c = claims(spark, d).where("status IN ('supported', 'contested')").withColumn("points", J.points(today, POLICY)).where(F.col("points") >= POLICY.medium)
    first = c.withColumn("k", F.row_number().over(Window.partitionBy("city_id", "slot").orderBy(*J.rank_key(POLICY)))).where("k = 1").withColumn("dimension", (F.col("slot") % 6).cast("int"))
    w = Window.partitionBy("city_id", "dimension").orderBy(F.col("slot") != 4, "slot")
    return first.withColumn("place", F.row_number().over(w)).where("place <= 3").select("city_id", "dimension", "place", "claim_id")


WORDS = {"national": "country", "global": "world", "state_province": "state", "metro_region": "region"}


def scope_words(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that name the city but cite a wider fact without its level's word, by level."""
    c = claims(spark, d, "claim_id", "level", "subject")
    words = F.create_map(*[F.lit(x) for pair in WORDS.items() for x in pair])
    text = F.concat(F.lit("In the city, as "), F.when(F.col("subject") % 3 == 0, F.coalesce(words[F.col("level")], F.lit("here"))).otherwise("usual"), F.lit(", it is so."))
    missing = F.coalesce(~F.contains(text, words[F.col("level")]), F.lit(False))
    return c.groupBy("level").agg(F.count_if(missing).alias("missing"), F.count(F.lit(1)).alias("n"))


def contested_wording(spark: SparkSession, d: str) -> DataFrame:
    """Text of both sides of each pair of a city's figures that differ in value for one indicator: the smaller id first."""
    c = claims(spark, d, "claim_id", "city_id", "indicator", "hundredths", "unit", "kind", "status").where("kind = 'statistic' AND status = 'contested' AND hundredths IS NOT NULL")
    w = Window.partitionBy("city_id", "indicator").orderBy("claim_id")
    p = c.withColumn("other", F.lead("hundredths").over(w)).where("other IS NOT NULL AND other <> hundredths")
    return p.select("claim_id", F.concat(F.lit("One source says "), "hundredths", F.lit(", another "), "other", F.when(F.col("unit") == "percent", " (hundredths of a percent).").otherwise(".")).alias("text"))


LABELS = {"city_wide": "the whole city", "national": "the country", "global": "the world", "district": "a district"}


def labelled_levels(spark: SparkSession, d: str) -> DataFrame:
    """Codes as they are shown, unknown ones as they are; counts with thousands grouped."""
    shown = F.coalesce(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[F.col("level")], F.col("level"))
    return claims(spark, d, "level").groupBy(shown.alias("label")).agg(F.format_number(F.count(F.lit(1)) * 1000, 0).alias("n"))


def entities_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Brands of each part type with how many facts touch them, most first, as one list."""
    n = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    j = table(spark, d, "part").join(n, F.col("l_partkey") == F.col("p_partkey"), "left").groupBy("p_type", "p_brand").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return j.groupBy("p_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "p_brand"))), lambda x: F.concat(x["p_brand"], F.lit("="), (-x["m"]).cast("string"))), ",").alias("entities"))


#: Characters of context on each side of a quote.
MARGIN = 60


def evidence_panels(spark: SparkSession, d: str) -> DataFrame:
    """Panel of every quote that a document holds: the quote with its margins (clamped to the text), where it stands in them, verdict, digest.

    Quotes are the benchmark's passages, found in whole texts by their keys; the first place counts.
    """
    docs, quotes = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    met = passages.candidates(docs, quotes, "text", "quote", "doc_id", "item_id").withColumn("at", F.instr(F.col("text"), F.col("quote")) - 1).where("at >= 0")
    begin = F.greatest(F.col("at") - MARGIN, F.lit(0))
    end = F.least(F.col("at") + F.length("quote") + MARGIN, F.length("text"))
    said = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    j = met.join(said, "doc_id", "left")
    verdict = F.when(F.col("quality") == 1, "supported").when(F.col("quality") == 0, "refuted")
    return j.select("doc_id", "item_id", F.substring(F.col("text"), begin + 1, end - begin).alias("passage"), (F.col("at") - begin).alias("starts"), (F.col("at") - begin + F.length("quote")).alias("ends"), verdict.alias("verdict"), F.sha2("text", 256).alias("snapshot"))


def index_points(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every document (its windows by tokens) as points of an index: key, digest of the text to embed, payload as JSON."""
    whole = table(spark, d, "documents").select("doc_id", "lang", "source")
    chunks = PT.token_windows(spark, d).join(whole, "doc_id")
    payload = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("lang"), F.col("source"), F.col("span_start").alias("start"), F.col("span_end").alias("end")))
    return chunks.select(F.concat_ws(":", "doc_id", "no").alias("point"), "digest", payload.alias("payload"))


def wire_claims(spark: SparkSession, d: str) -> DataFrame:
    """Flat rows of an extractor to typed ones: partial dates resolved, inverted periods cleared, with their problems."""
    e = F.col("claim_id") % 5
    c = claims(spark, d, "claim_id", "ref_start", "ref_end").where("ref_start IS NOT NULL")
    start, end = F.when(e == 0, F.date_format("ref_start", "yyyy")).when(e == 1, F.date_format("ref_start", "yyyy-MM")).when(e == 2, F.lit("soon")).otherwise(F.col("ref_start").cast("string")), F.when(e == 3, F.lit("1990")).otherwise(F.date_format("ref_end", "yyyy"))
    c = c.select("claim_id", start.alias("s"), end.alias("e"))
    first = lambda x: F.when(x.rlike("^[0-9]{4}$"), F.concat(x, F.lit("-01-01"))).when(x.rlike("^[0-9]{4}-[0-9]{2}$"), F.concat(x, F.lit("-01"))).otherwise(x).try_cast("date")
    c = c.select("claim_id", first(F.col("s")).alias("s"), F.concat(F.col("e"), F.lit("-12-31")).try_cast("date").alias("e"))
    bad = F.concat_ws(",", F.when(F.col("s").isNull(), "start_unreadable"), F.when(F.col("s") > F.col("e"), "period_inverted"))
    ok = F.coalesce(F.col("s") <= F.col("e"), F.lit(True))
    return c.select("claim_id", F.when(ok, F.col("s")).alias("ref_start"), F.when(ok, F.col("e")).alias("ref_end"), bad.alias("problems"))


def official_claims(spark: SparkSession, d: str) -> DataFrame:
    """The latest record of each provider and indicator as claim with value and verdict; none where two share the date."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("provider"), (F.col("l_partkey") % 12).alias("indicator"), F.col("l_shipdate").cast("date").alias("at"), "l_extendedprice")
    days = li.groupBy("provider", "indicator", "at").agg(F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").alias("value"))
    last = days.groupBy("provider", "indicator").agg(F.max_by(F.struct("at", "n", "value"), "at").alias("x")).where("x.n = 1")
    return last.select("provider", "indicator", F.concat_ws(" ", F.lit("Indicator"), "indicator", F.lit("was"), F.format_string("%.2f", "x.value"), F.lit("in"), F.year("x.at")).alias("statement"), F.lit("supported").alias("verdict"))


def programme_status(spark: SparkSession, d: str) -> DataFrame:
    """Attribute of each programme from its newest known observation; `unknown` never overrides; ties go to the smaller id."""
    li = table(spark, d, "lineitem").select("l_partkey", F.col("l_shipdate").alias("at"), F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "A", "active").when(F.col("l_returnflag") == "R", "ended").otherwise("unknown").alias("status"))
    known = li.where("status <> 'unknown'").groupBy("l_partkey").agg(F.max_by("status", F.struct("at", (-F.col("id")).alias("m"), "status")).alias("status"))
    return table(spark, d, "part").join(known, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("status", F.lit("unknown")).alias("status"))


def embedding_guard(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by their length: more than one in a collection must not be searched together."""
    e = table(spark, d, "embeddings").groupBy("label", F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("vectors")).withColumn("usable", F.col("kinds") == 1)


def ensured_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchor entities (cities and indicators) that claims need and the graph (even ids) lacks, by kind."""
    c = claims(spark, d, "city_id", "indicator")
    need = c.select(F.lit("city").alias("kind"), F.col("city_id").alias("id")).union(c.select(F.lit("indicator"), F.col("indicator").cast("long"))).distinct()
    return need.groupBy("kind").agg(F.count_if(F.col("id") % 2 == 0).alias("there"), F.count_if(F.col("id") % 2 != 0).alias("created"))


ROUNDS = 3


def replanned_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Rounds of re-planning until no slot qualifies, three at most: in round r, slots with (slot + r) % 3 = 0 get an answer.

    Slots left open in each round.
    """
    left = PJ.slot_statuses(spark, d).where("retry").select("city_id", "slot")
    out = None
    for r in range(1, ROUNDS + 1):
        left = left.where((F.col("slot") + r) % 3 != 0)
        n = left.agg(F.count(F.lit(1)).alias("open")).select(F.lit(r).alias("round"), "open")
        out = n if out is None else out.union(n)
    return out


QUERIES = {f.__name__: f for f in (source_lookups, source_excerpts, latest_reports, statistic_ids, slot_indicators, retrieval_gates, dimension_brief, scope_words, contested_wording, labelled_levels, entities_by_type, evidence_panels, index_points, wire_claims, official_claims, programme_status, embedding_guard, ensured_anchors, replanned_rounds)}

_W = f"WITH {CLAIM_SQL}"
_S = "CASE claim_id % 5 WHEN 0 THEN make_date(year(ref_start), 1, 1) WHEN 1 THEN make_date(year(ref_start), month(ref_start), 1) WHEN 2 THEN NULL ELSE ref_start END"
_E = "CASE claim_id % 5 WHEN 3 THEN DATE '1990-12-31' ELSE make_date(year(ref_end), 12, 31) END"

ORACLES = {
    "source_lookups": "SELECT page_id, url, html IS NOT NULL AS has_text FROM pages WHERE page_id IN (1, 5, 42, 77)",
    "source_excerpts": "SELECT doc_id, substring(text, doc_id % 50 + 1, 60) AS excerpt FROM documents",
    "latest_reports": "SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'html' ELSE 'md' END AS format, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS report FROM orders GROUP BY ALL",
    "statistic_ids": f"{_W} SELECT run_id, string_agg(claim_id::VARCHAR, ',' ORDER BY claim_id) AS ids FROM claim WHERE kind = 'statistic' AND status <> 'insufficient' GROUP BY ALL",
    "slot_indicators": f"{_W} SELECT slot, indicator, count(DISTINCT source_id) AS sources FROM claim WHERE kind = 'statistic' AND source_id IN (SELECT s_suppkey FROM supplier) GROUP BY ALL",
    "retrieval_gates": f"""{_W}, s AS (SELECT slot, count(*) FILTER (WHERE level = 'city_wide') AS w, count(*) FILTER (WHERE level = 'city_wide' AND status = 'supported') AS f, count(*) FILTER (WHERE level = 'global' AND status = 'contested') AS outside FROM claim GROUP BY ALL),
        r AS (SELECT slot, CASE WHEN w = 0 THEN 1 ELSE round(f / w, 6) END AS recall, outside FROM s) SELECT slot, recall, outside, recall >= CAST(0.5 AS DOUBLE) AND outside < 20 AS passes FROM r""",
    "dimension_brief": f"""{PJ._WITH}, p AS (SELECT *, {PJ._POINTS} AS points FROM e WHERE status <> 'insufficient'), f AS (SELECT *, row_number() OVER (PARTITION BY city_id, slot ORDER BY {PJ._KEY}) AS k FROM p WHERE points >= 4),
        w AS (SELECT city_id, slot % 6 AS dimension, claim_id, CAST(row_number() OVER (PARTITION BY city_id, slot % 6 ORDER BY slot <> 4, slot) AS INT) AS place FROM f WHERE k = 1) SELECT city_id, dimension, place, claim_id FROM w WHERE place <= 3""",
    "scope_words": f"{_W} SELECT level, count(*) FILTER (WHERE level IN ('national', 'global', 'state_province', 'metro_region') AND subject % 3 <> 0) AS missing, count(*) AS n FROM claim GROUP BY ALL",
    "contested_wording": f"""{_W}, p AS (SELECT *, lead(hundredths) OVER (PARTITION BY city_id, indicator ORDER BY claim_id) AS other FROM claim WHERE kind = 'statistic' AND status = 'contested' AND hundredths IS NOT NULL)
        SELECT claim_id, 'One source says ' || hundredths || ', another ' || other || CASE WHEN unit = 'percent' THEN ' (hundredths of a percent).' ELSE '.' END AS text FROM p WHERE other <> hundredths""",
    "labelled_levels": f"{_W} SELECT CASE level WHEN 'city_wide' THEN 'the whole city' WHEN 'national' THEN 'the country' WHEN 'global' THEN 'the world' WHEN 'district' THEN 'a district' ELSE level END AS label, format('{{:,}}', count(*) * 1000) AS n FROM claim GROUP BY 1",
    "entities_by_type": "WITH n AS (SELECT p_type, p_brand, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL) SELECT p_type, string_agg(p_brand || '=' || n, ',' ORDER BY n DESC, p_brand) AS entities FROM n GROUP BY ALL",
    "evidence_panels": f"""WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY ALL),
        f AS (SELECT d.doc_id, item_id, d.text, b.text AS quote, instr(d.text, b.text) - 1 AS p FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
        w AS (SELECT *, greatest(p - {MARGIN}, 0) AS b, least(p + length(quote) + {MARGIN}, length(text)) AS e FROM f)
        SELECT doc_id, item_id, substring(text, b + 1, e - b) AS passage, (p - b)::INT AS starts, (p - b + length(quote))::INT AS ends, CASE q WHEN 1 THEN 'supported' WHEN 0 THEN 'refuted' END AS verdict, sha256(text) AS snapshot FROM w LEFT JOIN l USING (doc_id)""",
    "index_points": f"""SELECT doc_id || ':' || no AS point, digest, '{{"id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '","start":' || span_start || ',"end":' || span_end || '}}' AS payload
        FROM ({PT.ORACLES['token_windows']}) JOIN documents USING (doc_id)""",
    "wire_claims": f"""{_W}, c AS (SELECT claim_id, {_S} AS s, {_E} AS e FROM claim WHERE ref_start IS NOT NULL)
        SELECT claim_id, CASE WHEN s > e THEN NULL ELSE s END AS ref_start, CASE WHEN s > e THEN NULL ELSE e END AS ref_end, concat_ws(',', CASE WHEN s IS NULL THEN 'start_unreadable' END, CASE WHEN s > e THEN 'period_inverted' END) AS problems FROM c""",
    "official_claims": """WITH d AS (SELECT l_suppkey AS provider, l_partkey % 12 AS indicator, CAST(l_shipdate AS DATE) AS at_, count(*) AS n, max(l_extendedprice) AS value FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY provider, indicator ORDER BY at_ DESC) AS rn FROM d)
        SELECT provider, indicator, 'Indicator ' || indicator || ' was ' || printf('%.2f', value) || ' in ' || year(at_) AS statement, 'supported' AS verdict FROM r WHERE rn = 1 AND n = 1""",
    "programme_status": """WITH k AS (SELECT l_partkey, CASE l_returnflag WHEN 'A' THEN 'active' ELSE 'ended' END AS status, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, CASE l_returnflag WHEN 'A' THEN 'active' ELSE 'ended' END DESC) AS rn FROM lineitem WHERE l_returnflag IN ('A', 'R'))
        SELECT p_partkey, coalesce(status, 'unknown') AS status FROM part LEFT JOIN k ON l_partkey = p_partkey AND rn = 1""",
    "embedding_guard": "WITH e AS (SELECT label, len(embedding) AS dim, count(*) AS n FROM embeddings GROUP BY ALL) SELECT label, count(*) AS kinds, sum(n)::BIGINT AS vectors, count(*) = 1 AS usable FROM e GROUP BY ALL",
    "ensured_anchors": f"{_W}, n AS (SELECT DISTINCT 'city' AS kind, city_id AS id FROM claim UNION SELECT DISTINCT 'indicator', indicator FROM claim) SELECT kind, count(*) FILTER (WHERE id % 2 = 0) AS there, count(*) FILTER (WHERE id % 2 <> 0) AS created FROM n GROUP BY ALL",
    "replanned_rounds": f"""{PJ._WITH}, {PJ._STATUS}, o_ AS (SELECT slot FROM st WHERE {PJ._RETRY}) SELECT 1 AS round, count(*) AS open FROM o_ WHERE (slot + 1) % 3 <> 0 UNION ALL SELECT 2, count(*) FROM o_ WHERE (slot + 1) % 3 <> 0 AND (slot + 2) % 3 <> 0 UNION ALL SELECT 3, count(*) FROM o_ WHERE (slot + 1) % 3 <> 0 AND (slot + 2) % 3 <> 0 AND slot % 3 <> 0""",
}

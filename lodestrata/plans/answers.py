"""Questions answered from facts: fused routes, bundles, evidence lines, checks of answers, reports; and the figures around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import redaction
from lodestrata.operators import fusion
from lodestrata.plans import graph as G
from lodestrata.plans import upkeep as U
from lodestrata.sources.claims import CLAIM_SQL, claims
from lodestrata.sources.tables import table

PER_SLOT, PER_CITY = 2, 4


def _bundle(spark: SparkSession, d: str) -> DataFrame:
    """city_id, claim_id, slot, score, place: routes fused, re-validated, at most two claims a slot and four a city."""
    routes = U.structured_route(spark, d).unionByName(G.graph_route(spark, d)).withColumn("item", F.struct("city_id", "claim_id"))
    fused = fusion.reciprocal_rank_fusion(routes, "item", "rank").select("item.city_id", "item.claim_id", "score")
    valid = claims(spark, d, "claim_id", "slot", "status", "scope_verified").where("status <> 'insufficient' AND scope_verified").select("claim_id", "slot")
    j = fused.join(valid, "claim_id")
    best = [F.col("score").desc(), F.col("claim_id")]
    j = j.withColumn("k", F.row_number().over(Window.partitionBy("city_id", "slot").orderBy(*best))).where(F.col("k") <= PER_SLOT)
    return j.withColumn("place", F.row_number().over(Window.partitionBy("city_id").orderBy(*best))).where(F.col("place") <= PER_CITY).drop("k")


def ask_bundle(spark: SparkSession, d: str) -> DataFrame:
    return _bundle(spark, d)


def _bundle_items(spark: SparkSession, d: str) -> DataFrame:
    """city_id, slot, claim_id, other, anchored: what a bundle chooses from, contested claims with the next of their slot."""
    c = claims(spark, d, "city_id", "slot", "claim_id", "status", "scope_verified").where("status <> 'insufficient'")
    w = Window.partitionBy("city_id", "slot").orderBy("claim_id")
    nxt = F.lead("claim_id").over(Window.partitionBy("city_id").orderBy(F.col("claim_id") % 1000, "claim_id"))
    return c.select("city_id", "slot", "claim_id", F.when(F.col("status") == "contested", nxt).alias("other"), ((F.row_number().over(w) == 1) & F.col("scope_verified") & (F.col("slot") % 5 == 0)).alias("anchored"))


def diverse_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Each city's bundle: at most two claims a slot and eight in all, in order of their last digits; pairs whole or not at all."""
    order = [F.col("claim_id") % 1000, F.col("claim_id")]
    return fusion.diverse(_bundle_items(spark, d), "city_id", order, "slot", "claim_id", "other", "anchored", 2, 8).select("city_id", F.col("item").alias("claim_id"), "place")


def evidence_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of evidence that an answerer gets for each city, in order."""
    c = claims(spark, d, "claim_id", "level", "ref_end", "hundredths", "unit", "status")
    line = F.concat_ws(" | ", F.concat(F.lit("F"), "place"), "level", F.date_format("ref_end", "yyyy"), F.concat_ws(" ", F.col("hundredths").cast("string"), F.when(F.col("hundredths").isNotNull(), F.col("unit"))), F.when(F.col("status") == "contested", "sources disagree"))
    j = _bundle(spark, d).join(c, "claim_id").select("city_id", "place", line.alias("line"))
    return j.groupBy("city_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("lines"))


def retrieval_traces(spark: SparkSession, d: str) -> DataFrame:
    """How many claims each route gave and how many stayed in the bundle, per city, as one JSON line."""
    bundle = _bundle(spark, d).select("city_id", "claim_id", F.lit(1).alias("kept"))
    routes = U.structured_route(spark, d).select("city_id", "claim_id", F.lit("structured").alias("route")).unionByName(G.graph_route(spark, d).select("city_id", "claim_id", F.lit("graph").alias("route")))
    n = routes.join(bundle, ["city_id", "claim_id"], "left").groupBy("city_id").agg(F.count_if(F.col("route") == "structured").alias("s"), F.count_if(F.col("route") == "graph").alias("g"), F.count("kept").alias("k"))
    return n.select("city_id", F.to_json(F.struct(F.col("s").alias("structured"), F.col("g").alias("graph"), F.col("k").alias("kept"))).alias("trace"))


def checked_answers(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of answers: kept, or taken out for the first reason (too long, says the same again, nothing cited).

    Cited is a sentence with a comma, which stands for a reference here. Survival is the share kept.
    """
    t = table(spark, d, "conversations").where("role = 'assistant'")
    s = t.select("conv_id", "turn", F.posexplode(F.split(F.trim("text"), r"[.!?]\s+")).alias("pos", "s"))
    s = s.withColumn("same", F.row_number().over(Window.partitionBy("conv_id", "turn", F.lower("s")).orderBy("pos")))
    why = F.coalesce(F.when(F.size(F.split("s", " ")) > 12, "too_long"), F.when(F.col("same") > 1, "repeated"), F.when(~F.contains("s", F.lit(",")), "uncited"))
    s = s.withColumn("why", why)
    return s.groupBy("conv_id", "turn").agg(F.count_if(F.col("why") == "too_long").alias("too_long"), F.count_if(F.col("why") == "repeated").alias("repeated"), F.count_if(F.col("why") == "uncited").alias("uncited"), F.round(F.count_if(F.col("why").isNull()) / F.count(F.lit(1)), 6).alias("survival"))


def html_reports(spark: SparkSession, d: str) -> DataFrame:
    """A report of each region as HTML: heading, nations as sections, their three largest accounts as an escaped list."""
    c = table(spark, d, "customer").select("c_nationkey", "c_name", "c_acctbal", "c_custkey")
    w = Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    c = c.withColumn("k", F.row_number().over(w)).where("k <= 3")
    safe = F.replace(F.replace(F.replace(F.concat("c_name", F.lit(" <a&b>")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    items = c.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", safe.alias("i")))), lambda x: F.concat(F.lit("<li>"), x["i"], F.lit("</li>"))), "").alias("items"))
    n = table(spark, d, "nation").join(items, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "n_nationkey", F.concat(F.lit("<h2>"), "n_name", F.lit("</h2><ol>"), "items", F.lit("</ol>")).alias("section"))
    body = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "section"))), lambda x: x["section"]), "").alias("body"))
    return table(spark, d, "region").join(body, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", F.concat(F.lit("<html><h1>"), "r_name", F.lit("</h1>"), "body", F.lit("</html>")).alias("html"))


SECRET = "token|password|secret|k"


def redacted_traces(spark: SparkSession, d: str) -> DataFrame:
    """Traces as lines of JSON, values of secret-named keys masked at any depth and texts cut to 20 characters.

    The token of each trace holds an escaped quote, and the secret a list.
    """
    nested = F.concat(F.lit('{"a": {"token": "'), "event_id", F.lit('\\" leak", "n": ['), "props", F.lit('], "secret": ["leak", {"k": 1}]}, "note": "'), F.repeat("event_type", 6), F.lit('"}'))
    return redaction.redacted(table(spark, d, "events").select("event_id", nested.alias("trace")), "event_id", "trace", SECRET, 20).withColumnsRenamed({"id": "event_id", "line": "trace"})


def model_costs(spark: SparkSession, d: str) -> DataFrame:
    """Cost of calls in millionths: price by the longest prefix of the model's name, the dearest where none fits.

    Cached tokens cost a tenth, written ones five fourths; halves round to even.
    """
    prices = [("ECON", 3), ("ECONOMY", 2), ("STAND", 5), ("PROMO", 7)]
    price = F.lit(max(p for _, p in prices))
    for prefix, p in sorted(prices, key=lambda x: len(x[0])):
        price = F.when(F.startswith("p_type", F.lit(prefix)), p).otherwise(price)
    p = table(spark, d, "part").select("p_partkey", "p_type", price.alias("price"), F.col("p_size").alias("fresh"), (F.col("p_partkey") % 40).alias("cached"), (F.col("p_partkey") % 6).alias("written"))
    cost = F.bround(F.col("price") * (F.col("fresh") * 20 + F.col("cached") * 2 + F.col("written") * 25) / F.lit(20.0), 0)
    return p.select("p_partkey", cost.cast("long").alias("micro"))


def bm25_route(spark: SparkSession, d: str) -> DataFrame:
    """The 50 best documents for a fixed question by BM25; one pass counts terms and lengths together."""
    terms, k1, b = ["thing", "und", "que", "nation", "with"], 1.2, 0.75
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    t = table(spark, d, "documents").withColumn("w", words)
    times = lambda term: F.size(F.filter("w", lambda x: x == term))
    counts = [times(term).alias(f"t{i}") for i, term in enumerate(terms)]
    t = t.select("doc_id", F.size("w").alias("n"), *counts)
    stats = t.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("avg_n"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.col(f"t{i}").cast("double")
        idf = F.log(F.lit(1.0) + (F.col("docs") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("avg_n")))
    scored = t.join(F.broadcast(stats)).select("doc_id", F.round(score, 6).alias("score")).where("score > 0")
    return scored.orderBy(F.col("score").desc(), "doc_id").limit(50)


def care_items(spark: SparkSession, d: str) -> DataFrame:
    """What to handle with care: LEADS pairs resting on one source, and contested claims; reasons of each as a list."""
    c = claims(spark, d, "claim_id", "kind", "relation", "object", "source_id", "status").where("status <> 'insufficient'")
    lone = c.where("kind = 'relation' AND relation = 'LEADS'").groupBy("relation", "object").agg(F.countDistinct("source_id").alias("n")).where("n = 1").select("relation", "object", F.lit("one_source").alias("lone"))
    j = c.join(lone, ["relation", "object"], "left").withColumn("lone", F.when(F.col("kind") == "relation", F.col("lone")))
    why = F.array_join(F.array_compact(F.array("lone", F.when(F.col("status") == "contested", "sources_disagree"))), ",")
    return j.select("claim_id", why.alias("reasons")).where("reasons <> ''")


def full_gap_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes of gaps by status, with plurals and lists joined by commas and `and`, and a clause for blocked sites."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    s = o.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")))).alias("open"), F.count_if(F.col("o_totalprice") > 400000).alias("blocked"))
    listed = F.when(F.size("open") <= 1, F.array_join("open", "")).otherwise(F.concat(F.array_join(F.slice("open", 1, F.size("open") - 1), ", "), F.lit(" and "), F.element_at("open", -1)))
    note = F.concat(F.when(F.size("open") == 0, "Everything was found").otherwise(F.concat(F.lit("No answer for "), listed, F.lit(" in "), "n", F.when(F.col("n") == 1, " page").otherwise(" pages"))), F.when(F.col("blocked") > 0, F.concat(F.lit("; "), "blocked", F.when(F.col("blocked") == 1, " site refuses robots").otherwise(" sites refuse robots"))).otherwise(""), F.lit("."))
    return s.select("c_nationkey", note.alias("note"))


def read_order(spark: SparkSession, d: str) -> DataFrame:
    """Pages to read of each host: those that name the place first; where a wider fact is held, two others at most."""
    p = table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host"), F.contains("url", F.lit("/en/")).alias("names"))
    w = Window.partitionBy("host").orderBy((~F.col("names")).cast("int"), "page_id")
    others = F.sum((~F.col("names")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    wider = F.length("host") % 2 == 0
    return p.withColumn("others", others).withColumn("place", F.row_number().over(w)).where(F.col("names") | ~wider | (F.col("others") <= 2)).select("page_id", "place")


def stored_verdicts_win(spark: SparkSession, d: str) -> DataFrame:
    """Only claims without a stored verdict are checked anew; a stored one wins over a new one."""
    c = claims(spark, d, "claim_id", "object", "scope_verified")
    stored = table(spark, d, "labels").groupBy(F.col("doc_id").alias("object")).agg(F.max("quality").alias("stored"))
    j = c.join(stored, "object", "left")
    return j.groupBy(F.coalesce(F.col("stored") == 1, F.col("scope_verified")).alias("supported"), F.col("stored").isNotNull().alias("kept")).agg(F.count(F.lit(1)).alias("n"))


def budget_phases(spark: SparkSession, d: str) -> DataFrame:
    """Phase of each user's run by its counters: open, winding down from 85 % of a limit, refusing beyond; one warning a counter."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cost"))
    share = lambda c, limit: F.col(c) / F.lit(float(limit))
    worst = F.greatest(share("calls", 80), share("cost", 150_000))
    warned = F.concat_ws(",", F.when(share("calls", 80) >= 0.85, "calls"), F.when(share("cost", 150_000) >= 0.85, "cost"))
    return e.select("user_id", F.when(worst >= 1, "refuse").when(worst >= 0.85, "wind_down").otherwise("open").alias("phase"), warned.alias("warned"))


def followed_replays(spark: SparkSession, d: str) -> DataFrame:
    """Events after a given one up to the run's first terminal event, with it; runs without one end with their last."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type").where("event_id > 40")
    end = e.where("event_type = 'error'").groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("end"))
    j = e.join(end, "user_id", "left").where("end IS NULL OR ts < end.ts OR (ts = end.ts AND event_id <= end.event_id)")
    return j.groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"), F.bool_or(F.col("event_type") == "error").alias("ended"))


def plan_problems(spark: SparkSession, d: str) -> DataFrame:
    """Problems of planned searches: asked before, twice in the plan, too long, a site that isn't allowed; or none."""
    q = table(spark, d, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("site:s"), F.col("p_partkey") % 3, F.lit(".org"))))).alias("query"))
    before = q.where("p_partkey < 20").select("query").distinct().withColumn("asked", F.lit(True))
    plan = q.where("p_partkey >= 20").withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy("p_partkey"))).join(before, "query", "left")
    why = F.concat_ws(",", F.when(F.col("asked"), "asked_before"), F.when(F.col("k") > 1, "repeated"), F.when(F.length("query") > 18, "too_long"), F.when(F.contains("query", F.lit("site:s2.")), "site"))
    return plan.groupBy(why.alias("problems")).agg(F.count(F.lit(1)).alias("n"))


def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Normalised vectors of 16 places from hashed words: the stand-in for an embedding model. First place and length."""
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.crc32(w.cast("binary")) % 16)
    counts = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    t = table(spark, d, "benchmark").select("item_id", counts.alias("c"))
    length = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x))
    return t.select("item_id", F.array_join(F.transform("c", lambda x: F.format_string("%.4f", F.when(length > 0, x / length).otherwise(0.0))), " ").alias("vector"))


def catalogue_violations(spark: SparkSession, d: str) -> DataFrame:
    """Faults of reference catalogues: codes that come twice, names of unknown groups, ready and pending codes."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("<"), "p_name", F.lit(">"))).otherwise(F.col("p_name")).alias("code"))
    known = [f"Brand#{i}" for i in range(1, 21)]
    twice = p.groupBy("code").agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit("code_twice").alias("rule"), "n")
    rest = p.agg(F.count_if(~F.col("p_brand").isin(*known)).alias("unknown_group"), F.count_if(F.col("code").rlike("^<.*>$")).alias("pending"), F.count_if(~F.col("code").rlike("^<.*>$")).alias("ready"))
    return twice.union(rest.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in ("unknown_group", "pending", "ready")]))))


def flattened_codes(spark: SparkSession, d: str) -> DataFrame:
    """A provider's JSON map of indicators as rows `provider.indicator -> code`."""
    m = F.from_json(F.concat(F.lit('{"i'), F.col("s_suppkey") % 4, F.lit('":"c'), "s_suppkey", F.lit('","j":"'), "s_nationkey", F.lit('"}')), "map<string,string>")
    t = table(spark, d, "supplier").select("s_name", F.explode(m).alias("indicator", "code"))
    return t.select(F.concat_ws(".", "s_name", "indicator").alias("name"), "code")


def failure_figures(spark: SparkSession, d: str) -> DataFrame:
    """Slots answered and open of each city, and its failures by kind, most frequent first, as one list."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    g = e.groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "purchase", F.col("n")).otherwise(0)).alias("answered"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "event_type"))).alias("x"))
    return g.select("user_id", "answered", F.array_join(F.transform("x", lambda s: F.concat(s["event_type"], F.lit(":"), (-s["m"]).cast("string"))), ",").alias("failures"))


def media_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What a fetched body is read as: by type, a PDF by its first bytes, too little text, a password form, a status."""
    p = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("%PDF-1.7 "), "html")).when(F.col("page_id") % 5 == 1, "<form><input type=password></form>").when(F.col("page_id") % 5 == 2, F.substring("html", 1, 80)).otherwise(F.col("html")).alias("body"), F.when(F.col("page_id") % 11 == 0, 404).when(F.col("page_id") % 11 == 1, 429).otherwise(200).alias("http"))
    text = F.regexp_replace("body", "<[^>]*>", "")
    return p.groupBy(F.when(F.col("http") == 404, "unreachable").when(F.col("http") == 429, "blocked_rate").when(F.startswith("body", F.lit("%PDF-")), "pdf").when(F.contains("body", F.lit("type=password")), "blocked_login").when(F.length(text) < 200, "unreadable").otherwise("html").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def number_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that bear numbers, and the longest run of such lines, per source."""
    flags = F.transform(F.split("text", "\n"), lambda x: F.when(x.rlike("[0-9]"), "1").otherwise("0"))
    t = table(spark, d, "documents").select("source", F.array_join(flags, "").alias("f"))
    runs = F.transform(F.regexp_extract_all("f", F.lit("1+"), F.lit(0)), lambda r: F.length(r))
    return t.groupBy("source").agg(F.sum(F.length(F.translate("f", "0", ""))).cast("long").alias("lines"), F.max(F.coalesce(F.array_max(runs), F.lit(0))).cast("long").alias("longest"))


QUERIES = {f.__name__: f for f in (ask_bundle, evidence_lines, retrieval_traces, checked_answers, html_reports, redacted_traces, model_costs, bm25_route, care_items, full_gap_notes, read_order, stored_verdicts_win, budget_phases, followed_replays, plan_problems, hashed_vectors, catalogue_violations, flattened_codes, failure_figures, media_outcomes, number_lines, diverse_bundles)}

_W = f"WITH {CLAIM_SQL}"
_S = "SELECT city_id, claim_id, row_number() OVER (PARTITION BY city_id ORDER BY sampling <> 'census', claim_id) AS rank, 's' AS route FROM claim WHERE (slot IN (2, 5) OR indicator IN (7, 21)) AND status <> 'insufficient'"
_GR = f"SELECT city_id, claim_id, row_number() OVER (PARTITION BY city_id ORDER BY publisher <> 'academic', claim_id) AS rank, 'g' AS route FROM gc LEFT JOIN gm USING (city_id) WHERE named IS NULL OR subject = named"
_B = f"""{_W}, gc AS (SELECT * FROM claim WHERE kind = 'relation' AND relation IN ('LEADS', 'FUNDS', 'RUNS') AND {G._AT}), gm AS (SELECT city_id, min(subject) AS named FROM gc WHERE subject % 3 = 0 GROUP BY ALL),
  r AS (SELECT * FROM ({_S} UNION ALL {_GR}) WHERE rank <= 5), f AS (SELECT city_id, claim_id, round(sum(CAST(1.0 AS DOUBLE) / (60 + rank)), 6) AS score FROM r GROUP BY ALL),
  v AS (SELECT f.*, slot, row_number() OVER (PARTITION BY f.city_id, slot ORDER BY score DESC, claim_id) AS k FROM f JOIN (SELECT claim_id, slot FROM claim WHERE status <> 'insufficient' AND scope_verified) USING (claim_id)),
  b AS (SELECT * FROM (SELECT city_id, claim_id, slot, score, CAST(row_number() OVER (PARTITION BY city_id ORDER BY score DESC, claim_id) AS INT) AS place FROM v WHERE k <= {PER_SLOT}) WHERE place <= {PER_CITY})"""
_BM = ["thing", "und", "que", "nation", "with"]

ORACLES = {
    "diverse_bundles": f"""WITH RECURSIVE {CLAIM_SQL}, i AS (SELECT city_id, slot, claim_id, CASE WHEN status = 'contested' THEN lead(claim_id) OVER (PARTITION BY city_id ORDER BY claim_id % 1000, claim_id) END AS other,
          row_number() OVER (PARTITION BY city_id, slot ORDER BY claim_id) = 1 AND scope_verified AND slot % 5 = 0 AS anchored, row_number() OVER (PARTITION BY city_id ORDER BY claim_id % 1000, claim_id) AS n FROM claim WHERE status <> 'insufficient'),
        j AS (SELECT a.*, b.claim_id AS o_claim, b.slot AS o_slot, b.anchored AS o_anchored FROM i a LEFT JOIN i b ON a.city_id = b.city_id AND a.other = b.claim_id AND a.other <> a.claim_id),
        s AS (SELECT DISTINCT city_id, 0::BIGINT AS n, []::BIGINT[] AS taken, []::INT[] AS slots FROM i
          UNION ALL
          SELECT city_id, n, CASE WHEN fits THEN taken || items ELSE taken END, CASE WHEN fits THEN slots || bound ELSE slots END
          FROM (SELECT *, len(items) > 0 AND len(taken) + len(items) <= 8 AND len(list_filter(bound, lambda x: len(list_filter(slots || bound, lambda y: y = x)) > 2)) = 0 AS fits
            FROM (SELECT s.city_id, j.n, s.taken, s.slots, CASE WHEN list_contains(taken, claim_id) THEN [] WHEN o_claim IS NULL OR list_contains(taken, o_claim) THEN [claim_id] ELSE [claim_id, o_claim] END AS items,
                CASE WHEN anchored THEN [] ELSE [slot] END || CASE WHEN o_claim IS NULL OR list_contains(taken, o_claim) OR o_anchored THEN [] ELSE [o_slot] END AS bound
              FROM s JOIN j ON j.city_id = s.city_id AND j.n = s.n + 1)))
        SELECT city_id, unnest(taken) AS claim_id, CAST(generate_subscripts(taken, 1) AS INT) AS place FROM (SELECT city_id, arg_max(taken, n) AS taken FROM s GROUP BY ALL)""",
    "ask_bundle": f"{_B} SELECT city_id, claim_id, slot, score, place FROM b",
    "evidence_lines": f"""{_B}, l AS (SELECT b.city_id, place, concat_ws(' | ', 'F' || place, level, strftime(ref_end, '%Y'), concat_ws(' ', hundredths::VARCHAR, CASE WHEN hundredths IS NOT NULL THEN unit END), CASE WHEN status = 'contested' THEN 'sources disagree' END) AS line FROM b JOIN claim USING (claim_id))
        SELECT city_id, string_agg(line, chr(10) ORDER BY place) AS lines FROM l GROUP BY ALL""",
    "retrieval_traces": f"""{_B} SELECT r.city_id, '{{"structured":' || count(*) FILTER (WHERE route = 's') || ',"graph":' || count(*) FILTER (WHERE route = 'g') || ',"kept":' || count(b.claim_id) || '}}' AS trace FROM r LEFT JOIN b ON b.city_id = r.city_id AND b.claim_id = r.claim_id GROUP BY r.city_id""",
    "checked_answers": r"""WITH t AS (SELECT conv_id, turn, regexp_split_to_array(trim(text), '[.!?]\s+') AS ss FROM conversations WHERE role = 'assistant'), s AS (SELECT conv_id, turn, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos FROM t),
        w AS (SELECT *, CASE WHEN len(string_split(s, ' ')) > 12 THEN 'too_long' WHEN row_number() OVER (PARTITION BY conv_id, turn, lower(s) ORDER BY pos) > 1 THEN 'repeated' WHEN NOT contains(s, ',') THEN 'uncited' END AS why FROM s)
        SELECT conv_id, turn, count(*) FILTER (WHERE why = 'too_long') AS too_long, count(*) FILTER (WHERE why = 'repeated') AS repeated, count(*) FILTER (WHERE why = 'uncited') AS uncited, round(count(*) FILTER (WHERE why IS NULL) / count(*), 6) AS survival FROM w GROUP BY ALL""",
    "html_reports": """WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer), i AS (SELECT c_nationkey, string_agg('<li>' || c_name || ' &lt;a&amp;b&gt;</li>', '' ORDER BY k) AS items FROM c WHERE k <= 3 GROUP BY ALL),
        s AS (SELECT n_regionkey, string_agg('<h2>' || n_name || '</h2><ol>' || items || '</ol>', '' ORDER BY n_nationkey) AS body FROM nation JOIN i ON c_nationkey = n_nationkey GROUP BY ALL) SELECT r_name, '<html><h1>' || r_name || '</h1>' || body || '</html>' AS html FROM region JOIN s ON n_regionkey = r_regionkey""",
    "redacted_traces": """SELECT event_id, '{"a":{"token":"***","n":[' || regexp_replace(replace(props, ' ', ''), '"k":[^},]*', '"k":"***"') || '],"secret":"***"},"note":"' || substring(repeat(event_type, 6), 1, 20) || CASE WHEN length(event_type) > 3 THEN '..."}' ELSE '"}' END AS trace FROM events""",
    "model_costs": "SELECT p_partkey, CAST(round_even(CASE WHEN starts_with(p_type, 'ECONOMY') THEN 2 WHEN starts_with(p_type, 'STAND') THEN 5 WHEN starts_with(p_type, 'PROMO') THEN 7 WHEN starts_with(p_type, 'ECON') THEN 3 ELSE 7 END * (p_size * 20 + p_partkey % 40 * 2 + p_partkey % 6 * 25) / CAST(20 AS DOUBLE), 0) AS BIGINT) AS micro FROM part",
    "bm25_route": f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '') AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, {', '.join(f"len(list_filter(w, lambda x: x = '{t}'))::DOUBLE AS t{i}" for i, t in enumerate(_BM))} FROM t),
        s AS (SELECT count(*) AS docs, avg(n) AS avg_n, {', '.join(f'count(*) FILTER (WHERE t{i} > 0) AS d{i}' for i in range(5))} FROM c),
        x AS (SELECT doc_id, round({' + '.join(f'ln(1 + (docs - d{i} + CAST(0.5 AS DOUBLE)) / (d{i} + CAST(0.5 AS DOUBLE))) * t{i} * CAST(2.2 AS DOUBLE) / (t{i} + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * n / avg_n))' for i in range(5))}, 6) AS score FROM c, s) FROM x WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50""",
    "care_items": f"""{_W}, c AS (SELECT * FROM claim WHERE status <> 'insufficient'), l AS (SELECT object FROM c WHERE kind = 'relation' AND relation = 'LEADS' GROUP BY 1 HAVING count(DISTINCT source_id) = 1),
        w AS (SELECT claim_id, concat_ws(',', CASE WHEN kind = 'relation' AND relation = 'LEADS' AND object IN (FROM l) THEN 'one_source' END, CASE WHEN status = 'contested' THEN 'sources_disagree' END) AS reasons FROM c) FROM w WHERE reasons <> ''""",
    "full_gap_notes": """WITH s AS (SELECT c_nationkey, count(*) AS n, list_sort(list_distinct(list(o_orderpriority) FILTER (WHERE o_orderstatus = 'P'))) AS op, count(*) FILTER (WHERE o_totalprice > 400000) AS bl FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
        SELECT c_nationkey, CASE WHEN coalesce(len(op), 0) = 0 THEN 'Everything was found' ELSE 'No answer for ' || CASE WHEN len(op) = 1 THEN op[1] ELSE array_to_string(op[1:len(op) - 1], ', ') || ' and ' || op[len(op)] END || ' in ' || n || CASE WHEN n = 1 THEN ' page' ELSE ' pages' END END
          || CASE WHEN bl > 0 THEN '; ' || bl || CASE WHEN bl = 1 THEN ' site refuses robots' ELSE ' sites refuse robots' END ELSE '' END || '.' AS note FROM s""",
    "read_order": """WITH p AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, contains(url, '/en/') AS names FROM pages), w AS (SELECT *, sum((NOT names)::INT) OVER win AS others, CAST(row_number() OVER win AS INT) AS place FROM p WINDOW win AS (PARTITION BY host ORDER BY (NOT names)::INT, page_id))
        SELECT page_id, place FROM w WHERE names OR length(host) % 2 <> 0 OR others <= 2""",
    "stored_verdicts_win": f"{_W}, s AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY ALL) SELECT coalesce(q = 1, scope_verified) AS supported, q IS NOT NULL AS kept, count(*) AS n FROM claim LEFT JOIN s ON doc_id = object GROUP BY ALL",
    "budget_phases": """WITH e AS (SELECT user_id, count(*) / CAST(80 AS DOUBLE) AS a, sum(round(value * 100)::BIGINT) / CAST(150000 AS DOUBLE) AS b FROM events GROUP BY ALL)
        SELECT user_id, CASE WHEN greatest(a, b) >= 1 THEN 'refuse' WHEN greatest(a, b) >= CAST(0.85 AS DOUBLE) THEN 'wind_down' ELSE 'open' END AS phase, concat_ws(',', CASE WHEN a >= CAST(0.85 AS DOUBLE) THEN 'calls' END, CASE WHEN b >= CAST(0.85 AS DOUBLE) THEN 'cost' END) AS warned FROM e""",
    "followed_replays": """WITH e AS (SELECT user_id, event_id, ts, event_type FROM events WHERE event_id > 40), f AS (SELECT user_id, min((ts, event_id)) AS m FROM e WHERE event_type = 'error' GROUP BY ALL)
        SELECT user_id, count(*) AS frames, bool_or(event_type = 'error') AS ended FROM e LEFT JOIN f USING (user_id) WHERE m IS NULL OR (ts, event_id) <= m GROUP BY ALL""",
    "plan_problems": """WITH q AS (SELECT p_partkey, lower(concat_ws(' ', p_name, CASE WHEN p_partkey % 5 = 0 THEN 'site:s' || (p_partkey % 3) || '.org' END)) AS query FROM part), p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY p_partkey) AS k FROM q WHERE p_partkey >= 20)
        SELECT concat_ws(',', CASE WHEN query IN (SELECT query FROM q WHERE p_partkey < 20) THEN 'asked_before' END, CASE WHEN k > 1 THEN 'repeated' END, CASE WHEN length(query) > 18 THEN 'too_long' END, CASE WHEN contains(query, 'site:s2.') THEN 'site' END) AS problems, count(*) AS n FROM p GROUP BY ALL""",
    "catalogue_violations": """WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 9 = 0 THEN '<' || p_name || '>' ELSE p_name END AS code FROM part)
        SELECT 'code_twice' AS rule, count(*) AS n FROM (SELECT code FROM p GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unknown_group', count(*) FILTER (WHERE NOT regexp_full_match(p_brand, 'Brand#([1-9]|1[0-9]|20)')) FROM p UNION ALL SELECT 'pending', count(*) FILTER (WHERE code LIKE '<%') FROM p UNION ALL SELECT 'ready', count(*) FILTER (WHERE code NOT LIKE '<%') FROM p""",
    "flattened_codes": "SELECT s_name || '.i' || (s_suppkey % 4) AS name, 'c' || s_suppkey AS code FROM supplier UNION ALL SELECT s_name || '.j', s_nationkey::VARCHAR FROM supplier",
    "failure_figures": """WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, coalesce(sum(n) FILTER (WHERE event_type = 'purchase'), 0)::BIGINT AS answered, string_agg(event_type || ':' || n, ',' ORDER BY n DESC, event_type) AS failures FROM e GROUP BY ALL""",
    "media_outcomes": """WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '%PDF-1.7 ' || html WHEN 1 THEN '<form><input type=password></form>' WHEN 2 THEN substring(html, 1, 80) ELSE html END AS body, CASE page_id % 11 WHEN 0 THEN 404 WHEN 1 THEN 429 ELSE 200 END AS http FROM pages)
        SELECT CASE WHEN http = 404 THEN 'unreachable' WHEN http = 429 THEN 'blocked_rate' WHEN starts_with(body, '%PDF-') THEN 'pdf' WHEN contains(body, 'type=password') THEN 'blocked_login' WHEN length(regexp_replace(body, '<[^>]*>', '', 'g')) < 200 THEN 'unreadable' ELSE 'html' END AS outcome, count(*) AS n FROM p GROUP BY ALL""",
    "number_lines": """WITH t AS (SELECT source, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '1' ELSE '0' END), '') AS f FROM documents)
        SELECT source, sum(length(replace(f, '0', '')))::BIGINT AS lines, max(coalesce(list_max(list_transform(regexp_extract_all(f, '1+'), lambda r: length(r))), 0))::BIGINT AS longest FROM t GROUP BY ALL""",
}

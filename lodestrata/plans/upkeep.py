"""Writes as change sets: inserts, updates, get-or-create, purge orders, index upkeep; and reads by key or page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators import steps
from lodestrata.sources.claims import CLAIM_SQL, claims
from lodestrata.sources.tables import table


def atomic_inserts(spark: SparkSession, d: str) -> DataFrame:
    """New claims with their statistic and relation rows: none where the claim is stored or comes twice in the batch.

    Stored are the claims of even runs; the batch is every claim keyed by run and slot. Rows added per table.
    """
    c = claims(spark, d, "claim_id", "run_id", "slot", "kind")
    stored = c.where("run_id % 2 = 0").select("run_id", "slot").distinct()
    w = Window.partitionBy("run_id", "slot").orderBy("claim_id")
    new = c.withColumn("rn", F.row_number().over(w)).where("rn = 1").join(stored, ["run_id", "slot"], "left_anti")
    rows = new.select(F.explode(F.array_compact(F.array(F.lit("claim"), F.when(F.col("kind") == "statistic", "statistic"), F.when(F.col("kind") == "relation", "relation")))).alias("into"))
    return rows.groupBy("into").agg(F.count(F.lit(1)).alias("rows"))


def first_of_either_key(spark: SparkSession, d: str) -> DataFrame:
    """Sources by first write, where a row goes if its url or its text has come before (smaller page_id).

    Exactly: a row stays only if it is the first of its url and the first of its text among those that stay; rows that
    lose by one key don't count for the other, so it takes turns until no row is left. Texts go by the digest of the
    whole; what a turn keeps and leaves is stored, so none repeats those before it.
    """
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"), F.sha2("html", 256).alias("text"))
    left = p.where("url IS NOT NULL AND text IS NOT NULL")
    kept = left.limit(0)
    first = lambda key: F.min("page_id").over(Window.partitionBy(key))
    while not left.isEmpty():  # each turn keeps the smallest id left, and as a rule nearly all rows
        both = left.withColumn("u", first("url")).withColumn("t", first("text")).where("page_id = u AND page_id = t").drop("u", "t")
        both = steps.kept(both)
        kept = kept.union(both)
        left = steps.kept(left.join(both.select("url"), "url", "left_anti").join(both.select("text"), "text", "left_anti").select("page_id", "url", "text"))
    return kept.select("page_id")


def keyed_updates(spark: SparkSession, d: str) -> DataFrame:
    """Updates by key: status set where an update exists, the end set only where it is null; counted by outcome."""
    c = claims(spark, d, "claim_id", "status", "valid_to", "source_id")
    u = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("source_id"), F.lit("contested").alias("set_status"), F.lit("2001-01-01").cast("date").alias("set_end"))
    j = c.join(u, "source_id", "left")
    return j.groupBy(F.coalesce("set_status", "status").alias("status"), F.coalesce("valid_to", "set_end").isNull().alias("open")).agg(F.count(F.lit(1)).alias("n"))


def published_pointer(spark: SparkSession, d: str) -> DataFrame:
    """Status writes of runs with their finish stamp; a completed or stopped run moves its city's pointer, a failed one doesn't."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running").alias("status"))
    stamped = o.withColumn("finished_at", F.when(F.col("status") != "running", F.col("o_orderdate") + F.expr("INTERVAL 2 HOURS")))
    done = stamped.where("status = 'completed'").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("finished_at", "o_orderkey")).alias("latest_run"), F.max("finished_at").alias("finished_at"))
    return done.select("o_custkey", "latest_run", F.date_format("finished_at", "yyyy-MM-dd HH").alias("finished"))


def get_or_create(spark: SparkSession, d: str) -> DataFrame:
    """The surviving id of every name: that of the stored row (parts up to 50), else of the first new one."""
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    stored = p.where("p_partkey <= 50").groupBy("name").agg(F.min("p_partkey").alias("stored"))
    new = p.where("p_partkey > 50").groupBy("name").agg(F.min("p_partkey").alias("new"))
    return stored.join(new, "name", "full").select("name", F.coalesce("stored", "new").alias("id"), F.col("stored").isNull().alias("created"))


def purge_order(spark: SparkSession, d: str) -> DataFrame:
    """Rows that deleting a city takes with it, children first, in the order of the stores."""
    gone = table(spark, d, "customer").where("c_custkey % 10 = 3").select("c_custkey")
    runs = table(spark, d, "orders").select("o_custkey", "o_orderkey").join(gone, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    lines = table(spark, d, "lineitem").select("l_orderkey").join(runs, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    count = lambda df, place, name: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(place).alias("place"), F.lit(name).alias("store"), "rows")
    return count(lines, 1, "vectors").union(count(lines, 2, "edges")).union(count(lines, 3, "claims")).union(count(runs, 4, "runs")).union(count(gone, 5, "cities"))


def stored_answers(spark: SparkSession, d: str) -> DataFrame:
    """Appended answers with the digest and the size of their body; over 4,000 bytes they are refused."""
    t = table(spark, d, "conversations").where("role = 'assistant'")
    return t.select("conv_id", "turn", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), (F.octet_length("text") > 4000).alias("refused"))


def verified_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Stored pages against the digest kept with them; every eighth was changed since."""
    p = table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("kept"), F.when(F.col("page_id") % 8 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html")).alias("now"))
    return p.select("page_id", (F.sha2("now", 256) == F.col("kept")).alias("intact"))


def index_changes(spark: SparkSession, d: str) -> DataFrame:
    """What keeps an index in line with its base: rows to add, to change and to delete, and where spans come from."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "source")
    wanted = docs.where("source <> 'src3'").select("doc_id", "n_chars")
    held = docs.where("doc_id % 5 <> 0").select("doc_id", (F.col("n_chars") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("held"))
    j = wanted.join(held, "doc_id", "full")
    change = F.when(F.col("held").isNull(), "add").when(F.col("n_chars").isNull(), "delete").when(F.col("held") != F.col("n_chars"), "change").otherwise("keep")
    origin = F.when(F.col("doc_id") % 4 == 0, "stored").when(F.col("held") == F.col("n_chars"), "reparsed").otherwise("prose")
    return j.groupBy(change.alias("change"), origin.alias("origin")).agg(F.count(F.lit(1)).alias("n"))


def status_gate(spark: SparkSession, d: str) -> DataFrame:
    """Status changes: supported or contested needs a supported verdict, else refused; and what the index does."""
    c = claims(spark, d, "claim_id", "status", "scope_verified", "slot")
    refused = F.col("status").isin("supported", "contested") & ~F.col("scope_verified")
    index = F.when(refused, "none").when(F.col("status") == "insufficient", "delete").otherwise("upsert")
    return c.groupBy("status", refused.alias("refused"), index.alias("index")).agg(F.count(F.lit(1)).alias("n"))


def synced_gazetteer(spark: SparkSession, d: str) -> DataFrame:
    """Sync with a derived column: name keys are made from the input, rows that differ in any column change."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    new = p.where("p_partkey % 9 <> 1").select("p_partkey", "p_name", F.array_join(F.array_sort(F.split(F.lower("p_name"), " ")), " ").alias("keys"), "p_size")
    old = p.where("p_partkey % 9 <> 2").select(F.col("p_partkey").alias("k"), F.struct("p_name", F.when(F.col("p_partkey") % 9 == 3, "stale").otherwise(F.array_join(F.array_sort(F.split(F.lower("p_name"), " ")), " ")), (F.col("p_size") + F.when(F.col("p_partkey") % 9 == 4, 1).otherwise(0)).cast("int")).alias("row"))
    j = new.join(old, F.col("p_partkey") == F.col("k"), "full")
    action = F.when(F.col("k").isNull(), "inserted").when(F.col("p_partkey").isNull(), "deleted").when(~F.struct("p_name", "keys", "p_size").eqNullSafe(F.col("row")), "updated").otherwise("same")
    return j.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


def reference_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the reference tables, and the first of each in order."""
    parts = [table(spark, d, t).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("first")).select(F.lit(t).alias("name"), "n", F.col("first").cast("string")) for t, c in (("region", "r_name"), ("nation", "n_name"), ("supplier", "s_name"), ("part", "p_name"))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def nested_facts(spark: SparkSession, d: str) -> DataFrame:
    """Flat rows as nested claim, labels, verdict and relation, an absent branch null; read back by path, per status."""
    c = claims(spark, d).select(F.struct("claim_id", "status", F.struct("level", "sex", "age_min").alias("labels"), F.when(F.col("scope_verified"), F.struct(F.lit("supported").alias("value"))).alias("verdict"), F.when(F.col("kind") == "relation", F.struct("subject", "relation", "object")).alias("relation")).alias("claim"))
    return c.groupBy("claim.status").agg(F.count("claim.verdict").alias("verdicts"), F.count("claim.relation").alias("relations"), F.count("claim.relation.subject").alias("subjects"), F.max("claim.labels.level").alias("level"))


def joined_facts(spark: SparkSession, d: str) -> DataFrame:
    """Claim with source and, where they exist, statistic, verdict and relation: one row a claim, of the latest runs.

    Counted by source.
    """
    c = claims(spark, d, "claim_id", "city_id", "run_id", "source_id", "kind", "indicator", "object")
    latest = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("city_id")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("run_id"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), "s_name")
    stat = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").cast("int").alias("indicator"), "p_size")
    verdict = table(spark, d, "labels").groupBy(F.col("doc_id").alias("object")).agg(F.max("quality").alias("verdict"))
    relation = c.where("kind = 'relation'").select("claim_id", F.lit(1).alias("relation"))
    j = c.join(latest, ["city_id", "run_id"], "left_semi").join(s, "source_id").join(stat, "indicator", "left").join(verdict, "object", "left").join(relation, "claim_id", "left")
    return j.groupBy("s_name").agg(F.count(F.lit(1)).alias("claims"), F.count("p_size").alias("statistics"), F.count("verdict").alias("verdicts"), F.count("relation").alias("relations"))


def admitted_claims(spark: SparkSession, d: str) -> DataFrame:
    """Why drafts are refused: slot unknown, pair not allowed, quote blank, statement too long, block not of the kind."""
    c = claims(spark, d, "claim_id", "slot", "kind", "relation", "object", "hundredths", "sample_size")
    problems = [("slot", F.col("slot") > 13), ("pair", (F.col("kind") == "relation") & (F.col("relation") == "GOVERNS") & (F.col("object") % 3 != 1)), ("quote", F.col("sample_size").isNull()), ("length", F.coalesce(F.col("sample_size"), F.lit(0)) > 900), ("block", (F.col("kind") == "statistic") & F.col("hundredths").isNull())]
    return c.groupBy(F.array_join(F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in problems])), ",").alias("problems")).agg(F.count(F.lit(1)).alias("n"))


def known_choices(spark: SparkSession, d: str) -> DataFrame:
    """Slots that a classifier names: unknown ones dropped, each once, in order, three at most."""
    known = F.array(*[F.lit(i) for i in range(10)])
    named = F.array((F.col("turn") % 12).cast("int"), (F.col("conv_id") % 14).cast("int"), F.lit(3), (F.col("turn") % 12).cast("int"), F.lit(99), (F.col("conv_id") % 7).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.array_join(F.transform(F.slice(F.array_distinct(F.filter(named, lambda x: F.array_contains(known, x))), 1, 3), lambda x: x.cast("string")), ",").alias("slots"))


def structured_route(spark: SparkSession, d: str) -> DataFrame:
    """Claims of an asked slot or indicator, the five best of each city by sampling and id."""
    c = claims(spark, d, "city_id", "claim_id", "slot", "indicator", "status", "sampling").where("(slot IN (2, 5) OR indicator IN (7, 21)) AND status <> 'insufficient'")
    w = Window.partitionBy("city_id").orderBy(F.col("sampling") != "census", "claim_id")
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("city_id", "claim_id", "rank")


def unlinked_claims(spark: SparkSession, d: str) -> DataFrame:
    """Shown relations and non-count statistics without an edge yet; edges exist for claims of even subjects."""
    c = claims(spark, d, "claim_id", "status", "kind", "unit", "subject").where("status <> 'insufficient' AND (kind = 'relation' OR (kind = 'statistic' AND unit <> 'count'))")
    linked = claims(spark, d, "claim_id", "subject").where("subject % 2 = 0").select("claim_id")
    return c.join(linked, "claim_id", "left_anti").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("claim_id").alias("first"))


def refused_domains(spark: SparkSession, d: str) -> DataFrame:
    """Distinct hosts that a decision blocked."""
    p = table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host"), F.when(F.col("page_id") % 4 == 1, "blocked_robots").when(F.col("page_id") % 4 == 2, "unreachable").otherwise("fetched").alias("outcome"))
    return p.where("outcome LIKE 'blocked%'").select("host").distinct()


def visible_cards(spark: SparkSession, d: str) -> DataFrame:
    """World-level cards of a slot go where the slot has a narrower one, but both sides of a contested pair stay."""
    c = claims(spark, d, "city_id", "slot", "claim_id", "level", "status")
    narrow = c.where("level <> 'global'").select("city_id", "slot").distinct().withColumn("narrow", F.lit(True))
    j = c.join(narrow, ["city_id", "slot"], "left")
    return j.where("level <> 'global' OR narrow IS NULL OR status = 'contested'").groupBy("level", "status").agg(F.count(F.lit(1)).alias("n"))


def admitted_topics(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a word that begins with a stem, or of an exempt source."""
    t = table(spark, d, "documents").select("doc_id", "source", F.lower("text").alias("text"))
    hit = F.col("text").rlike("(^|[^a-z])(thing|rein|tion)") | F.col("source").isin("src0")
    return t.groupBy("source", hit.alias("admitted")).agg(F.count(F.lit(1)).alias("n"))


def unconfirmed_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages that overlap no fact's span of the same source, as half-open intervals.

    Spans of a source are dealt to buckets of 100 characters, so passages meet only those near them.
    """
    li = table(spark, d, "lineitem")
    spans = li.where("l_linenumber = 1").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") * 7).alias("start"), (F.col("l_partkey") * 7 + F.col("l_quantity").cast("long")).alias("end"))
    m = li.where("l_linenumber > 1").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("no"), F.col("l_suppkey").alias("source"), (F.col("l_partkey") * 5).alias("start"), (F.col("l_partkey") * 5 + 20).alias("end"))
    bucket = F.explode(F.sequence(F.floor(F.col("start") / 100), F.floor(F.col("end") / 100))).alias("bucket")
    hits = m.select("*", bucket).join(spans.select("source", F.col("start").alias("s"), F.col("end").alias("e"), bucket), ["source", "bucket"]).where("s < end AND e > start").select("id", "no", "start", "source").distinct()
    return m.join(hits, ["id", "no", "start", "source"], "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def whole_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row of a run's figures from all counts; cost in millionths becomes units of four decimals."""
    c = claims(spark, d, "status", "kind", "hundredths").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("status") == "supported").alias("supported"), F.count_if(F.col("status") == "contested").alias("contested"))
    e = table(spark, d, "events").agg(F.count_if(F.col("event_type") == "error").alias("failures"), F.round(F.sum(F.round(F.col("value") * 100).cast("long")) / F.lit(1_000_000), 4).alias("cost"))
    p = table(spark, d, "pages").agg(F.countDistinct("url").alias("sources"))
    return c.crossJoin(e).crossJoin(p)


def page_cursors(spark: SparkSession, d: str) -> DataFrame:
    """Pages of five with an opaque cursor: the next one only if the page is full and more remain."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn("at", F.row_number().over(w) - 1)
    pages = o.groupBy("o_custkey", F.floor(F.col("at") / 5).alias("page")).agg(F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("first"))
    total = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"))
    offset = (F.col("page") + 1) * 5
    return pages.join(total, "o_custkey").select("o_custkey", "page", "rows", F.when((F.col("rows") == 5) & (offset < F.col("total")), F.base64(offset.cast("string").cast("binary"))).alias("next"))


def url_owners(spark: SparkSession, d: str) -> DataFrame:
    """Source of each url from both its written and its canonical form: of equal canonical ones the first, of equal written ones the last."""
    p = table(spark, d, "pages").select("page_id", "url", F.regexp_replace("url", "[?#].*$", "").alias("canonical"))
    both = p.select(F.col("url").alias("u"), F.lit(1).alias("kind"), F.col("page_id").alias("order"), "page_id").where("u IS NOT NULL").unionByName(p.select(F.col("canonical").alias("u"), F.lit(0).alias("kind"), (-F.col("page_id")).alias("order"), "page_id").where("u IS NOT NULL"))
    return both.groupBy("u").agg(F.max_by("page_id", F.struct("kind", "order")).alias("page_id"))


def golden_scores(spark: SparkSession, d: str) -> DataFrame:
    """Produced rows matched to expected ones by value: recall, accuracy of each field, and whether a bar is met."""
    li = claims(spark, d, "claim_id", "hundredths", "level", "sex", "slot").where("hundredths IS NOT NULL")
    made = li.where("claim_id % 10 <> 0").select("claim_id", F.when(F.col("claim_id") % 7 == 0, "national").otherwise(F.col("level")).alias("got_level"), F.col("sex").alias("got_sex"))
    j = li.join(made, "claim_id", "left")
    s = j.groupBy("slot").agg(F.count(F.lit(1)).alias("expected"), F.count("got_sex").alias("found"), F.count_if(F.col("got_level") == F.col("level")).alias("level_ok"), F.count_if(F.col("got_sex") == F.col("sex")).alias("sex_ok"))
    return s.select("slot", F.round(F.col("found") / F.col("expected"), 6).alias("recall"), F.round((F.col("level_ok") + F.col("sex_ok")) / (2 * F.col("found")), 6).alias("fields"), (F.col("found") / F.col("expected") >= 0.85).alias("passes"))


QUERIES = {f.__name__: f for f in (atomic_inserts, first_of_either_key, keyed_updates, published_pointer, get_or_create, purge_order, stored_answers, verified_snapshots, index_changes, status_gate, synced_gazetteer, reference_counts, nested_facts, joined_facts, admitted_claims, known_choices, structured_route, unlinked_claims, refused_domains, visible_cards, admitted_topics, unconfirmed_passages, whole_summary, page_cursors, url_owners, golden_scores)}

_W = f"WITH {CLAIM_SQL}"
_PROBLEMS = "list_filter([CASE WHEN slot > 13 THEN 'slot' END, CASE WHEN kind = 'relation' AND relation = 'GOVERNS' AND object % 3 <> 1 THEN 'pair' END, CASE WHEN sample_size IS NULL THEN 'quote' END, CASE WHEN sample_size > 900 THEN 'length' END, CASE WHEN kind = 'statistic' AND hundredths IS NULL THEN 'block' END], lambda x: x IS NOT NULL)"
_TURNS = "\n".join(
    f"f{i} AS (SELECT * FROM (SELECT *, min(page_id) OVER (PARTITION BY url) AS a, min(page_id) OVER (PARTITION BY text) AS b FROM l{i}) WHERE page_id = a AND page_id = b), l{i + 1} AS (SELECT page_id, url, text FROM l{i} WHERE url NOT IN (SELECT url FROM f{i}) AND text NOT IN (SELECT text FROM f{i})),"
    for i in range(6)
)

ORACLES = {
    "atomic_inserts": f"""{_W}, n AS (SELECT kind FROM (SELECT *, row_number() OVER (PARTITION BY run_id, slot ORDER BY claim_id) AS rn FROM claim) WHERE rn = 1 AND run_id % 2 <> 0), r AS (SELECT 'claim' AS "into" FROM n UNION ALL SELECT kind FROM n WHERE kind <> 'statement') SELECT "into", count(*) AS "rows" FROM r GROUP BY ALL""",
    "keyed_updates": f"{_W} SELECT CASE WHEN s_suppkey IS NOT NULL THEN 'contested' ELSE status END AS status, (valid_to IS NULL AND s_suppkey IS NULL) AS open, count(*) AS n FROM claim LEFT JOIN supplier ON s_suppkey = source_id AND s_suppkey % 3 = 0 GROUP BY ALL",
    "published_pointer": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_run, strftime(max(o_orderdate) + INTERVAL 2 HOUR, '%Y-%m-%d %H') AS finished FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL",
    "get_or_create": "WITH p AS (SELECT p_partkey AS k, concat_ws(' ', p_name, p_brand) AS name FROM part) SELECT name, coalesce(min(k) FILTER (WHERE k <= 50), min(k)) AS id, count(*) FILTER (WHERE k <= 50) = 0 AS created FROM p GROUP BY ALL",
    "purge_order": """WITH g AS (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3), r AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM g)), l AS (SELECT count(*) AS n FROM lineitem WHERE l_orderkey IN (FROM r))
        SELECT 1 AS place, 'vectors' AS store, n AS "rows" FROM l UNION ALL SELECT 2, 'edges', n FROM l UNION ALL SELECT 3, 'claims', n FROM l UNION ALL SELECT 4, 'runs', count(*) FROM r UNION ALL SELECT 5, 'cities', count(*) FROM g""",
    "stored_answers": "SELECT conv_id, turn, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS bytes, octet_length(encode(text)) > 4000 AS refused FROM conversations WHERE role = 'assistant'",
    "verified_snapshots": "SELECT page_id, page_id % 8 <> 0 AS intact FROM pages",
    "index_changes": """WITH w AS (SELECT doc_id, n_chars FROM documents WHERE source <> 'src3'), h AS (SELECT doc_id, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS held FROM documents WHERE doc_id % 5 <> 0)
        SELECT CASE WHEN held IS NULL THEN 'add' WHEN n_chars IS NULL THEN 'delete' WHEN held <> n_chars THEN 'change' ELSE 'keep' END AS change, CASE WHEN doc_id % 4 = 0 THEN 'stored' WHEN held = n_chars THEN 'reparsed' ELSE 'prose' END AS origin, count(*) AS n FROM w FULL JOIN h USING (doc_id) GROUP BY ALL""",
    "status_gate": f"""{_W} SELECT status, status <> 'insufficient' AND NOT scope_verified AS refused, CASE WHEN status = 'insufficient' THEN 'delete' WHEN scope_verified THEN 'upsert' ELSE 'none' END AS "index", count(*) AS n FROM claim GROUP BY ALL""",
    "synced_gazetteer": "SELECT CASE p_partkey % 9 WHEN 1 THEN 'deleted' WHEN 2 THEN 'inserted' WHEN 3 THEN 'updated' WHEN 4 THEN 'updated' ELSE 'same' END AS action, count(*) AS n FROM part GROUP BY ALL",
    "reference_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, min({c}) AS first FROM {t}" for t, c in (("region", "r_name"), ("nation", "n_name"), ("supplier", "s_name"), ("part", "p_name"))),
    "nested_facts": f"{_W} SELECT status, count(*) FILTER (WHERE scope_verified) AS verdicts, count(*) FILTER (WHERE kind = 'relation') AS relations, count(*) FILTER (WHERE kind = 'relation') AS subjects, max(level) AS level FROM claim GROUP BY ALL",
    "joined_facts": f"""{_W}, r AS (SELECT o_custkey AS city_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id FROM orders GROUP BY ALL), v AS (SELECT doc_id, max(quality) AS verdict FROM labels GROUP BY ALL)
        SELECT s_name, count(*) AS claims, count(p_size) AS statistics, count(verdict) AS verdicts, count(*) FILTER (WHERE kind = 'relation') AS relations FROM claim JOIN r USING (city_id, run_id) JOIN supplier ON s_suppkey = source_id LEFT JOIN part ON p_partkey = indicator AND p_size > 10 LEFT JOIN v ON v.doc_id = object GROUP BY ALL""",
    "admitted_claims": f"{_W} SELECT array_to_string({_PROBLEMS}, ',') AS problems, count(*) AS n FROM claim GROUP BY ALL",
    "known_choices": """WITH n AS (SELECT conv_id, turn, role, list_filter([turn % 12, conv_id % 14, 3, turn % 12, 99, conv_id % 7], lambda x: x < 10) AS l FROM conversations)
        SELECT conv_id, turn, role, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:3], ',') AS slots FROM n""",
    "structured_route": f"{_W}, r AS (SELECT city_id, claim_id, CAST(row_number() OVER (PARTITION BY city_id ORDER BY sampling <> 'census', claim_id) AS INT) AS rank FROM claim WHERE (slot IN (2, 5) OR indicator IN (7, 21)) AND status <> 'insufficient') FROM r WHERE rank <= 5",
    "unlinked_claims": f"{_W} SELECT kind, count(*) AS n, min(claim_id) AS first FROM claim WHERE status <> 'insufficient' AND (kind = 'relation' OR (kind = 'statistic' AND unit <> 'count')) AND subject % 2 <> 0 GROUP BY ALL",
    "refused_domains": "SELECT DISTINCT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages WHERE page_id % 4 = 1",
    "visible_cards": f"{_W}, m AS (SELECT *, bool_or(level <> 'global') OVER (PARTITION BY city_id, slot) AS narrow FROM claim) SELECT level, status, count(*) AS n FROM m WHERE level <> 'global' OR NOT narrow OR status = 'contested' GROUP BY ALL",
    "admitted_topics": "SELECT source, regexp_matches(lower(text), '(^|[^a-z])(thing|rein|tion)') OR source = 'src0' AS admitted, count(*) AS n FROM documents GROUP BY ALL",
    "unconfirmed_passages": """WITH s AS (SELECT l_suppkey AS source, l_partkey * 7 AS s, l_partkey * 7 + l_quantity::BIGINT AS e FROM lineitem WHERE l_linenumber = 1), m AS (SELECT l_suppkey AS source, l_partkey * 5 AS b, l_partkey * 5 + 20 AS f FROM lineitem WHERE l_linenumber > 1)
        SELECT source, count(*) AS n FROM m WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.source = m.source AND s < f AND e > b) GROUP BY ALL""",
    "whole_summary": f"""{_W}, c AS (SELECT count(*) AS claims, count(*) FILTER (WHERE status = 'supported') AS supported, count(*) FILTER (WHERE status = 'contested') AS contested FROM claim), e AS (SELECT count(*) FILTER (WHERE event_type = 'error') AS failures, round(sum(round(value * 100)::BIGINT) / 1000000, 4) AS cost FROM events)
        SELECT *, (SELECT count(DISTINCT url) FROM pages) AS sources FROM c, e""",
    "page_cursors": """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders)
        SELECT o_custkey, pos // 5 AS page, count(*) AS "rows", CASE WHEN count(*) = 5 AND (pos // 5 + 1) * 5 < total THEN base64(encode(((pos // 5 + 1) * 5)::VARCHAR)) END AS next FROM o GROUP BY o_custkey, pos // 5, total""",
    "url_owners": """WITH p AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS c FROM pages WHERE url IS NOT NULL), b AS (SELECT url AS u, 1 AS kind, page_id AS ord, page_id FROM p UNION ALL SELECT c, 0, -page_id, page_id FROM p)
        SELECT u, arg_max(page_id, (kind, ord)) AS page_id FROM b GROUP BY ALL""",
    "golden_scores": f"""{_W}, s AS (SELECT slot, count(*) AS expected, count(*) FILTER (WHERE claim_id % 10 <> 0) AS found, count(*) FILTER (WHERE claim_id % 10 <> 0 AND (claim_id % 7 <> 0 OR level = 'national')) AS lv FROM claim WHERE hundredths IS NOT NULL GROUP BY ALL)
        SELECT slot, round(found / expected, 6) AS recall, round((lv + found) / (2 * found), 6) AS fields, found / expected >= 0.85 AS passes FROM s""",
    "first_of_either_key": f"WITH l0 AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url, sha256(html) AS text FROM pages WHERE url IS NOT NULL AND html IS NOT NULL), {_TURNS} r AS (SELECT page_id FROM f0 UNION ALL SELECT page_id FROM f1 UNION ALL SELECT page_id FROM f2 UNION ALL SELECT page_id FROM f3 UNION ALL SELECT page_id FROM f4 UNION ALL SELECT page_id FROM f5) FROM r",
}

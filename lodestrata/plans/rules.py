"""Decision rules: crawl permission, geography, entities, gates, thresholds, notes, spacing, tables and quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import values as V
from lodestrata.functions.quotes import align_pairs
from lodestrata.operators import passages, robots
from lodestrata.sources.tables import table

#: Fixed values of the queries: path patterns (`*` any, `$` end), denied domains, and threshold rules in order.
ROBOTS = [("/", True), ("/en/", False), ("/en/1*", True), ("/*.html$", False), ("/de/2", True)]
DENIED = ["spam-farm.example.org", "cheap-pills.example.com", "example.net"]
THRESHOLDS = [("brass", "(?i)brass"), ("steel_large", "(?i)steel$"), ("polished", "(?i)polished"), ("promo", "(?i)^promo")]


def robots_rule(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the longest matching pattern allows the path; allow wins ties, no match allows."""
    out = F.lit(True)
    for pattern, allowed in sorted(rules, key=lambda r: (len(r[0]), r[1])):
        open_end = not pattern.endswith("$")
        plain = "".join(".*" if c == "*" else "\\" + c if c in ".?+()[]{}|^$\\" else c for c in pattern.removesuffix("$"))
        out = F.when(path.rlike(f"(?s)^{plain}" + ("" if open_end else "\\z")), F.lit(allowed)).otherwise(out)
    return out


def robots_decisions(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[^:]+://[^/?#]*([^#]*)", 1)
    return table(spark, d, "pages").select("page_id", robots_rule(path, ROBOTS).alias("allowed"))


#: Files of hosts, by the length of the host's name: what both engines read. Agent, and its product token.
_FILES = [
    "# all may\nUser-agent: *\nDisallow: /fr/\nAllow: /fr/1\n\nuser-agent: ResearchBot\nUSER-AGENT: other\nDisallow: /en/ # not here\nAllow: /en/1*5$\nCrawl-delay: 2\n",
    "Disallow: /\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /*7\nDisallow: /de\nAllow: /de/2\n",
    "User-agent: researchbot\nDisallow: /es/\nUser-agent: third\nDisallow: /\nUser-agent: ResearchBot\nDisallow: /*9$\nAllow: /*9$\n",
]
AGENT, TOKEN = "ResearchBot/1.0 (+https://example.org/bot)", "researchbot"


def robots_file_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Whether each page's path may be fetched, by the robots file of its host: groups, agents, status, longest match."""
    host, path = F.regexp_extract("url", r"^[^:]+://([^/?#]*)", 1), F.regexp_extract("url", r"^[^:]+://[^/?#]*([^#]*)", 1)
    urls = table(spark, d, "pages").select("page_id", host.alias("site"), path.alias("path"))
    n = F.length("site")
    body, status = F.element_at(F.array(*map(F.lit, _FILES)), n % 3 + 1), F.element_at(F.array(*map(F.lit, (200, 200, 200, 404, 429, None, 503))), n % 7 + 1)
    files = urls.select("site").distinct().select("site", status.alias("status"), body.alias("body"))
    return robots.decisions(urls, files, AGENT).select("page_id", "why", "allowed")


def denied_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose host or one of its parent domains is denied."""
    host = V.url_host(F.col("url"))
    hit = F.lit(False)
    for domain in DENIED:
        hit = hit | (host == domain) | host.endswith("." + domain)
    return table(spark, d, "pages").where(hit).select("page_id")


def geography_fit(spark: SparkSession, d: str) -> DataFrame:
    """Relation of each line's supplier to its customer's place, by ordered rules, counted."""
    li, o = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c, s = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    j = j.join(n.select(F.col("n_nationkey").alias("cn"), F.col("n_regionkey").alias("cr")), F.col("c_nationkey") == F.col("cn")).join(n.select(F.col("n_nationkey").alias("sn"), F.col("n_regionkey").alias("sr")), F.col("s_nationkey") == F.col("sn"))
    fit = F.when(F.col("c_acctbal") < 0, "unresolved").when(F.col("cn") == F.col("sn"), "city").when((F.col("cr") == F.col("sr")) & (F.abs(F.col("cn") - F.col("sn")) <= 5), "nearby").when(F.col("cr") == F.col("sr"), "contains_city").otherwise("elsewhere")
    return j.groupBy(fit.alias("fit")).agg(F.count(F.lit(1)).alias("n"))


def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Parts with the same set of words are one entity: smallest id, number of surface forms. Free of any order."""
    words = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.lower("p_name"), "[^a-z0-9]+"), lambda w: w != ""))), "-")
    return table(spark, d, "part").groupBy(words.alias("key")).agg(F.min("p_partkey").alias("entity"), F.countDistinct("p_name").alias("forms"), F.count(F.lit(1)).alias("n"))


def initials(spark: SparkSession, d: str) -> DataFrame:
    """Acronyms of part types, with how many different types each would name: kept only if unambiguous."""
    a = F.array_join(F.transform(F.split("p_type", " +"), lambda w: F.substring(w, 1, 1)), "")
    return table(spark, d, "part").groupBy(a.alias("acronym")).agg(F.countDistinct("p_type").alias("types"), F.min("p_type").alias("first"))


def numbers_gate(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of an assistant's turn that the turn before doesn't have."""
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9]+"), F.lit(0)))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = table(spark, d, "conversations").withColumn("before", F.lag("text").over(w)).where("role = 'assistant'")
    return t.select("conv_id", "turn", F.size(F.array_except(numbers(F.col("text")), numbers(F.col("before")))).cast("long").alias("unsupported"))


def table_spans(spark: SparkSession, d: str) -> DataFrame:
    """Maximal runs of consecutive lines with a bar, as half-open spans of code points, per document."""
    # Runs and what lies between them come from one pattern each; offsets are sums over a document's few runs.
    run = "(?md)^[^\n]*[|][^\n]*(?:\n[^\n]*[|][^\n]*)*"
    t = table(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(run), F.lit(0)).alias("runs"), F.split("text", run, -1).alias("gaps")).where("size(runs) > 0")
    t = t.select("doc_id", F.transform("runs", lambda r: F.struct(F.length(r).cast("long").alias("n"), (F.regexp_count(r, F.lit("\n")) + 1).cast("long").alias("lines"))).alias("runs"), F.transform("gaps", lambda g: F.length(g).cast("long")).alias("gaps"))
    start = F.transform("runs", lambda r, i: F.struct((F.aggregate(F.slice("gaps", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x) + F.aggregate(F.slice("runs", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["n"])).alias("at"), r.alias("run")))
    return t.select("doc_id", F.explode(start).alias("s")).select("doc_id", F.col("s.at").alias("span_start"), (F.col("s.at") + F.col("s.run.n")).alias("span_end"), F.col("s.run.lines").alias("lines"))


def top_windows(spark: SparkSession, d: str) -> DataFrame:
    """Two windows of each document with most hits of a term, the earlier of equal ones, in document order."""
    size = 1000
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(size))
    pieces = F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring("text", s + 1, F.lit(size)).alias("piece")))
    w = table(spark, d, "documents").select("doc_id", F.inline(pieces))
    hits = F.regexp_count(F.lower("piece"), F.lit("[^a-z](the|la|der|el)[^a-z]"))
    best = Window.partitionBy("doc_id").orderBy(F.col("hits").desc(), "start")
    kept = w.select("doc_id", F.col("start").cast("long").alias("start"), hits.cast("long").alias("hits")).withColumn("rn", F.row_number().over(best)).where("rn <= 2")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("start"))).drop("rn")


def partial_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates written as year, month or day: first and last day, and precision."""
    o = table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    first = F.to_date(F.when(F.length(text) == 4, F.concat(text, F.lit("-01-01"))).when(F.length(text) == 7, F.concat(text, F.lit("-01"))).otherwise(text))
    last = F.when(F.length(text) == 4, F.make_date(F.year(first), F.lit(12), F.lit(31))).when(F.length(text) == 7, F.last_day(first)).otherwise(first)
    precision = F.when(F.length(text) == 4, "year").when(F.length(text) == 7, "month").otherwise("day")
    return o.select("o_orderkey", first.alias("first_day"), last.alias("last_day"), precision.alias("precision"))


def gap_notes(spark: SparkSession, d: str) -> DataFrame:
    """A sentence on what is missing, per nation, from its counts."""
    c, n = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_name")
    o = table(spark, d, "orders").select("o_custkey").distinct()
    j = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.count_if(F.col("o_custkey").isNull()).alias("gaps"), F.count(F.lit(1)).alias("all"))
    note = F.when(F.col("gaps") == 0, F.concat("n_name", F.lit(": complete"))).otherwise(F.concat("n_name", F.lit(": "), "gaps", F.when(F.col("gaps") == 1, " customer").otherwise(" customers"), F.lit(" of "), "all", F.lit(" without an answer")))
    return j.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", note.alias("note"))


def threshold_rules(spark: SparkSession, d: str) -> DataFrame:
    """First rule of the table that a type matches; none as `other`."""
    rule = F.coalesce(*[F.when(F.col("p_type").rlike(p), F.lit(n)) for n, p in THRESHOLDS], F.lit("other"))
    return table(spark, d, "part").groupBy(rule.alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_type").alias("types"))


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Priorities coerced to a closed vocabulary, forgiving case, blanks and dashes; blank as not_stated."""
    word = F.regexp_replace(F.lower(F.trim(F.regexp_replace("o_orderpriority", "^[0-9]-", ""))), "[ -]+", "_")
    known = F.when(word == "", "not_stated").when(word.isin("urgent", "high", "medium", "low", "not_specified"), word).otherwise("problem")
    return table(spark, d, "orders").groupBy(known.alias("word")).agg(F.count(F.lit(1)).alias("n"))


def domain_spacing(spark: SparkSession, d: str) -> DataFrame:
    """When each user's requests may start if two must be ten minutes apart.

    start(i) = max(asked(i), start(i - 1) + gap) has the closed form i * gap + max over j <= i of (asked(j) - j * gap).
    """
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").alias("asked"), F.row_number().over(w).alias("i"), "ts")
    start = F.col("i") * 600 + F.max(F.col("asked") - F.col("i") * 600).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return e.select("event_id", start.cast("long").alias("start"), (start - F.col("asked")).cast("long").alias("waited"))


def quote_align(spark: SparkSession, d: str) -> DataFrame:
    """Passages found in documents through their normalised form, with exact spans in the text as it is.

    Pairs are those that share a run of three of the quote's words in plain letters (signs and marks apart), so that
    typographic variants are among them; only these are aligned.
    """
    bare = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}\s]+", ""))
    docs = table(spark, d, "documents").select("doc_id", "text", bare(F.col("text")).alias("flat"))
    quotes = table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("quote"), bare(F.col("text")).alias("flat_quote"))
    pairs = passages.candidates(docs, quotes, "flat", "flat_quote", "doc_id", "item_id").select("doc_id", "item_id", "text", "quote", F.lit(None).cast("string").alias("value"))
    return align_pairs(pairs).where("drop_reason IS NULL").drop("drop_reason")


def draft_claims(spark: SparkSession, d: str) -> DataFrame:
    """Drafts become claims or are dropped for the first reason: quote not aligned, value not in it, place or period not stated.

    A draft quotes the words 3 to 14 of a benchmark passage and gives a value; it is tried on the documents that share a
    run of three of its words.
    """
    bare = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}\s]+", ""))
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text", bare(F.col("text")).alias("flat"))
    words = F.array_join(F.slice(F.split("text", r"\s+"), 3, 12), " ")
    drafts = table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), words.alias("quote"), bare(words).alias("flat_quote"), F.when(F.col("item_id") % 5 == 0, F.concat(F.col("item_id"), F.lit("%"))).alias("value"))
    pairs = passages.candidates(docs, drafts, "flat", "flat_quote", "doc_id", "item_id")
    found = align_pairs(pairs.select("doc_id", "item_id", "text", "quote", "value"))
    gated = found.join(docs.select("doc_id", "lang", "n_chars"), "doc_id")
    why = F.coalesce("drop_reason", F.when(F.col("lang") == "es", "place_not_stated"), F.when(F.col("n_chars") % 7 == 0, "period_not_stated"))
    return gated.select("doc_id", "item_id", "span_start", "span_end", why.alias("drop_reason"))


QUERIES = {f.__name__: f for f in (robots_decisions, robots_file_decisions, denied_hosts, geography_fit, entity_resolution, initials, numbers_gate, table_spans, top_windows, partial_dates, gap_notes, threshold_rules, vocabulary, domain_spacing, quote_align, draft_claims)}

_BODY = "CASE length(site) % 3 " + " ".join("WHEN {} THEN '{}'".format(i, b.replace("\n", "' || chr(10) || '")) for i, b in enumerate(_FILES)) + " END"

ORACLES = {
    "robots_file_decisions": rf"""WITH u AS (SELECT page_id, regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS site, regexp_extract(url, '^[^:]+://[^/?#]*([^#]*)', 1) AS path FROM pages),
        f AS (SELECT site, CASE length(site) % 7 WHEN 3 THEN 'unavailable' WHEN 4 THEN 'unreachable' WHEN 5 THEN 'unreachable' WHEN 6 THEN 'unreachable' ELSE 'parsed' END AS why, {_BODY} AS body FROM (SELECT DISTINCT site FROM u)),
        l AS (SELECT site, generate_subscripts(x, 1) AS n, trim(split_part(unnest(x), '#', 1)) AS line FROM (SELECT site, string_split(body, chr(10)) AS x FROM f WHERE why = 'parsed')),
        k AS (SELECT site, n, lower(trim(split_part(line, ':', 1))) AS field, trim(substring(line, instr(line, ':') + 1)) AS value FROM l WHERE contains(line, ':')),
        b AS (SELECT *, field = 'user-agent' AND coalesce(lag(field) OVER (PARTITION BY site ORDER BY n), '') <> 'user-agent' AS begins FROM k),
        g AS (SELECT *, sum(begins::INT) OVER (PARTITION BY site ORDER BY n) AS grp FROM b),
        a AS (SELECT site, grp, max(CASE WHEN lower(value) = '{TOKEN}' THEN 2 WHEN value = '*' THEN 1 END) AS fit FROM g WHERE grp > 0 AND field = 'user-agent' GROUP BY ALL),
        c AS (SELECT site, grp FROM a QUALIFY fit = max(fit) OVER (PARTITION BY site)),
        r AS (SELECT site, field = 'allow' AS allows, length(replace(rtrim(value, '$'), '*', '')) AS weight, '^' || replace(regexp_replace(rtrim(value, '$'), '([.?+()])', '\\\1', 'g'), '*', '.*') || CASE WHEN ends_with(value, '$') THEN '$' ELSE '' END AS pattern
          FROM g JOIN c USING (site, grp) WHERE field IN ('allow', 'disallow') AND value <> ''),
        m AS (SELECT page_id, arg_max(allows, weight * 2 + allows::INT) AS allows FROM u JOIN r USING (site) WHERE regexp_matches(path, pattern) GROUP BY ALL)
        SELECT page_id, why, CASE WHEN why = 'parsed' THEN coalesce(allows, true) ELSE why = 'unavailable' END AS allowed FROM u JOIN f USING (site) LEFT JOIN m USING (page_id)""",
    "robots_decisions": """SELECT page_id, CASE WHEN regexp_matches(p, '^/.*\\.html$') THEN false WHEN regexp_matches(p, '^/en/1') THEN true WHEN regexp_matches(p, '^/de/2') THEN true
        WHEN starts_with(p, '/en/') THEN false ELSE true END AS allowed FROM (SELECT page_id, regexp_extract(url, '^[^:]+://[^/?#]*([^#]*)', 1) AS p FROM pages)""",
    "denied_hosts": "SELECT page_id FROM (SELECT page_id, lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)) AS h FROM pages) WHERE " + " OR ".join(f"h = '{x}' OR h LIKE '%.{x}'" for x in DENIED),
    "geography_fit": """SELECT CASE WHEN c_acctbal < 0 THEN 'unresolved' WHEN a.n_nationkey = b.n_nationkey THEN 'city' WHEN a.n_regionkey = b.n_regionkey AND abs(a.n_nationkey - b.n_nationkey) <= 5 THEN 'nearby' WHEN a.n_regionkey = b.n_regionkey THEN 'contains_city' ELSE 'elsewhere' END AS fit, count(*) AS n
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey GROUP BY 1""",
    "entity_resolution": "SELECT key, min(p_partkey) AS entity, count(DISTINCT p_name) AS forms, count(*) AS n FROM (SELECT *, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w <> ''))), '-') AS key FROM part) GROUP BY 1",
    "initials": "SELECT array_to_string(list_transform(regexp_split_to_array(p_type, ' +'), lambda w: substr(w, 1, 1)), '') AS acronym, count(DISTINCT p_type) AS types, min(p_type) AS first FROM part GROUP BY 1",
    "numbers_gate": """SELECT conv_id, turn, CAST(len(list_filter(list_distinct(regexp_extract_all(text, '[0-9]+')), lambda x: NOT list_contains(regexp_extract_all(coalesce(b, ''), '[0-9]+'), x))) AS BIGINT) AS unsupported
        FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS b FROM conversations) WHERE role = 'assistant'""",
    "table_spans": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
        m AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, sum(CASE WHEN contains(line, '|') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY no) AS g FROM l)
        SELECT doc_id, CAST(min(off) AS BIGINT) AS span_start, CAST(max(off + length(line)) AS BIGINT) AS span_end, count(*) AS lines FROM m WHERE contains(line, '|') GROUP BY doc_id, g""",
    "top_windows": """WITH w AS (SELECT doc_id, s AS start, CAST(len(regexp_extract_all(lower(substr(text, s + 1, 1000)), '[^a-z](the|la|der|el)[^a-z]')) AS BIGINT) AS hits FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1000)) AS s FROM documents)),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, start) AS rn FROM w)
        SELECT doc_id, start, hits, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) AS INT) AS place FROM k WHERE rn <= 2""",
    "partial_dates": """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(date_trunc('year', d) AS DATE) WHEN 1 THEN CAST(date_trunc('month', d) AS DATE) ELSE d END AS first_day,
        CASE o_orderkey % 3 WHEN 0 THEN make_date(year(d), 12, 31) WHEN 1 THEN last_day(d) ELSE d END AS last_day, CASE o_orderkey % 3 WHEN 0 THEN 'year' WHEN 1 THEN 'month' ELSE 'day' END AS precision FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "gap_notes": """SELECT n_name, CASE WHEN g = 0 THEN n_name || ': complete' ELSE n_name || ': ' || g || CASE WHEN g = 1 THEN ' customer' ELSE ' customers' END || ' of ' || a || ' without an answer' END AS note
        FROM (SELECT c_nationkey, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS g, count(*) AS a FROM customer GROUP BY 1) JOIN nation ON n_nationkey = c_nationkey""",
    "threshold_rules": "SELECT CASE WHEN regexp_matches(p_type, '(?i)brass') THEN 'brass' WHEN regexp_matches(p_type, '(?i)steel$') THEN 'steel_large' WHEN regexp_matches(p_type, '(?i)polished') THEN 'polished' WHEN regexp_matches(p_type, '(?i)^promo') THEN 'promo' ELSE 'other' END AS rule, count(*) AS n, count(DISTINCT p_type) AS types FROM part GROUP BY 1",
    "vocabulary": "SELECT CASE WHEN w = '' THEN 'not_stated' WHEN w IN ('urgent', 'high', 'medium', 'low', 'not_specified') THEN w ELSE 'problem' END AS word, count(*) AS n FROM (SELECT regexp_replace(lower(trim(regexp_replace(o_orderpriority, '^[0-9]-', ''))), '[ -]+', '_', 'g') AS w FROM orders) GROUP BY 1",
    "domain_spacing": """SELECT event_id, CAST(s AS BIGINT) AS start, CAST(s - asked AS BIGINT) AS waited FROM (SELECT *, i * 600 + max(asked - i * 600) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
        (SELECT user_id, event_id, ts, epoch_us(ts - TIMESTAMP '2024-01-01') // 1000000 AS asked, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events))""",
}

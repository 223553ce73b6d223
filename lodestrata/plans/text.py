"""Text, url, date and number normalisation over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import values as V
from lodestrata.functions import windows as token_budget
from lodestrata.functions.chunking import chunk_documents
from lodestrata.operators import passages
from lodestrata.plans.retrieval import CANONICAL
from lodestrata.sources.tables import table


def parse_value(spark: SparkSession, d: str) -> DataFrame:
    """Numbers written in four ways, read back."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_discount") * 100).cast("int").alias("pc"))
    written = F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.col("q").cast("string"), F.lit(",5"))).when(F.col("l_linenumber") % 4 == 1, F.concat(F.col("q").cast("string"), F.lit(".000"))).when(F.col("l_linenumber") % 4 == 2, F.concat(F.lit("0."), F.col("pc").cast("string"))).otherwise(F.concat(F.lit("about "), F.col("q").cast("string")))
    return li.select("l_orderkey", "l_linenumber", written.alias("written"), V.plain_number(written).cast("double").alias("value"))


def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", V.canonical_url(F.col("url")).alias("address"))


KNOWN = {"example.org": "reference", "spam-farm.example.org": "spam"}


def publisher_class(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(V.url_host(F.col("url")).alias("host"))
    return p.groupBy(V.publisher_class(F.col("host"), KNOWN).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("host").alias("hosts"))


def html_lang_date(spark: SparkSession, d: str) -> DataFrame:
    """Primary language subtag, and whether the title is repeated as a heading."""
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract(html, r"<html[^>]*lang=\"([A-Za-z]+)", 1)).alias("lang"), F.regexp_extract(html, r"<title>([^<]*)</title>", 1).alias("title"), (F.regexp_extract(html, r"<h1>([^<]*)</h1>", 1) == F.regexp_extract(html, r"<title>([^<]*)</title>", 1)).alias("repeated"))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", V.token_estimate(F.col("text")).alias("tokens"))


WINDOW, OVERLAP = 1200, 200


def windows(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping windows of each whole text with exact half-open spans of code points."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.length("text") - 1, F.lit(0)).cast("long"), F.lit(WINDOW - OVERLAP).cast("long"))
    pieces = F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring("text", (s + 1).cast("int"), F.lit(WINDOW)).alias("piece")))
    w = table(spark, d, "documents").select("doc_id", F.inline(pieces))
    return w.select("doc_id", "start", (F.col("start") + F.length("piece")).cast("long").alias("end"), F.sha2("piece", 256).alias("digest"))


#: Tokens of an extraction window, and tokens that two may share.
TOKENS, SHARED = 120, 20


def token_windows(spark: SparkSession, d: str) -> DataFrame:
    """Extraction windows of every document by tokens, cut between words, with spans and the digest of their text."""
    w = table(spark, d, "documents").select("doc_id", "text", F.posexplode(token_budget.token_windows(F.col("text"), TOKENS, SHARED)).alias("no", "w"))
    piece = F.substring(F.col("text"), F.col("w.begin") + 1, F.col("w.end") - F.col("w.begin"))
    return w.select("doc_id", "no", F.col("w.begin").alias("span_start"), F.col("w.end").alias("span_end"), F.col("w.quarters").alias("quarters"), F.sha2(piece, 256).alias("digest"))


def chunk_docs(spark: SparkSession, d: str) -> DataFrame:
    """Sentences packed into chunks; see functions.chunking."""
    return chunk_documents(table(spark, d, "documents").select("doc_id", "text"))


def quote_locate(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages found in documents word for word, with 0-based offsets."""
    b, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    at = F.instr(F.col("text"), F.col("quote"))
    met = passages.candidates(docs.select("doc_id", "text"), b.select("item_id", F.col("text").alias("quote")), "text", "quote", "doc_id", "item_id")
    return met.where(at > 0).select("doc_id", "item_id", (at - 1).cast("long").alias("span_start"), (at - 1 + F.length("quote")).cast("long").alias("span_end"))


def entity_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", V.entity_key(F.concat(F.lit("The "), F.col("p_name"))).alias("key"))


def period_months(spark: SparkSession, d: str) -> DataFrame:
    """Whole months between order and shipping, and the date at month precision."""
    o, li = table(spark, d, "orders").select("o_orderkey", "o_orderdate"), table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", V.months_apart(F.to_date("o_orderdate"), F.to_date("l_shipdate")).cast("long").alias("months"), F.date_format("l_shipdate", "yyyy-MM").alias("month"))


def distances(spark: SparkSession, d: str) -> DataFrame:
    """Great-circle distance of suppliers at made-up places from their nation's centre."""
    s = table(spark, d, "supplier")
    lat, lon = (F.col("s_suppkey") % 170 - 85).cast("double"), (F.col("s_suppkey") * 7 % 360 - 180).cast("double")
    nlat, nlon = (F.col("s_nationkey") * 3 - 40).cast("double"), (F.col("s_nationkey") * 14 - 170).cast("double")
    return s.select("s_suppkey", F.round(V.haversine_km(lat, lon, nlat, nlon), 3).alias("km"))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", V.stable_id("evt", F.col("user_id").cast("string"), F.col("event_type"), F.col("event_id").cast("string")).alias("id"))


def repeated_names(spark: SparkSession, d: str) -> DataFrame:
    """Titles folded by collapsed lower case, with how often each occurs."""
    t = table(spark, d, "pages").select(V.collapse(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)).alias("name"))
    return t.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (parse_value, canonical_url, publisher_class, html_lang_date, token_estimate, windows, token_windows, chunk_docs, quote_locate, entity_key, period_months, distances, stable_ids, repeated_names)}

_WRITTEN = "CASE l_linenumber % 4 WHEN 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ',5' WHEN 1 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.000' WHEN 2 THEN '0.' || CAST(round(l_discount * 100) AS INT) ELSE 'about ' || CAST(l_quantity AS BIGINT) END"
_HOST = "lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1))"

_ASCII, _WIDE = r"[^\x{00}-\x{7F}]", r"[^\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]"

ORACLES = {
    "token_windows": rf"""WITH RECURSIVE p AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '\s*\S+|\s+$') AS x FROM documents),
        q AS (SELECT doc_id, unnest(x) AS piece, generate_subscripts(x, 1) AS i FROM p),
        c AS (SELECT doc_id, i, length(piece) AS size, 2 * length(piece) - length(regexp_replace(piece, '{_ASCII}', '', 'g')) + 2 * length(regexp_replace(piece, '{_WIDE}', '', 'g')) AS cost FROM q),
        w AS MATERIALIZED (SELECT doc_id, i, cost, (sum(size) OVER o)::BIGINT AS ends, (sum(cost) OVER o)::BIGINT AS upto, max(i) OVER (PARTITION BY doc_id) AS words FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        r AS (SELECT doc_id, 0::BIGINT AS no, 1::BIGINT AS b, 0::BIGINT AS before, 0::BIGINT AS begins, words FROM w WHERE i = 1
          UNION ALL
          SELECT doc_id, no + 1, b2, upto, ends, words FROM (SELECT y.*, w.upto, w.ends FROM (
              SELECT x.*, CASE WHEN m IS NOT NULL AND (SELECT upto FROM w WHERE w.doc_id = x.doc_id AND i = e + 1) - (SELECT upto FROM w WHERE w.doc_id = x.doc_id AND i = m) <= {4 * TOKENS} THEN m + 1 ELSE e + 1 END AS b2 FROM (
                SELECT z.*, (SELECT min(i) FROM w WHERE w.doc_id = z.doc_id AND i BETWEEN b AND e AND upto - before >= {4 * (TOKENS - SHARED)}) AS m FROM (
                  SELECT r.*, greatest(b, (SELECT max(i) FROM w WHERE w.doc_id = r.doc_id AND i >= b AND upto - before <= {4 * TOKENS})) AS e FROM r) z) x WHERE e < words) y
            JOIN w ON w.doc_id = y.doc_id AND w.i = y.b2 - 1)),
        e AS (SELECT r.doc_id, no, begins, before, greatest(b, (SELECT max(i) FROM w WHERE w.doc_id = r.doc_id AND i >= b AND upto - before <= {4 * TOKENS})) AS e FROM r)
        SELECT e.doc_id, no::INT AS no, begins::INT AS span_start, ends::INT AS span_end, (upto - before)::INT AS quarters, sha256(substring(text, begins + 1, ends - begins)) AS digest FROM e JOIN w ON w.doc_id = e.doc_id AND w.i = e.e JOIN documents ON documents.doc_id = e.doc_id""",
    "parse_value": f"""SELECT l_orderkey, l_linenumber, w AS written, CASE WHEN l_linenumber % 4 = 3 THEN NULL WHEN l_linenumber % 4 = 0 THEN CAST(replace(w, ',', '.') AS DOUBLE)
        WHEN l_linenumber % 4 = 1 THEN CASE WHEN l_quantity >= 1 THEN CAST(replace(w, '.', '') AS DOUBLE) ELSE CAST(w AS DOUBLE) END ELSE CAST(w AS DOUBLE) END AS value FROM (SELECT *, {_WRITTEN} AS w FROM lineitem)""",
    "canonical_url": CANONICAL,
    "publisher_class": f"""SELECT CASE WHEN host = 'spam-farm.example.org' OR host LIKE '%.spam-farm.example.org' THEN 'spam' WHEN host = 'example.org' OR host LIKE '%.example.org' THEN 'reference'
        WHEN regexp_matches(host, '\\.(gov|mil)(\\.[a-z]{{2}})?$') THEN 'government' WHEN regexp_matches(host, '\\.int(\\.[a-z]{{2}})?$') THEN 'intergovernmental' WHEN regexp_matches(host, '\\.edu(\\.[a-z]{{2}})?$') THEN 'academic'
        WHEN regexp_matches(host, '\\.org(\\.[a-z]{{2}})?$') THEN 'ngo' ELSE 'other' END AS class, count(*) AS n, count(DISTINCT host) AS hosts FROM (SELECT {_HOST} AS host FROM pages) GROUP BY 1""",
    "html_lang_date": "SELECT page_id, lower(regexp_extract(html, '<html[^>]*lang=\"([A-Za-z]+)', 1)) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) = regexp_extract(html, '<title>([^<]*)</title>', 1) AS repeated FROM pages",
    "token_estimate": """SELECT doc_id, CAST(round_even(a / 4 + (n - a - w) / 2 + w, 0) AS BIGINT) AS tokens FROM (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^\\x{00}-\\x{7F}]', '', 'g')) AS a,
        length(regexp_replace(text, '[^\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]', '', 'g')) AS w FROM documents)""",
    "windows": f"SELECT doc_id, s AS start, least(s + {WINDOW}, length(text)) AS \"end\", sha256(substr(text, s + 1, {WINDOW})) AS digest FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), {WINDOW - OVERLAP})) AS s FROM documents)",
    "quote_locate": "SELECT doc_id, item_id, CAST(instr(d.text, b.text) - 1 AS BIGINT) AS span_start, CAST(instr(d.text, b.text) - 1 + length(b.text) AS BIGINT) AS span_end FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "entity_key": "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-|-$', '', 'g') AS key FROM part",
    "period_months": "SELECT l_orderkey, l_linenumber, CAST((year(s) - year(o)) * 12 + month(s) - month(o) - CASE WHEN day(s) < day(o) THEN 1 ELSE 0 END AS BIGINT) AS months, strftime(s, '%Y-%m') AS month FROM (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS s, CAST(o_orderdate AS DATE) AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "distances": "SELECT s_suppkey, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(b - a) / 2), 2) + cos(radians(a)) * cos(radians(b)) * pow(sin(radians(v - u) / 2), 2))), 3) AS km FROM (SELECT s_suppkey, CAST(s_suppkey % 170 - 85 AS DOUBLE) AS a, CAST(s_suppkey * 7 % 360 - 180 AS DOUBLE) AS u, CAST(s_nationkey * 3 - 40 AS DOUBLE) AS b, CAST(s_nationkey * 14 - 170 AS DOUBLE) AS v FROM supplier)",
    "stable_ids": "SELECT event_id, 'evt_' || substr(sha256(user_id || chr(31) || event_type || chr(31) || event_id), 1, 26) AS id FROM events",
    "repeated_names": "SELECT trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[ \\t\\n\\r]+', ' ', 'g')) AS name, count(*) AS n FROM pages GROUP BY 1",
}

"""Retrieval routes, fusion, bundles, paging and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import values as V
from lodestrata.operators import fusion, passages, ranking, similar, vectors
from lodestrata.operators import relational as R
from lodestrata.sources.tables import table

#: The stated query set of the searches: every row whose id is divisible by this.
EVERY = 20


def _nearest(spark: SparkSession, d: str, k: int) -> DataFrame:
    return vectors.nearest(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), EVERY, k)


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest others of each question, exact."""
    return _nearest(spark, d, 10)


def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Over-fetch three times k, then filter by payload, then k."""
    first = _nearest(spark, d, 30).withColumnRenamed("rank", "r0")
    return ranking.top_k(first.where("label < 7"), ["query_id"], [F.col("r0")], 10).select("query_id", "vec_id", "score", "rank")


def nearest_pair_review(spark: SparkSession, d: str) -> DataFrame:
    """Each question's nearest vector at or above a threshold: to review, never merged."""
    return _nearest(spark, d, 1).where("score >= 0.3").select("query_id", "vec_id", "score")


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    """Two routes per question (by cosine, and by same label in id order) fused by reciprocal rank."""
    vector = vector_topk(spark, d).select("query_id", "vec_id", "rank")
    e = table(spark, d, "embeddings").select("vec_id", "label")
    # The first eleven of each label hold the first ten others for any question of that label.
    first = ranking.top_k(e, ["label"], [F.col("vec_id")], 11).drop("rank")
    q = e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("label").alias("of"))
    same = first.join(q, (F.col("label") == F.col("of")) & (F.col("vec_id") != F.col("query_id")))
    structured = ranking.top_k(same, ["query_id"], [F.col("vec_id")], 10).select("query_id", "vec_id", "rank")
    keyed = vector.union(structured).withColumn("item", F.struct("query_id", "vec_id"))
    return fusion.reciprocal_rank_fusion(keyed, "item", "rank").select("item.query_id", "item.vec_id", "score")


def anchor_inject(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's large orders, and for those without one the best of the rest."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    best = ranking.top_k(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 1)
    return fusion.with_anchors(o.where("o_totalprice > 300000"), best, "o_custkey", "o_orderkey")


def bundle_cap(spark: SparkSession, d: str) -> DataFrame:
    """The 40 dearest orders with at most two a customer."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return fusion.bundle(o, "o_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2, 40)


def spread_domains(spark: SparkSession, d: str) -> DataFrame:
    """30 pages with at most two a host before any host gets more."""
    p = table(spark, d, "pages").select("page_id", V.url_host(F.col("url")).alias("host"))
    return R.spread(p, "host", [F.col("page_id")], 2, 30).select("page_id", "host", "place")


def select_urls(spark: SparkSession, d: str) -> DataFrame:
    """Pages deduplicated by canonical address, the lowest id kept; 50 by tier, then id."""
    p = table(spark, d, "pages").select("page_id", V.canonical_url(F.col("url")).alias("address"))
    kept = p.groupBy("address").agg(F.min("page_id").alias("page_id"))
    tier = F.when(F.col("address").startswith("https"), 0).otherwise(1)
    return kept.withColumn("tier", tier).orderBy("tier", "page_id").limit(50)


TERMS = ["the", "with", "from", "this", "which"]


def keyword_match(spark: SparkSession, d: str) -> DataFrame:
    """Documents with any of the terms as a word, by the number of different terms; 100 best."""
    words = F.array_distinct(F.split(F.lower(F.col("text")), "[^a-z]+"))
    hits = table(spark, d, "documents").select("doc_id", F.size(F.array_intersect(words, F.array(*map(F.lit, TERMS)))).alias("hits"))
    return hits.where("hits > 0").orderBy(F.col("hits").desc(), "doc_id").limit(100)


def trigram_similarity(spark: SparkSession, d: str) -> DataFrame:
    """For each part of the query set: how many others have the same name, and how many a near one (Jaccard of trigrams).

    Names are compared once each, however many parts bear them; the copies are counted, not expanded.
    """
    p = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("name"))
    names = p.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    asked = p.where(F.col("p_partkey") % EVERY == 0)
    near = similar.similar(names, asked, "name", 50).join(names, "name").groupBy("asked").agg(F.sum("n").alias("fuzzy"))
    same = asked.join(names.select("name", (F.col("n") - 1).alias("exact")), "name")
    return same.join(near, F.col("name") == F.col("asked"), "left").select("p_partkey", "exact", F.coalesce("fuzzy", F.lit(0)).cast("long").alias("fuzzy"))


#: Rows of the two arms of a search by name, and the likeness of the second.
EXACT_ARM, FUZZY_ARM, ALIKE = 20, 10, 30


def name_search(spark: SparkSession, d: str) -> DataFrame:
    """Hosts as asked for by every twentieth page: those of the same key (without www.), then the most alike by trigrams."""
    host = V.url_host(F.col("url"))
    p = table(spark, d, "pages").select("page_id", F.lower(host).alias("name"))
    key = F.regexp_replace("name", r"^(www\.|m\.)", "")
    return similar.searched(p, p.where(F.col("page_id") % EVERY == 0), "name", "page_id", key, ALIKE, EXACT_ARM, FUZZY_ARM)


def first_seen_citations(spark: SparkSession, d: str) -> DataFrame:
    """Sources numbered by their first document: one row a source is numbered."""
    first = table(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("first_doc"))
    return first.withColumn("number", F.row_number().over(Window.orderBy("first_doc", "source")))


def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Turns of each conversation up to 300 words, stopping at the first overflow."""
    t = table(spark, d, "conversations").withColumn("words", F.size(F.split(F.trim("text"), "[ \t\n\r]+")).cast("long"))
    return fusion.running_budget(t, ["conv_id"], [F.col("turn")], F.col("words"), 300).select("conv_id", "turn", "used")


def blocked_minus(spark: SparkSession, d: str) -> DataFrame:
    """Candidates without the blocked ones, and how many were taken out, per source."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(1).alias("blocked"))
    return docs.join(toxic, "doc_id", "left").groupBy("source").agg(F.count_if(F.col("blocked").isNull()).alias("kept"), F.count("blocked").alias("removed"))


def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return R.keyset_page(table(spark, d, "events").select("event_id", "event_type"), "event_id", 100, 50)


def offset_page(spark: SparkSession, d: str) -> DataFrame:
    """Second page of 50 by date, newest first, undated last."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return o.orderBy(F.col("o_orderdate").desc_nulls_last(), "o_orderkey").offset(50).limit(50)


def last_turn(spark: SparkSession, d: str) -> DataFrame:
    return ranking.latest_by(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn", "role"])


def prev_turn(spark: SparkSession, d: str) -> DataFrame:
    """Each turn with the role and number of the one before it in its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("prev_role"), F.coalesce(F.lag("turn").over(w), F.lit(-1).cast("long")).alias("prev_turn"))


def inherited_turns(spark: SparkSession, d: str) -> DataFrame:
    """A turn that names no slots of its own takes those of the turn just before, if that has any."""
    own = F.when(F.col("turn") % 3 != 1, F.concat(F.lit("s"), F.col("conv_id") % 5, F.lit(",s"), F.col("turn")))
    before = F.lag(own).over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce(own, before, F.lit("")).alias("slots"))


def passages_without_quote(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold none of the quoted passages of their own source (every benchmark item, dealt by id)."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    quotes = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("src"), F.col("item_id") % 20).alias("of"), F.col("text").alias("quote"))
    pairs = passages.candidates(docs, quotes, "text", "quote", "doc_id", "item_id").where("source = of")
    held = pairs.where(F.instr(F.col("text"), F.col("quote")) > 0).select("doc_id")
    return docs.join(held, "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (vector_topk, vector_topk_filtered, nearest_pair_review, rrf_fuse, anchor_inject, bundle_cap, spread_domains, select_urls, keyword_match, trigram_similarity, name_search, first_seen_citations, budget_prefix, blocked_minus, keyset_page, offset_page, last_turn, prev_turn, inherited_turns, passages_without_quote)}

_SIM = f"SELECT q.vec_id AS query_id, e.vec_id, e.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e JOIN embeddings q ON q.vec_id % {EVERY} = 0 AND q.vec_id <> e.vec_id"
_TOP = f"SELECT query_id, vec_id, label, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM ({_SIM})"
_URL = """lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_replace(lower(regexp_extract(b, '^[^:]+://([^/?]*)', 1)), '\\.$', '') ||
    CASE WHEN regexp_extract(b, '^[^:]+://[^/?]*(/[^?]*)', 1) = '' THEN '/' ELSE regexp_extract(b, '^[^:]+://[^/?]*(/[^?]*)', 1) END ||
    CASE WHEN k = '' THEN '' ELSE '?' || k END"""
CANONICAL = f"""SELECT page_id, CASE WHEN regexp_matches(b, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]') THEN {_URL} END AS address FROM (SELECT page_id, b, array_to_string(list_filter(string_split(regexp_extract(b, '\\?(.*)$', 1), '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_[^=]*|gclid|fbclid|msclkid|mc_cid|mc_eid|ref)(=|$)')), '&') AS k FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS b FROM pages))"""
_GRAMS = "SELECT lower(p_name) AS name, count(*) AS n, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM part GROUP BY 1, 3"
_JACC = "len(list_intersect(a.g, b.g)) / greatest(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)), 1)"

_HOST_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array({0}, '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"

ORACLES = {
    "name_search": rf"""WITH p AS (SELECT page_id AS id, lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)) AS name FROM pages), k AS (SELECT id, name, regexp_replace(name, '^(www\.|m\.)', '') AS key FROM p),
        n AS (SELECT DISTINCT name, key, {_HOST_GRAMS.format('name')} AS g FROM k), a AS (SELECT DISTINCT n.* FROM n JOIN k USING (name) WHERE k.id % {EVERY} = 0),
        s AS (SELECT a.name AS asked, n.name, a.key <> n.key AS other, len(list_intersect(a.g, n.g)) AS common, len(a.g) + len(n.g) - len(list_intersect(a.g, n.g)) AS every FROM a, n WHERE a.name <> n.name),
        e AS (SELECT a.name AS asked, k.id, 'exact' AS arm, CAST(1.0 AS DOUBLE) AS similarity FROM a JOIN k USING (key) QUALIFY row_number() OVER (PARTITION BY a.name ORDER BY k.id) <= {EXACT_ARM}),
        f AS (SELECT asked, k.id, 'fuzzy' AS arm, round(common / every, 6) AS similarity FROM s JOIN k USING (name) WHERE other AND 100 * common >= {ALIKE} * every QUALIFY row_number() OVER (PARTITION BY asked ORDER BY round(common / every, 6) DESC, k.id) <= {FUZZY_ARM})
        SELECT asked, id, arm, similarity, CAST(row_number() OVER (PARTITION BY asked ORDER BY arm, similarity DESC, id) AS INT) AS place FROM (SELECT * FROM e UNION ALL SELECT * FROM f)""",
    "vector_topk": f"SELECT * FROM ({_TOP}) WHERE rank <= 10",
    "vector_topk_filtered": f"SELECT query_id, vec_id, score, CAST(rk AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rk FROM ({_TOP}) WHERE rank <= 30 AND label < 7) WHERE rk <= 10",
    "nearest_pair_review": f"SELECT query_id, vec_id, score FROM ({_TOP}) WHERE rank = 1 AND score >= 0.3",
    "rrf_fuse": f"""WITH v AS (SELECT query_id, vec_id, rank FROM ({_TOP}) WHERE rank <= 10),
        s AS (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY e.vec_id) AS rank FROM embeddings e JOIN embeddings q ON q.vec_id % {EVERY} = 0 AND e.label = q.label AND e.vec_id <> q.vec_id)
        SELECT query_id, vec_id, round(sum(CAST(1.0 AS DOUBLE) / (60 + rank)), 6) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM s WHERE rank <= 10) GROUP BY 1, 2""",
    "anchor_inject": """WITH f AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 300000),
        b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
        SELECT *, false AS anchored FROM f UNION ALL SELECT o_custkey, o_orderkey, true FROM b WHERE rn = 1 AND o_custkey NOT IN (SELECT o_custkey FROM f)""",
    "bundle_cap": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2 ORDER BY o_totalprice DESC, o_orderkey LIMIT 40",
    "spread_domains": """SELECT page_id, host, CAST(row_number() OVER (ORDER BY k > 2, page_id) AS INT) AS place FROM (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS k
        FROM (SELECT page_id, lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)) AS host FROM pages)) ORDER BY place LIMIT 30""",
    "select_urls": f"SELECT address, min(page_id) AS page_id, CASE WHEN address LIKE 'https%' THEN 0 ELSE 1 END AS tier FROM ({CANONICAL}) GROUP BY 1 ORDER BY tier, page_id LIMIT 50",
    "keyword_match": "SELECT doc_id, CAST(hits AS INT) AS hits FROM (SELECT doc_id, len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+')), ['the', 'with', 'from', 'this', 'which'])) AS hits FROM documents) WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 100",
    "trigram_similarity": f"""WITH g AS ({_GRAMS}), f AS (SELECT b.name, CAST(sum(CASE WHEN a.name = b.name THEN a.n - 1 ELSE 0 END) AS BIGINT) AS exact, CAST(sum(CASE WHEN a.name <> b.name THEN a.n ELSE 0 END) AS BIGINT) AS fuzzy
        FROM g a JOIN g b ON a.name = b.name OR {_JACC} >= 0.5 GROUP BY 1) SELECT p_partkey, exact, fuzzy FROM part JOIN f ON name = lower(p_name) WHERE p_partkey % {EVERY} = 0""",
    "first_seen_citations": "SELECT source, f AS first_doc, CAST(row_number() OVER (ORDER BY f, source) AS INT) AS number FROM (SELECT source, min(doc_id) AS f FROM documents GROUP BY 1)",
    "budget_prefix": "SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum(len(regexp_split_to_array(trim(text), '[ \\t\\n\\r]+'))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 300",
    "blocked_minus": "SELECT source, count(*) FILTER (l.doc_id IS NULL) AS kept, count(l.doc_id) AS removed FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l USING (doc_id) GROUP BY 1",
    "keyset_page": "SELECT event_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 50",
    "offset_page": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 50",
    "last_turn": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS rn FROM conversations) WHERE rn = 1",
    "prev_turn": "SELECT conv_id, turn, role, lag(role) OVER w AS prev_role, coalesce(lag(turn) OVER w, -1) AS prev_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)",
    "inherited_turns": """WITH t AS (SELECT conv_id, turn, role, text, CASE WHEN turn % 3 <> 1 THEN 's' || (conv_id % 5) || ',s' || turn END AS own FROM conversations)
        SELECT conv_id, turn, role, coalesce(own, lag(own) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS slots FROM t""",
    "passages_without_quote": "SELECT d.source, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE 'src' || (b.item_id % 20) = d.source AND contains(d.text, b.text)) GROUP BY 1",
}

"""Keyword routes: covers of a question's terms in documents, and claims found by words or by the entity that is named."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import fulltext as T
from lodestrata.sources.claims import CLAIM_SQL, claims
from lodestrata.sources.tables import table

#: Terms of a question at most, letters of a term at least, results of a question.
TERMS, LETTERS, LIMIT = 3, 3, 1000
STOP = ["that", "with", "from", "this", "which", "the", "and", "for"]


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """The stated questions: every benchmark item, by its first words. Spark broadcasts them by their size or joins."""
    return T.questions(table(spark, d, "benchmark"), "item_id", F.col("text"), STOP, LETTERS, TERMS)


def keyword_any(spark: SparkSession, d: str) -> DataFrame:
    """Documents with any of a question's terms, by their occurrences; the best of each question."""
    found = T.postings(table(spark, d, "documents"), "doc_id", F.col("text"), _terms(spark, d))
    return T.best(T.any_of(found), LIMIT).select("question", "doc", "hits", "score", "rank")


def keyword_covers(spark: SparkSession, d: str) -> DataFrame:
    """Documents with all of a question's terms, by the density of the covers of these terms."""
    found = T.postings(table(spark, d, "documents"), "doc_id", F.col("text"), _terms(spark, d))
    return T.best(T.all_of(found, TERMS), LIMIT).select("question", "doc", "covers", "score", "rank")


#: Claims of the keyword route: found by words, in all.
WORDS_TOP, ROUTE_TOP = 10, 15


def keyword_route(spark: SparkSession, d: str) -> DataFrame:
    """The keyword route of every city: its relation claims with any word of the question, then those of the entity it names.

    A city's question is about the part and the supplier of its first relation claim; a claim's text is its relation and
    the names of its object and subject. An entity is named where all words of its name are in the question.
    """
    c = claims(spark, d, "city_id", "claim_id", "kind", "status", "relation", "subject", "object").where("kind = 'relation' AND status <> 'insufficient'")
    part, supplier = table(spark, d, "part").select(F.col("p_partkey").alias("object"), "p_name"), table(spark, d, "supplier").select(F.col("s_suppkey").alias("subject"), "s_name")
    c = c.join(part, "object", "left").join(supplier, "subject", "left").select("city_id", "claim_id", "subject", "relation", "p_name", "s_name")
    first = c.groupBy("city_id").agg(F.min_by(F.struct("p_name", "s_name", "subject"), "claim_id").alias("f"))
    asked = first.select("city_id", F.concat_ws(" ", F.lit("Who leads or funds the"), "f.p_name", F.lit("of"), "f.s_name").alias("text"))
    terms = T.questions(asked, "city_id", F.col("text"), ["who", "or", "the", "of"], 1, 6)
    # A city's claims meet its own question alone.
    text = F.concat_ws(" ", "relation", "p_name", "s_name")
    placed = c.select(F.col("city_id").alias("question"), F.col("claim_id").alias("doc"), F.explode(T.words(text)).alias("term"))
    found = T.best(T.any_of(placed.join(terms, ["question", "term"])), WORDS_TOP)
    names = first.select("city_id", F.col("f.subject").alias("subject")).where("subject IS NOT NULL")
    named = c.join(names, ["city_id", "subject"]).select(F.col("city_id").alias("question"), F.col("claim_id").alias("doc"))
    return T.with_named(found, named, ROUTE_TOP)


QUERIES = {f.__name__: f for f in (keyword_any, keyword_covers, keyword_route)}

_WORDS = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"
_FOUND = f"""q AS (SELECT item_id AS question, list_distinct_in_order[1:{TERMS}] AS kept FROM (SELECT item_id,
      list_filter(w, lambda x, i: list_position(w, x) = i AND length(x) >= {LETTERS} AND x NOT IN ({', '.join(map(repr, STOP))})) AS list_distinct_in_order FROM (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark))),
    t AS (SELECT question, len(kept) AS terms, unnest(kept) AS term, generate_subscripts(kept, 1) AS slot FROM q),
    p AS (SELECT doc_id AS doc, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents)),
    f AS (SELECT question, slot, terms, doc, pos FROM p JOIN t USING (term))"""
_RANK = "CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, doc) AS INT) AS rank"
_SEEN = ", ".join(f"last_value(CASE WHEN slot = {s} THEN pos END IGNORE NULLS) OVER w AS p{s}" for s in range(1, TERMS + 1))
_ALL = " AND ".join(f"(terms < {s} OR p{s} IS NOT NULL)" for s in range(1, TERMS + 1))
_BEGIN = f"least({', '.join(f'CASE WHEN terms >= {s} THEN p{s} END' for s in range(1, TERMS + 1))})"

ORACLES = {
    "keyword_any": f"WITH {_FOUND}, s AS (SELECT question, doc, count(*) AS hits, round(count(*) * CAST(0.1 AS DOUBLE), 6) AS score FROM f GROUP BY ALL) SELECT question, doc, hits, score, {_RANK} FROM s QUALIFY rank <= {LIMIT}",
    "keyword_covers": f"""WITH {_FOUND},
        a AS (SELECT *, {_SEEN} FROM f WINDOW w AS (PARTITION BY question, doc ORDER BY pos ROWS UNBOUNDED PRECEDING)),
        b AS (SELECT question, doc, pos AS ends, CASE WHEN {_ALL} THEN {_BEGIN} END AS begins FROM a),
        c AS (SELECT question, doc, begins, min(ends) AS ends FROM b WHERE begins IS NOT NULL GROUP BY ALL),
        n AS (SELECT c.question, c.doc, begins, ends, count(*) AS held FROM c JOIN f ON f.question = c.question AND f.doc = c.doc AND pos BETWEEN begins AND ends GROUP BY ALL),
        s AS (SELECT question, doc, count(*) AS covers, round(sum(CAST(0.1 AS DOUBLE) / (1 + ends - begins - (held - 1))), 6) AS score FROM n GROUP BY ALL)
        SELECT question, doc, covers, score, {_RANK} FROM s QUALIFY rank <= {LIMIT}""",
    "keyword_route": f"""WITH {CLAIM_SQL}, c AS (SELECT city_id, claim_id, subject, relation, p_name, s_name FROM claim LEFT JOIN part ON p_partkey = object LEFT JOIN supplier ON s_suppkey = subject WHERE kind = 'relation' AND status <> 'insufficient'),
        o AS (SELECT city_id, arg_min({{'p': p_name, 's': s_name, 'subject': subject}}, claim_id) AS f FROM c GROUP BY ALL),
        i AS (SELECT city_id, f.subject AS subject, {_WORDS.format("concat_ws(' ', 'Who leads or funds the', f.p, 'of', f.s)")} AS w FROM o),
        t AS (SELECT DISTINCT city_id, unnest(list_filter(w, lambda x, i: list_position(w, x) = i AND x NOT IN ('who', 'or', 'the', 'of'))[1:6]) AS term FROM i),
        p AS (SELECT city_id, claim_id, unnest({_WORDS.format("concat_ws(' ', relation, p_name, s_name)")}) AS term FROM c),
        h AS (SELECT city_id, claim_id, count(*) AS hits FROM p JOIN t USING (city_id, term) GROUP BY ALL),
        f AS (SELECT city_id, claim_id, row_number() OVER (PARTITION BY city_id ORDER BY hits DESC, claim_id) AS rank FROM h QUALIFY rank <= {WORDS_TOP}),
        b AS (SELECT city_id, claim_id, rank, 'found' AS arm FROM f UNION ALL SELECT c.city_id, c.claim_id, NULL, 'named' FROM c JOIN i ON c.city_id = i.city_id AND c.subject = i.subject),
        m AS (SELECT city_id, claim_id, min(rank) AS rank, min(arm) AS arm FROM b GROUP BY ALL)
        SELECT city_id AS question, claim_id AS doc, CAST(row_number() OVER (PARTITION BY city_id ORDER BY rank NULLS LAST, claim_id) AS INT) AS rank, arm FROM m QUALIFY row_number() OVER (PARTITION BY city_id ORDER BY m.rank NULLS LAST, claim_id) <= {ROUTE_TOP}""",
}

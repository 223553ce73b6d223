"""Evidence graph: claims as edges, neighbourhoods, resolution of names to entities, and its writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import judging as J
from lodestrata.operators import entities, fulltext, fusion, graphwalk, steps
from lodestrata.sources.claims import CLAIM_SQL, claims
from lodestrata.sources.tables import table

POLICY = J.Policy()
AT = "1999-06-01"


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that claims become: relations as they are, statistics as MEASURED_IN without value; others none.

    A superseded edge keeps its end. Counted by type and whether ended.
    """
    c = claims(spark, d, "kind", "status", "relation", "valid_to", "unit", "subject", "object", "city_id").where("status <> 'insufficient'")
    rel = c.where("kind = 'relation'").select("relation", "subject", "object", "valid_to")
    stat = c.where("kind = 'statistic' AND unit <> 'count'").select(F.lit("MEASURED_IN").alias("relation"), "object", F.col("city_id").alias("to"), F.lit(None).cast("date").alias("valid_to")).toDF("relation", "subject", "object", "valid_to")
    return rel.union(stat).groupBy("relation", F.col("valid_to").isNotNull().alias("ended")).agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("subject").alias("subjects"))


def edges_at(spark: SparkSession, d: str) -> DataFrame:
    """Edges of some types and subjects that hold at a date: begun or of unknown begin, not yet ended."""
    c = claims(spark, d, "claim_id", "kind", "relation", "subject", "valid_from", "valid_to").where("kind = 'relation' AND relation IN ('LEADS', 'FUNDS') AND subject % 10 < 4")
    at = F.lit(AT).cast("date")
    return c.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))).select("claim_id", "relation")


def newest_edges(spark: SparkSession, d: str) -> DataFrame:
    """The two newest current edges of each subject; those without a begin come first."""
    c = claims(spark, d, "claim_id", "kind", "subject", "valid_from", "valid_to").where("kind = 'relation' AND valid_to IS NULL")
    w = Window.partitionBy("subject").orderBy(F.col("valid_from").desc_nulls_first(), "claim_id")
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("subject", "claim_id", "rank")


def claims_touching(spark: SparkSession, d: str) -> DataFrame:
    """Relation claims that touch any of a set of entities on either side, each once, by run."""
    c = claims(spark, d, "claim_id", "run_id", "kind", "subject", "object").where("kind = 'relation'")
    ends = c.select("claim_id", "run_id", F.explode(F.array_distinct(F.array(F.concat(F.lit("s"), "subject"), F.concat(F.lit("o"), "object")))).alias("entity"))
    wanted = spark.createDataFrame([(e,) for e in ("s3", "s7", "o11", "o40")], "entity string")
    return ends.join(F.broadcast(wanted), "entity", "left_semi").select("claim_id", "run_id").distinct()


def edge_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of each edge, in order of id, as one list."""
    c = claims(spark, d, "claim_id", "kind", "subject", "relation", "object").where("kind = 'relation'")
    return c.groupBy("subject", "relation", "object").agg(F.array_join(F.transform(F.array_sort(F.collect_list("claim_id")), lambda x: x.cast("string")), ",").alias("claims"))


def whole_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with the names of both ends; an edge of a missing end is dropped. Counted by the names' last signs."""
    c = claims(spark, d, "kind", "subject", "object").where("kind = 'relation'")
    s, o = table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_name"), table(spark, d, "part").where("p_size > 20").select("p_partkey", "p_brand")
    j = c.join(s, F.col("subject") == F.col("s_suppkey")).join(o, F.col("object") == F.col("p_partkey"))
    return j.groupBy("s_name", "p_brand").agg(F.count(F.lit(1)).alias("n"))


def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """Edges of every entity in either direction, with status: contested, ended, or current if a claim of it stands."""
    c = claims(spark, d, "kind", "status", "subject", "relation", "object", "valid_to").where("kind = 'relation'")
    edge = c.groupBy("subject", "relation", "object").agg(F.bool_or(F.col("status") == "contested").alias("contested"), F.bool_or(F.col("status") == "supported").alias("confirmed"), F.max(F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))).alias("until"))
    status = F.when(F.col("contested"), "contested").when(~F.col("confirmed"), "unconfirmed").when(F.col("until") <= F.lit(AT).cast("date"), "ended").otherwise("current")
    both = edge.select(F.concat(F.lit("s"), "subject").alias("entity"), F.lit("out").alias("direction"), status.alias("status")).unionByName(edge.select(F.concat(F.lit("o"), "object").alias("entity"), F.lit("in").alias("direction"), status.alias("status")))
    return both.groupBy("entity", "direction", "status").agg(F.count(F.lit(1)).alias("n"))


def ranked_then_rest(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a subject: those a search ranked first, in its order, then the others as they stand; the first four."""
    c = claims(spark, d, "claim_id", "kind", "subject", "hundredths", "publisher").where("kind = 'relation'")
    rank = F.when(F.col("publisher") == "academic", F.coalesce("hundredths", F.lit(0)))
    w = Window.partitionBy("subject").orderBy(rank.isNull(), rank, "claim_id")
    return c.withColumn("place", F.row_number().over(w)).where("place <= 4").select("subject", "claim_id", "place")


def graph_route(spark: SparkSession, d: str) -> DataFrame:
    """Route over the graph: typed edges that hold, narrowed to a named entity where any match, mapped to claims.

    For each city; the named entity is its first subject that is divisible by three.
    """
    at = F.lit(AT).cast("date")
    c = claims(spark, d, "city_id", "claim_id", "kind", "relation", "subject", "valid_from", "valid_to", "publisher").where("kind = 'relation' AND relation IN ('LEADS', 'FUNDS', 'RUNS')")
    c = c.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    named = c.where("subject % 3 = 0").groupBy("city_id").agg(F.min("subject").alias("named"))
    kept = c.join(named, "city_id", "left").where("named IS NULL OR subject = named")
    w = Window.partitionBy("city_id").orderBy(F.col("publisher") != "academic", "claim_id")
    return kept.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("city_id", "claim_id", "rank")


#: Every so manieth supplier is a centre; edges from it at most, results of a search.
CENTRES, DEPTH, NEAR = 20, 3, 10


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the graph with ends that don't clash: subjects as they are, objects below zero; one for each pair and type."""
    at = F.lit(AT).cast("date")
    c = claims(spark, d, "claim_id", "kind", "status", "relation", "subject", "object", "valid_from", "valid_to").where("kind = 'relation' AND status <> 'insufficient' AND relation IN ('LEADS', 'GOVERNS')")
    c = c.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    return c.groupBy("relation", "subject", "object").agg(F.min("claim_id").alias("edge")).select("edge", "relation", F.col("subject").alias("a"), (-F.col("object") - 1).alias("b"), "object")


def _centres(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").where(F.col("s_suppkey") % CENTRES == 0).select(F.col("s_suppkey").alias("centre"))


def graph_distances(spark: SparkSession, d: str) -> DataFrame:
    """How many edges every entity is from each centre, up to three, over the edges that hold at a date."""
    return graphwalk.distances(_edges(spark, d), "a", "b", _centres(spark, d), "centre", DEPTH)


def edges_near_centre(spark: SparkSession, d: str) -> DataFrame:
    """Search of edges around each centre: by words (BM25 over type and object's name) and by distance, fused by rank.

    A centre's question is the type and object's name of its first edge. Each route gives its first edges, ties by id.
    """
    edges = _edges(spark, d)
    part = table(spark, d, "part").select(F.col("p_partkey").alias("object"), "p_name")
    named = steps.kept(edges.join(part, "object", "left").select("edge", "a", "b", F.concat_ws(" ", "relation", "p_name").alias("text")))
    asked = named.join(_centres(spark, d), F.col("a") == F.col("centre")).groupBy("centre").agg(F.min_by("text", "edge").alias("question"))
    # Centres with one question share its answer.
    terms = fulltext.questions(asked.select("question").distinct(), "question", F.col("question"), [], 1, 4)
    words = fulltext.best_of_recurring(named, "edge", "text", terms, NEAR)
    words = asked.join(words, "question").select("centre", F.col("doc").alias("edge"), "rank")
    near = graphwalk.nearest_edges(named, "a", "b", "edge", asked, "centre", DEPTH, NEAR).select("centre", "edge", "rank")
    fused = fusion.reciprocal_rank_fusion(words.union(near).withColumn("item", F.struct("centre", "edge")), "item", "rank").select("item.centre", "item.edge", "score")
    return graphwalk.ranked(fused, ["centre"], [F.col("score").desc(), F.col("edge")], NEAR).select("centre", "edge", "score", "rank")


ALLOWED = [("LEADS", 0), ("LEADS", 1), ("GOVERNS", 1), ("FUNDS", 2), ("RUNS", 0), ("RUNS", 2)]


def refused_edges(spark: SparkSession, d: str) -> DataFrame:
    """New edges whose pair of types isn't allowed are refused; of the others, ends that the graph lacks are added."""
    allowed = spark.createDataFrame(ALLOWED, "relation string, type int")
    c = claims(spark, d, "kind", "relation", "subject", "object").where("kind = 'relation'").withColumn("type", (F.col("object") % 3).cast("int"))
    j = c.join(F.broadcast(allowed.withColumn("ok", F.lit(True))), ["relation", "type"], "left")
    known = table(spark, d, "supplier").where("s_acctbal > 1000").select(F.col("s_suppkey").alias("subject"), F.lit(True).alias("known"))
    j = j.join(known, "subject", "left")
    return j.groupBy("relation", "type").agg(F.count_if(F.col("ok").isNull()).alias("refused"), F.countDistinct(F.when(F.col("ok") & F.col("known").isNull(), F.col("subject"))).alias("added"))


def ended_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with their end: a later rival of the same object and type ends an open one; none is deleted."""
    c = claims(spark, d, "claim_id", "kind", "relation", "object", "valid_from", "valid_to").where("kind = 'relation' AND relation IN ('LEADS', 'GOVERNS') AND valid_from IS NOT NULL")
    w = Window.partitionBy("relation", "object").orderBy("valid_from", "claim_id")
    nxt = F.lead("valid_from").over(w)
    return c.select("claim_id", F.when(F.col("valid_to").isNull(), nxt).otherwise(F.least("valid_to", F.coalesce(nxt, F.col("valid_to")))).alias("ends"))


def contest_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Both sides of a pair become contested, with one event a side: what changes, by old status."""
    c = claims(spark, d, "claim_id", "city_id", "slot", "status").where("slot = 3")
    w = Window.partitionBy("city_id").orderBy("claim_id")
    pairs = c.withColumn("other", F.lead("claim_id").over(w)).where("other IS NOT NULL AND claim_id % 5 = 0")
    sides = pairs.select("claim_id").union(pairs.select("other")).distinct()
    return c.join(sides.withColumn("hit", F.lit(True)), "claim_id", "left").groupBy("status", F.when(F.col("hit"), "contested").otherwise(F.col("status")).alias("new_status")).agg(F.count(F.lit(1)).alias("n"))


def resolved_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entity of each surface form by ordered rules: acronym, alias, key, set of words, else new; and the rule that held.

    Entities are the distinct part names; surface forms are made from them. Of several matches of a rule the first by
    name counts. Every form is resolved against the same entities, so no order between forms matters.
    """
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    e = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    e = e.withColumn("key", F.array_join(words(F.col("name")), "-")).withColumn("bag", F.array_join(F.array_sort(F.array_distinct(words(F.col("name")))), "-"))
    e = e.withColumn("acronym", F.upper(F.array_join(F.transform(words(F.col("name")), lambda w: F.substring(w, 1, 1)), ""))).withColumn("alias", F.concat(F.lit("the other "), F.substring("name", 1, 4)))
    form = F.expr("CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(substring_index(p_name, ' ', -1), ' ', substring_index(p_name, ' ', 1)) WHEN 2 THEN upper(concat(substring(p_name, 1, 1), substring(substring_index(p_name, ' ', -1), 1, 1))) WHEN 3 THEN concat('the other ', substring(p_name, 1, 4)) WHEN 4 THEN concat('new ', p_name) ELSE p_name END")
    s = table(spark, d, "part").select("p_partkey", form.alias("form"))
    s = s.withColumn("key", F.array_join(words(F.col("form")), "-")).withColumn("bag", F.array_join(F.array_sort(F.array_distinct(words(F.col("form")))), "-"))
    rules = [("acronym", F.when(F.col("form").rlike("^[A-Z]{2,8}$"), F.col("form")), "acronym"), ("alias", F.lower("form"), "alias"), ("key", F.col("key"), "key"), ("words", F.col("bag"), "bag")]
    out = s
    for name, given, column in rules:
        # An acronym that several entities share names none.
        found = e.groupBy(F.col(column).alias("by_" + name)).agg(F.min("name").alias("of_" + name), F.count(F.lit(1)).alias("n_" + name))
        found = found.where(F.col("n_acronym") == 1) if name == "acronym" else found
        out = out.withColumn("by_" + name, given).join(found.drop("n_" + name), "by_" + name, "left")
    rule = F.coalesce(*[F.when(F.col("of_" + n).isNotNull(), F.lit(n)) for n, _, _ in rules], F.lit("new"))
    return out.select("p_partkey", "form", F.coalesce(*[F.col("of_" + n) for n, _, _ in rules], F.col("form")).alias("entity"), rule.alias("rule"))


#: Forms and definitions that both engines read: names as parts have them, written in six ways; two places and two generic bodies.
_INITIALS = "upper(concat(substring(p_name, 1, 1), substring({last}, 1, 1)))"
_TITLE = "concat(upper(substring(p_name, 1, 1)), substring(p_name, 2))"
_FORMS = """CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN {title} WHEN 1 THEN concat({last}, ' of  the ', {first}) WHEN 2 THEN {initials}
    WHEN 3 THEN upper(p_name) WHEN 4 THEN CASE WHEN p_partkey % 5 = 0 THEN 'Department of Health' ELSE concat('The ', p_name) END ELSE p_name END"""


def entities_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Entity and rule of each form in the order of the forms, with acronyms that sources define; see operators.entities."""
    last, first = "substring_index(p_name, ' ', -1)", "substring_index(p_name, ' ', 1)"
    initials = _INITIALS.format(last=last)
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    forms = p.selectExpr("CAST(p_size % 4 AS BIGINT) AS city", "p_partkey AS id", "p_brand AS source", _FORMS.format(title=_TITLE, last=last, first=first, initials=initials) + " AS form")
    definitions = p.where("p_partkey % 5 = 0").selectExpr("p_brand AS source", initials + " AS acronym", _TITLE + " AS long")
    return entities.resolve(forms, definitions)


def acronym_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Definitions `Long Name (LN)` in texts whose initials fit, kept where a source defines the acronym in one way."""
    text = F.expr("CASE WHEN p_partkey % 3 = 0 THEN concat('By ', initcap(p_name), ' (', upper(concat(substring(p_name, 1, 1), substring(substring_index(p_name, ' ', -1), 1, 1))), ') it says') WHEN p_partkey % 3 = 1 THEN concat(initcap(p_name), ' (XY)') ELSE p_name END")
    t = table(spark, d, "part").select("p_brand", text.alias("text"))
    pattern = r"([A-Z][a-z]+ [A-Z][a-z]+) \(([A-Z]{2,8})\)"
    t = t.select("p_brand", F.regexp_extract("text", pattern, 1).alias("name"), F.regexp_extract("text", pattern, 2).alias("acronym")).where("acronym <> ''")
    fits = F.concat(F.substring("name", 1, 1), F.substring(F.substring_index("name", " ", -1), 1, 1)) == F.col("acronym")
    return t.where(fits).groupBy("p_brand", "acronym").agg(F.min("name").alias("name"), F.countDistinct("name").alias("k")).where("k = 1").drop("k")


def search_texts(spark: SparkSession, d: str) -> DataFrame:
    """Text under which a claim is searched: subject's and object's names, null-safe, by relation; counted."""
    c = claims(spark, d, "kind", "relation", "subject", "object")
    s, o = table(spark, d, "supplier").where("s_suppkey % 4 > 0").select("s_suppkey", "s_name"), table(spark, d, "part").where("p_partkey % 5 > 0").select("p_partkey", "p_name")
    j = c.join(s, F.col("subject") == F.col("s_suppkey"), "left").join(o, F.col("object") == F.col("p_partkey"), "left")
    return j.groupBy(F.concat_ws(" ", "s_name", F.lower("relation"), "p_name").alias("text")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (graph_edges, edges_at, newest_edges, claims_touching, edge_claims, whole_edges, neighbourhood, ranked_then_rest, graph_route, refused_edges, ended_edges, contest_pairs, resolved_entities, acronym_definitions, search_texts, graph_distances, edges_near_centre, entities_in_order)}

_W = f"WITH {CLAIM_SQL}"
_REL = "kind = 'relation'"
_AT = f"(valid_from IS NULL OR valid_from <= DATE '{AT}') AND (valid_to IS NULL OR valid_to > DATE '{AT}')"
_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"
_FORM = "CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN upper(p_name) WHEN 1 THEN split_part(p_name, ' ', -1) || ' ' || split_part(p_name, ' ', 1) WHEN 2 THEN upper(p_name[1] || split_part(p_name, ' ', -1)[1]) WHEN 3 THEN 'the other ' || substring(p_name, 1, 4) WHEN 4 THEN 'new ' || p_name ELSE p_name END"
_INIT = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"

_TOKENS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"
_EDGES = f"""e AS (SELECT min(claim_id) AS edge, relation, subject AS a, -object - 1 AS b, object FROM claim WHERE {_REL} AND status <> 'insufficient' AND relation IN ('LEADS', 'GOVERNS') AND {_AT} GROUP BY relation, subject, object),
    ways AS (SELECT DISTINCT a AS node, b AS nxt FROM e UNION SELECT DISTINCT b, a FROM e)"""
_WALK = f"""walk(centre, node, distance) AS (SELECT {{}}, 0 FROM {{}} UNION SELECT centre, nxt, distance + 1 FROM walk JOIN ways USING (node) WHERE distance < {DEPTH}),
    reached AS (SELECT centre, node, CAST(min(distance) AS INT) AS distance FROM walk GROUP BY ALL)"""

_NAME_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"
_KEPT = "list_filter({}, lambda w: w NOT IN ('the', 'of', 'and', 'for'))".format(_NAME_WORDS)
_SQL_FORMS = dict(title=_TITLE, last="split_part(p_name, ' ', -1)", first="split_part(p_name, ' ', 1)", initials=_INITIALS.format(last="split_part(p_name, ' ', -1)"))

ORACLES = {
    "entities_in_order": f"""WITH RECURSIVE d AS (SELECT p_brand AS source, {_SQL_FORMS['initials']} AS acronym, min({_TITLE}) AS long FROM part WHERE p_partkey % 5 = 0 GROUP BY ALL),
        g AS (SELECT p_size % 4 AS city, p_partkey AS id, p_brand AS source, trim(regexp_replace({_FORMS.format(**_SQL_FORMS)}, '\\s+', ' ', 'g')) AS form FROM part),
        h AS (SELECT city, id, g.source, form, long IS NOT NULL AS defined, coalesce(long, form) AS name, row_number() OVER (PARTITION BY city ORDER BY id) AS n FROM g LEFT JOIN d ON d.source = g.source AND acronym = form),
        k AS (SELECT *, array_to_string({_NAME_WORDS.format('name')}, '-') AS key, array_to_string(list_sort(list_distinct({_KEPT.format('name')})), '-') AS bag,
          len(list_filter({_KEPT.format('name')}, lambda w: w NOT IN ('ministry', 'department', 'health', 'city', 'council', 'office'))) = 0 AS generic FROM h),
        f AS (SELECT k.*, list_distinct([form, name] || coalesce((SELECT list(acronym) FROM d WHERE d.source = k.source AND array_to_string({_NAME_WORDS.format('long')}, '-') = k.key), [])) AS adds FROM k),
        s AS (SELECT DISTINCT city, 0::BIGINT AS n, MAP {{}}::MAP(VARCHAR, BIGINT) AS alias, MAP {{}}::MAP(VARCHAR, BIGINT) AS bags, MAP {{}}::MAP(VARCHAR, VARCHAR) AS keys, NULL::BIGINT AS id, NULL::BIGINT AS entity, NULL::VARCHAR AS rule FROM k
          UNION ALL
          SELECT city, n, CASE WHEN rule = 'alias' OR generic THEN alias ELSE map_concat(map_from_entries(list_transform(adds, lambda x: {{'k': x, 'v': entity}})), alias) END,
            CASE WHEN rule = 'alias' THEN bags ELSE map_concat(MAP {{mark: entity}}, bags) END, CASE WHEN rule = 'alias' THEN keys ELSE map_concat(MAP {{mark: key}}, keys) END, id, entity, rule
          FROM (SELECT *, CASE WHEN hit IS NOT NULL THEN 'alias' WHEN entity = id THEN 'new' WHEN keys[mark] = key THEN 'key' ELSE 'words' END AS rule
            FROM (SELECT *, coalesce(hit, bags[mark], id) AS entity
              FROM (SELECT f.*, s.alias, s.bags, s.keys, CASE WHEN generic THEN key || '@' || source ELSE bag END AS mark, CASE WHEN NOT defined THEN s.alias[form] END AS hit FROM s JOIN f ON f.city = s.city AND f.n = s.n + 1))))
        SELECT city::BIGINT AS city, id, entity, rule FROM s WHERE n > 0""",
    "graph_distances": f"WITH RECURSIVE {CLAIM_SQL}, {_EDGES}, {_WALK.format('s_suppkey, s_suppkey', f'supplier WHERE s_suppkey % {CENTRES} = 0')} SELECT centre, node, distance FROM reached",
    "edges_near_centre": f"""WITH RECURSIVE {CLAIM_SQL}, {_EDGES}, named AS (SELECT edge, a, b, concat_ws(' ', relation, p_name) AS text FROM e LEFT JOIN part ON p_partkey = object),
        asked AS (SELECT a AS centre, arg_min(text, edge) AS question FROM named WHERE a % {CENTRES} = 0 AND a IN (SELECT s_suppkey FROM supplier) GROUP BY ALL),
        {_WALK.format('centre, centre', 'asked')},
        own AS (SELECT edge, {_TOKENS.format('text')} AS w FROM named), tf AS (SELECT edge, n, term, count(*) AS tf FROM (SELECT edge, len(w) AS n, unnest(w) AS term FROM own) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL), whole AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM own),
        terms AS (SELECT DISTINCT centre, unnest(list_distinct({_TOKENS.format('question')})[1:4]) AS term FROM asked),
        bm AS (SELECT centre, edge, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN terms USING (term), whole GROUP BY ALL),
        w AS (SELECT centre, edge, row_number() OVER (PARTITION BY centre ORDER BY score DESC, edge) AS rank FROM bm QUALIFY rank <= {NEAR}),
        ends AS (SELECT edge, a AS node FROM named UNION ALL SELECT edge, b FROM named), touch AS (SELECT centre, edge, min(distance) AS distance FROM ends JOIN reached USING (node) GROUP BY ALL),
        n AS (SELECT centre, edge, row_number() OVER (PARTITION BY centre ORDER BY distance, edge) AS rank FROM touch QUALIFY rank <= {NEAR}),
        f AS (SELECT centre, edge, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)), 6) AS score FROM (SELECT * FROM w UNION ALL SELECT * FROM n) GROUP BY ALL)
        SELECT centre, edge, score, CAST(row_number() OVER (PARTITION BY centre ORDER BY score DESC, edge) AS INT) AS rank FROM f QUALIFY rank <= {NEAR}""",
    "graph_edges": f"""{_W}, e AS (SELECT relation, subject, object, valid_to FROM claim WHERE {_REL} AND status <> 'insufficient' UNION ALL SELECT 'MEASURED_IN', object, city_id, NULL FROM claim WHERE kind = 'statistic' AND unit <> 'count' AND status <> 'insufficient')
        SELECT relation, valid_to IS NOT NULL AS ended, count(*) AS edges, count(DISTINCT subject) AS subjects FROM e GROUP BY ALL""",
    "edges_at": f"{_W} SELECT claim_id, relation FROM claim WHERE {_REL} AND relation IN ('LEADS', 'FUNDS') AND subject % 10 < 4 AND {_AT}",
    "newest_edges": f"{_W}, r AS (SELECT subject, claim_id, CAST(row_number() OVER (PARTITION BY subject ORDER BY valid_from DESC NULLS FIRST, claim_id) AS INT) AS rank FROM claim WHERE {_REL} AND valid_to IS NULL) FROM r WHERE rank <= 2",
    "claims_touching": f"{_W} SELECT DISTINCT claim_id, run_id FROM claim WHERE {_REL} AND (subject IN (3, 7) OR object IN (11, 40))",
    "edge_claims": f"{_W} SELECT subject, relation, object, string_agg(claim_id::VARCHAR, ',' ORDER BY claim_id) AS claims FROM claim WHERE {_REL} GROUP BY ALL",
    "whole_edges": f"{_W} SELECT s_name, p_brand, count(*) AS n FROM claim JOIN supplier ON s_suppkey = subject AND s_acctbal > 0 JOIN part ON p_partkey = object AND p_size > 20 WHERE {_REL} GROUP BY ALL",
    "neighbourhood": f"""{_W}, e AS (SELECT subject, relation, object, bool_or(status = 'contested') AS contested, bool_or(status = 'supported') AS confirmed, max(coalesce(valid_to, DATE '9999-12-31')) AS until FROM claim WHERE {_REL} GROUP BY ALL),
        s AS (SELECT *, CASE WHEN contested THEN 'contested' WHEN NOT confirmed THEN 'unconfirmed' WHEN until <= DATE '{AT}' THEN 'ended' ELSE 'current' END AS status FROM e),
        b AS (SELECT 's' || subject AS entity, 'out' AS direction, status FROM s UNION ALL SELECT 'o' || object, 'in', status FROM s) SELECT entity, direction, status, count(*) AS n FROM b GROUP BY ALL""",
    "ranked_then_rest": f"{_W}, r AS (SELECT subject, claim_id, CASE WHEN publisher = 'academic' THEN coalesce(hundredths, 0) END AS k FROM claim WHERE {_REL}), p AS (SELECT subject, claim_id, CAST(row_number() OVER (PARTITION BY subject ORDER BY k IS NULL, k, claim_id) AS INT) AS place FROM r) FROM p WHERE place <= 4",
    "graph_route": f"""{_W}, c AS (SELECT * FROM claim WHERE {_REL} AND relation IN ('LEADS', 'FUNDS', 'RUNS') AND {_AT}), m AS (SELECT city_id, min(subject) AS named FROM c WHERE subject % 3 = 0 GROUP BY ALL),
        r AS (SELECT city_id, claim_id, CAST(row_number() OVER (PARTITION BY city_id ORDER BY publisher <> 'academic', claim_id) AS INT) AS rank FROM c LEFT JOIN m USING (city_id) WHERE named IS NULL OR subject = named) FROM r WHERE rank <= 5""",
    "refused_edges": f"""{_W}, a(relation, type) AS (VALUES {', '.join(f"('{r}', {t})" for r, t in ALLOWED)}), c AS (SELECT *, CAST(object % 3 AS INT) AS type FROM claim WHERE {_REL})
        SELECT c.relation, c.type, count(*) FILTER (WHERE a.type IS NULL) AS refused, count(DISTINCT subject) FILTER (WHERE a.type IS NOT NULL AND s_suppkey IS NULL) AS added FROM c LEFT JOIN a ON a.relation = c.relation AND a.type = c.type LEFT JOIN supplier ON s_suppkey = subject AND s_acctbal > 1000 GROUP BY ALL""",
    "ended_edges": f"{_W}, e AS (SELECT claim_id, valid_to, lead(valid_from) OVER (PARTITION BY relation, object ORDER BY valid_from, claim_id) AS nxt FROM claim WHERE {_REL} AND relation IN ('LEADS', 'GOVERNS') AND valid_from IS NOT NULL) SELECT claim_id, CASE WHEN valid_to IS NULL THEN nxt WHEN nxt < valid_to THEN nxt ELSE valid_to END AS ends FROM e",
    "contest_pairs": f"""{_W}, c AS (SELECT claim_id, status, lead(claim_id) OVER (PARTITION BY city_id ORDER BY claim_id) AS other FROM claim WHERE slot = 3), p AS (SELECT * FROM c WHERE other IS NOT NULL AND claim_id % 5 = 0), s AS (SELECT claim_id FROM p UNION SELECT other FROM p)
        SELECT status, CASE WHEN claim_id IN (SELECT claim_id FROM s) THEN 'contested' ELSE status END AS new_status, count(*) AS n FROM c GROUP BY ALL""",
    "resolved_entities": f"""WITH e AS (SELECT DISTINCT p_name AS name FROM part), f AS (SELECT name, array_to_string({_WORDS.format('name')}, '-') AS key, array_to_string(list_sort(list_distinct({_WORDS.format('name')})), '-') AS bag, upper(array_to_string(list_transform({_WORDS.format('name')}, lambda w: w[1]), '')) AS acronym, 'the other ' || substring(name, 1, 4) AS alias FROM e),
        s AS (SELECT p_partkey, {_FORM} AS form FROM part), t AS (SELECT *, array_to_string({_WORDS.format('form')}, '-') AS key, array_to_string(list_sort(list_distinct({_WORDS.format('form')})), '-') AS bag FROM s),
        m AS (SELECT p_partkey, form, (SELECT CASE WHEN count(*) = 1 THEN min(name) END FROM f WHERE acronym = form AND regexp_full_match(form, '[A-Z]{{2,8}}')) AS m1, (SELECT min(name) FROM f WHERE alias = lower(form)) AS m2, (SELECT min(name) FROM f WHERE f.key = t.key) AS m3, (SELECT min(name) FROM f WHERE f.bag = t.bag) AS m4 FROM t)
        SELECT p_partkey, form, coalesce(m1, m2, m3, m4, form) AS entity, CASE WHEN m1 IS NOT NULL THEN 'acronym' WHEN m2 IS NOT NULL THEN 'alias' WHEN m3 IS NOT NULL THEN 'key' WHEN m4 IS NOT NULL THEN 'words' ELSE 'new' END AS rule FROM m""",
    "acronym_definitions": rf"""WITH t AS (SELECT p_brand, CASE WHEN p_partkey % 3 = 0 THEN 'By ' || {_INIT} || ' (' || upper(p_name[1] || split_part(p_name, ' ', -1)[1]) || ') it says' WHEN p_partkey % 3 = 1 THEN {_INIT} || ' (XY)' ELSE p_name END AS text FROM part),
        x AS (SELECT p_brand, regexp_extract(text, '([A-Z][a-z]+ [A-Z][a-z]+) \(([A-Z]{{2,8}})\)', 1) AS name, regexp_extract(text, '([A-Z][a-z]+ [A-Z][a-z]+) \(([A-Z]{{2,8}})\)', 2) AS acronym FROM t)
        SELECT p_brand, acronym, min(name) AS name FROM x WHERE acronym <> '' AND name[1] || split_part(name, ' ', -1)[1] = acronym GROUP BY ALL HAVING count(DISTINCT name) = 1""",
    "search_texts": f"{_W} SELECT concat_ws(' ', s_name, lower(relation), p_name) AS text, count(*) AS n FROM claim LEFT JOIN supplier ON s_suppkey = subject AND s_suppkey % 4 > 0 LEFT JOIN part ON p_partkey = object AND p_partkey % 5 > 0 GROUP BY ALL",
}

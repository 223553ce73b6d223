"""Places: a gazetteer made of customers and parts, name lookups, and how named areas relate to a city."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import places as P
from lodestrata.operators.steps import counted, kept
from lodestrata.sources.claims import LEVELS, _pick
from lodestrata.sources.tables import table

NEARBY_KM = 1500.0
#: Parts in which the points of a name meet those asked about.
SHARDS = 16
_PLACE = {
    "place_id": "c_custkey", "name": "p_name", "country": "n_name", "region": "concat('Region ', c_custkey % 7)", "lat": "CAST(c_custkey * 37 % 160 - 80 AS DOUBLE)", "lon": "CAST(c_custkey * 53 % 340 - 170 AS DOUBLE)",
    "population": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(floor(c_acctbal) AS INT) END",
}
PLACE_SQL = "place AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _PLACE.items()) + " FROM customer JOIN part ON p_partkey = c_custkey JOIN nation ON n_nationkey = c_nationkey)"
#: What texts call an area, by place: every rule has its case.
_LABEL = """CASE CAST(place_id % 11 AS INT) WHEN 0 THEN name WHEN 1 THEN concat(name, ' District') WHEN 2 THEN concat('Greater ', name) WHEN 3 THEN concat('North ', name) WHEN 4 THEN concat(name, ', ', region)
  WHEN 5 THEN concat(name, ', Farland') WHEN 6 THEN concat('a part of ', name, ' City') WHEN 7 THEN 'blue ring' WHEN 8 THEN 'Atlantis' WHEN 9 THEN region ELSE country END"""
_LEVEL = _pick(LEVELS, "(place_id - place_id % 11) / 11")
_ASKED = f"{_LABEL} AS label, {_LEVEL} AS level, place_id % 2 = 0 AS city_named, place_id % 3 = 0 AS region_named"


def _places(spark: SparkSession, d: str) -> DataFrame:
    c, p, n = table(spark, d, "customer"), table(spark, d, "part"), table(spark, d, "nation")
    return c.join(p, F.col("p_partkey") == F.col("c_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey")).selectExpr(*(f"{e} AS {x}" for x, e in _PLACE.items()))


def area_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relation of the area that a text names to its city, by ordered rules over the places of that name.

    Sub-city figures need the city named; nations and states go by name; else: qualifiers must be the city's own, an
    area with the city's name needs the region where others share it, a name both near and far can't be placed, and an
    area not in the gazetteer counts by the words around the city's name.
    """
    asked = _places(spark, d).selectExpr("*", f"{_LABEL} AS label", f"{_LEVEL} AS level", "place_id % 2 = 0 AS city_named", "place_id % 3 = 0 AS region_named")
    head, tail = F.substring_index("label", ",", 1), F.when(F.contains("label", F.lit(",")), P.core(F.substring_index("label", ",", -1))).otherwise("")
    asked = asked.withColumn("full", P.place_key(head)).withColumn("core", P.core(head)).withColumn("tail", tail).withColumn("key", P.place_key(F.col("name")))
    known = _places(spark, d).select("place_id", "region", "lat", "lon", P.place_key(F.col("name")).alias("key"))
    # Places of one name are summed up by name, region and point, so no two of them meet.
    summed = kept(known.groupBy("key", "region", "lat", "lon").agg(F.count(F.lit(1)).alias("n")))
    names = counted(summed.groupBy("key").agg(F.sum("n").alias("named")))
    full, core = (names.select(F.col("key").alias(c), F.col("named").alias(f"{c}_named")) for c in ("full", "core"))
    by = asked.join(full, "full", "left").join(core, "core", "left").withColumn("named", F.coalesce("full_named", "core_named"))
    by = by.withColumn("hit", F.when(F.col("full_named").isNotNull(), F.col("full")).when(F.col("core_named").isNotNull(), F.col("core")))
    by = by.withColumn("removed", F.when(F.col("full_named").isNotNull(), F.array().cast("array<string>")).otherwise(F.array_except(F.split("full", " "), F.split("core", " "))))
    own_keys = known.groupBy("place_id", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("place_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("keys"))
    regions = counted(summed.groupBy(F.col("key").alias("hit"), "region").agg(F.sum("n").alias("in_region")))
    # Near and far count only for names that aren't the place's own: each pair of different points once.
    points = summed.select("key", "lat", "lon").distinct().withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))))
    foreign = by.where("hit IS NOT NULL AND hit <> key").select("hit", "lat", "lon").distinct().withColumn("shard", F.abs(F.hash("lat", "lon")) % SHARDS)
    km = P.haversine(F.col("f.lat"), F.col("f.lon"), F.col("p.lat"), F.col("p.lon"))
    met = foreign.alias("f").join(points.alias("p"), (F.col("f.hit") == F.col("p.key")) & (F.col("f.shard") == F.col("p.shard"))).select("f.hit", "f.lat", "f.lon", (km <= NEARBY_KM).alias("within"))
    reach = counted(met.groupBy("hit", "lat", "lon").agg(F.bool_or("within").alias("near"), F.bool_or(~F.col("within")).alias("far")))
    # A place's region follows from its id, so those of its own id are of its region.
    j = by.join(regions, ["hit", "region"], "left").join(reach, ["hit", "lat", "lon"], "left").join(own_keys, "place_id")
    place = Window.partitionBy("place_id")
    own_n = F.when(F.col("hit").isNotNull(), F.coalesce(F.try_element_at("keys", "hit"), F.lit(0)))
    j = j.withColumn("own", F.sum(own_n).over(place)).withColumn("others", F.sum(F.col("named") - own_n).over(place)).withColumn("same_region", F.sum(F.coalesce("in_region", F.lit(0)) - own_n).over(place))
    j = j.withColumn("near", F.bool_or("near").over(place)).withColumn("far", F.bool_or("far").over(place))
    own = F.array(F.col("key"), P.core(F.col("region")), P.core(F.col("country")))
    settled = F.col("region_named") | ((F.col("tail") != "") & (F.col("tail") == P.core(F.col("region"))))
    apart = F.when(F.col("near") & F.col("far"), "unresolved").when(F.col("near"), "nearby").otherwise("elsewhere")
    listed = F.when(F.col("own") == 0, apart).when((F.col("others") > 0) & (~settled | (F.col("same_region") > 0)), "unresolved").otherwise(P.city_fit(F.col("level"), P.word_class(F.col("removed"))))
    rest = P.word_class(F.array_except(F.split("full", " "), F.split("key", " ")))
    inside = F.when(rest.isNull() & F.col("city_named") & P.within_city(F.col("full"), F.col("key")), "city").otherwise(P.city_fit(F.col("level"), rest))
    unlisted = F.when(P.mentions(F.col("full"), F.col("key")), inside).otherwise("unresolved")
    local = F.when((F.col("tail") != "") & ~F.array_contains(own, F.col("tail")), "unresolved").when(F.col("hit").isNotNull(), listed).otherwise(unlisted)
    nation = F.when(P.same_name(F.col("label"), F.col("country"), P.NATION_WORDS) | P.country_code(F.col("label"), F.col("country")) | P.same_name(F.col("label"), F.col("region"), P.NATION_WORDS), "contains_city").otherwise("elsewhere")
    state = F.when(P.same_name(F.col("label"), F.col("region"), P.AREA_WORDS), "contains_city").when(F.col("region_named") & P.same_name(F.col("label"), F.col("name"), [*P.SAME_WORDS, "region"]), "city").otherwise("elsewhere")
    fit = F.when(F.col("level").isin("sub_city_area", "sub_city_population"), F.when(F.col("city_named"), "city").otherwise("unresolved")).when(F.col("level") == "global", "contains_city").when(F.col("level") == "national", nation).when(F.col("level") == "state_province", state).otherwise(local)
    return j.select("place_id", "label", "level", fit.alias("relation"))


def place_identity(spark: SparkSession, d: str) -> DataFrame:
    """Place with its country and, where it has one, its region (numbers 0 to 4 of seven are known)."""
    known = spark.range(5).select(F.concat(F.lit("Region "), "id").alias("region"), F.concat(F.lit("R"), "id").alias("code"))
    return _places(spark, d).join(F.broadcast(known), "region", "left").select("place_id", "name", "country", "code")


def places_named(spark: SparkSession, d: str) -> DataFrame:
    """The three largest places of each key that a part's name or type holds; places without population last."""
    keys = table(spark, d, "part").select(F.explode(F.array_distinct(F.array(P.place_key(F.col("p_name")), P.place_key(F.col("p_type"))))).alias("key")).distinct()
    w = Window.partitionBy("key").orderBy(F.col("population").desc_nulls_last(), "place_id")
    return _places(spark, d).withColumn("key", P.place_key(F.col("name"))).join(keys, "key", "left_semi").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("key", "place_id", "rank")


def large_place_names(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names, as written and in capitals, of places with 5,000 people or more."""
    big = _places(spark, d).where("population >= 5000")
    return big.select(F.col("name")).union(big.select(F.upper("name"))).distinct()


def places_of_known_regions(spark: SparkSession, d: str) -> DataFrame:
    """Places kept and skipped because their region isn't known, by country."""
    known = F.col("region").isin(*[f"Region {i}" for i in range(5)])
    return _places(spark, d).groupBy("country").agg(F.count_if(known).alias("kept"), F.count_if(~known).alias("skipped"))


def alternate_names(spark: SparkSession, d: str) -> DataFrame:
    """Alternate names of a place that look like names and bring a new key."""
    alternates = F.array(F.initcap("name"), F.upper("name"), F.concat(F.lit("Old "), F.initcap("name")), F.lit("Xy"), F.concat(F.initcap("name"), F.lit("'s")), F.col("country"))
    kept = F.filter(F.transform(alternates, lambda a: F.when(P.looks_like_name(a) & (P.place_key(a) != P.place_key(F.col("name"))), a)), lambda a: a.isNotNull())
    return _places(spark, d).select("place_id", F.array_join(F.array_distinct(kept), "|").alias("alternates"))


def pages_naming_places(spark: SparkSession, d: str) -> DataFrame:
    """Per supplier: whether a text names its own city, and whether it names another and not its own."""
    s = table(spark, d, "supplier").join(_places(spark, d).select("place_id", "name"), F.col("s_suppkey") == F.col("place_id"))
    text = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("News of "), "name", F.lit(" today"))).when(F.col("s_suppkey") % 3 == 1, "http://x.org/small-ring/red-widget").otherwise(F.concat(F.col("name"), F.lit("ia and others")))
    named, other = P.mentions(text, F.col("name")), P.mentions(text, F.lit("small ring")) | P.mentions(text, F.lit("red widget"))
    return s.select("s_suppkey", named.alias("own"), (other & ~named).alias("other_place"))


ALIASES = {"first region": "region 1", "deux": "region 2"}


def region_matches(spark: SparkSession, d: str) -> DataFrame:
    """Whether a provider's region is the place's own, by key or by alias."""
    given = F.when(F.col("place_id") % 4 == 0, F.upper("region")).when(F.col("place_id") % 4 == 1, "First Region").when(F.col("place_id") % 4 == 2, "Deux").otherwise("Region 3 District")
    alias = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), P.place_key(given)), P.place_key(given))
    return _places(spark, d).select("place_id", (alias == P.place_key(F.col("region"))).alias("same"))


def resolved_places(spark: SparkSession, d: str) -> DataFrame:
    """For each part type's first letters: exact names first, then similar ones, and whether the best is clear.

    Similarity is the share of common trigrams. A name is resolved if it equals the query, or is over 0.1 ahead.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    names = _places(spark, d).groupBy(P.place_key(F.col("name")).alias("key")).agg(F.max("population").alias("population"), F.min("place_id").alias("place_id")).withColumn("g", grams(F.col("key")))
    asked = table(spark, d, "part").select(F.substring(P.place_key(F.col("p_name")), 1, 8).alias("query")).distinct().withColumn("q", grams(F.col("query")))
    # Names and queries meet on a common trigram.
    met = asked.select("query", F.size("q").alias("nq"), F.explode("q").alias("t")).join(names.select("key", F.size("g").alias("ng"), F.explode("g").alias("t")), "t").groupBy("query", "key").agg(F.count(F.lit(1)).alias("common"), F.first("nq").alias("nq"), F.first("ng").alias("ng"))
    scored = met.select("query", "key", F.round(F.col("common") / (F.col("nq") + F.col("ng") - F.col("common")), 6).alias("score")).where("score >= 0.3")
    w = Window.partitionBy("query").orderBy((F.col("key") == F.col("query")).desc(), F.col("score").desc(), F.col("population").desc_nulls_last(), "place_id")
    ranked = scored.join(names.select("key", "population", "place_id"), "key").withColumn("rank", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    return ranked.where("rank = 1").select("query", "key", "score", ((F.col("key") == F.col("query")) | (F.round(F.col("score") - F.col("next"), 6) > 0.1)).alias("resolved"))


QUERIES = {f.__name__: f for f in (area_relations, place_identity, places_named, large_place_names, places_of_known_regions, alternate_names, pages_naming_places, region_matches, resolved_places)}


def _kw(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({x}, '')), '[''’]s\b', '', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def _key(x: str) -> str:
    return f"array_to_string({_kw(x)}, ' ')"


def _core(x: str, words: list[str] = P.AREA_WORDS) -> str:
    return f"array_to_string(list_filter({_kw(x)}, lambda w: NOT list_contains({words}, w)), ' ')"


def _same(a: str, b: str, words: list[str]) -> str:
    return f"({_core(b, words)} <> '' AND {_core(a, words)} = {_core(b, words)})"


def _class(removed: str) -> str:
    return f"CASE WHEN len(list_filter({removed}, lambda w: NOT list_contains({P.AREA_WORDS}, w))) > 0 THEN NULL WHEN list_has_any({removed}, {P.OTHER_WORDS}) THEN 'other' WHEN list_has_any({removed}, {P.WIDER_WORDS}) THEN 'wider' ELSE 'same' END"


def _fit(words: str) -> str:
    return f"CASE WHEN ({words}) IS NULL OR ({words}) = 'other' THEN 'unresolved' WHEN ({words}) = 'same' AND level IN ('city_wide', 'sub_city_area', 'sub_city_population') THEN 'city' ELSE 'contains_city' END"


def _mentions(text: str, name: str) -> str:
    return f"({_key(name)} <> '' AND contains(' ' || {_key(text)} || ' ', ' ' || {_key(name)} || ' '))"


_KM = "2 * 6371 * asin(sqrt(least(pow(sin(radians(k.lat - b.lat) / 2), 2) + cos(radians(b.lat)) * cos(radians(k.lat)) * pow(sin(radians(k.lon - b.lon) / 2), 2), 1.0)))"
_WITHIN = " OR ".join(f"(ends_with(full_, {t}) AND length(full_) > length({t}))" for p in P.WITHIN for t in (f"(' {p} ' || key)", f"(' {p} the ' || key)", f"(' {p} ' || key || ' city')"))
_RESTW = "list_filter(string_split(full_, ' '), lambda w: NOT list_contains(string_split(key, ' '), w))"
_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - 2, 1) + 1), lambda i: substring({0}, i::INT, 3)))"

ORACLES = {
    "area_relations": f"""WITH {PLACE_SQL}, a AS (SELECT *, {_ASKED} FROM place),
        b AS (SELECT *, {_key("split_part(label, ',', 1)")} AS full_, {_core("split_part(label, ',', 1)")} AS core_, CASE WHEN contains(label, ',') THEN {_core("split_part(label, ',', 2)")} ELSE '' END AS tail, {_key('name')} AS key FROM a),
        h AS (SELECT *, CASE WHEN full_ IN (SELECT key FROM b) THEN full_ WHEN core_ IN (SELECT key FROM b) THEN core_ END AS hit, CASE WHEN full_ IN (SELECT key FROM b) THEN []::VARCHAR[] ELSE list_filter(string_split(full_, ' '), lambda w: NOT list_contains(string_split(core_, ' '), w)) END AS removed FROM b),
        s AS (SELECT b.place_id, count(*) FILTER (WHERE k.place_id <> b.place_id) AS others, count(*) FILTER (WHERE k.place_id = b.place_id) AS own, count(*) FILTER (WHERE k.place_id <> b.place_id AND k.region = b.region) AS same_region, count(*) FILTER (WHERE k.place_id <> b.place_id AND {_KM} <= {NEARBY_KM}) AS near
          FROM h b JOIN b k ON k.key = b.hit GROUP BY b.place_id)
        SELECT place_id, label, level, CASE WHEN level IN ('sub_city_area', 'sub_city_population') THEN CASE WHEN city_named THEN 'city' ELSE 'unresolved' END WHEN level = 'global' THEN 'contains_city'
          WHEN level = 'national' THEN CASE WHEN {_same('label', 'country', P.NATION_WORDS)} OR {_same('label', 'region', P.NATION_WORDS)} OR (len({_kw('country')}) > 1 AND regexp_replace(lower(label), '[^a-z0-9]', '', 'g') = array_to_string(list_transform({_kw('country')}, lambda w: w[1]), '')) THEN 'contains_city' ELSE 'elsewhere' END
          WHEN level = 'state_province' THEN CASE WHEN {_same('label', 'region', P.AREA_WORDS)} THEN 'contains_city' WHEN region_named AND {_same('label', 'name', [*P.SAME_WORDS, 'region'])} THEN 'city' ELSE 'elsewhere' END
          WHEN tail <> '' AND tail NOT IN (key, {_core('region')}, {_core('country')}) THEN 'unresolved'
          WHEN hit IS NOT NULL THEN CASE WHEN own = 0 THEN CASE WHEN near > 0 AND near < others THEN 'unresolved' WHEN near > 0 THEN 'nearby' ELSE 'elsewhere' END
            WHEN others > 0 AND (NOT (region_named OR (tail <> '' AND tail = {_core('region')})) OR same_region > 0) THEN 'unresolved' ELSE {_fit(_class('removed'))} END
          WHEN {_mentions('full_', 'key')} THEN CASE WHEN ({_class(_RESTW)}) IS NULL AND city_named AND ({_WITHIN}) THEN 'city' ELSE {_fit(_class(_RESTW))} END ELSE 'unresolved' END AS relation
        FROM h LEFT JOIN s USING (place_id)""",
    "place_identity": f"WITH {PLACE_SQL} SELECT place_id, name, country, CASE WHEN place_id % 7 < 5 THEN 'R' || (place_id % 7) END AS code FROM place",
    "places_named": f"""WITH {PLACE_SQL}, k AS (SELECT {_key('p_name')} AS key FROM part UNION SELECT {_key('p_type')} FROM part), r AS (SELECT key, place_id, CAST(row_number() OVER (PARTITION BY key ORDER BY population DESC NULLS LAST, place_id) AS INT) AS rank FROM (SELECT *, {_key('name')} AS key FROM place) WHERE key IN (SELECT key FROM k))
        SELECT key, place_id, rank FROM r WHERE rank <= 3""",
    "large_place_names": f"WITH {PLACE_SQL} SELECT name FROM place WHERE population >= 5000 UNION SELECT upper(name) FROM place WHERE population >= 5000",
    "places_of_known_regions": f"WITH {PLACE_SQL} SELECT country, count(*) FILTER (WHERE place_id % 7 < 5) AS kept, count(*) FILTER (WHERE place_id % 7 >= 5) AS skipped FROM place GROUP BY ALL",
    "alternate_names": rf"""WITH {PLACE_SQL}, i AS (SELECT *, array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS init FROM place),
        a AS (SELECT place_id, name, [init, upper(name), 'Old ' || init, 'Xy', init || '''s', country] AS alts FROM i),
        f AS (SELECT place_id, list_filter(alts, lambda a: length(a) >= 5 AND regexp_full_match(a, '\p{{Lu}}[\p{{L}} .''-]*') AND a <> upper(a) AND {_key('a')} <> {_key('name')}) AS alts FROM a)
        SELECT place_id, array_to_string(list_filter(alts, lambda a, i: list_position(alts, a) = i), '|') AS alternates FROM f""",
    "pages_naming_places": f"""WITH {PLACE_SQL}, s AS (SELECT s_suppkey, name, CASE WHEN s_suppkey % 3 = 0 THEN 'News of ' || name || ' today' WHEN s_suppkey % 3 = 1 THEN 'http://x.org/small-ring/red-widget' ELSE name || 'ia and others' END AS text FROM supplier JOIN place ON place_id = s_suppkey)
        SELECT s_suppkey, {_mentions('text', 'name')} AS own, ({_mentions('text', "'small ring'")} OR {_mentions('text', "'red widget'")}) AND NOT {_mentions('text', 'name')} AS other_place FROM s""",
    "region_matches": f"WITH {PLACE_SQL}, g AS (SELECT *, CASE WHEN place_id % 4 = 0 THEN lower(region) WHEN place_id % 4 = 1 THEN 'region 1' WHEN place_id % 4 = 2 THEN 'region 2' ELSE 'region 3 district' END AS given FROM place) SELECT place_id, given = lower(region) AS same FROM g",
    "resolved_places": f"""WITH {PLACE_SQL}, n AS (SELECT {_key('name')} AS key, max(population) AS population, min(place_id) AS place_id FROM place GROUP BY 1), ng AS (SELECT *, {_GRAMS.format('key')} AS g FROM n),
        q AS (SELECT DISTINCT substring({_key('p_name')}, 1, 8) AS query FROM part), qg AS (SELECT *, {_GRAMS.format('query')} AS q FROM q),
        s AS (SELECT query, key, population, place_id, round(len(list_intersect(q, g)) / len(list_distinct(list_concat(q, g))), 6) AS score FROM qg, ng WHERE list_has_any(q, g)),
        r AS (SELECT *, row_number() OVER w AS rk, coalesce(lead(score) OVER w, 0) AS nxt FROM s WHERE score >= CAST(0.3 AS DOUBLE) WINDOW w AS (PARTITION BY query ORDER BY key = query DESC, score DESC, population DESC NULLS LAST, place_id))
        SELECT query, key, score, key = query OR round(score - nxt, 6) > CAST(0.1 AS DOUBLE) AS resolved FROM r WHERE rk = 1""",
}

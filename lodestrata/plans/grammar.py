"""Values, numbers, names and keys as written: each rule on texts that hold all its cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import grammar as G
from lodestrata.functions import judging as J
from lodestrata.functions.values import plain_number
from lodestrata.sources.claims import CLAIM_SQL, claims
from lodestrata.sources.tables import table

#: Texts made from numbers of lines, one form by remainder; read by Spark and DuckDB alike.
_Q, _P = "CAST(l_quantity AS INT)", "CAST(floor(l_extendedprice) AS INT)"
VALUE_TEXT = f"""CASE CAST(l_partkey % 14 AS INT) WHEN 0 THEN concat({_Q}, '%') WHEN 1 THEN concat({_Q}, '.5 per cent') WHEN 2 THEN concat({_Q}, '–', {_Q} + 3, ' %')
  WHEN 3 THEN concat({_Q}, '% (95% CI ', {_Q} - 1, ' to ', {_Q} + 1, ')') WHEN 4 THEN concat({_Q}, ' (95 % CI: ', {_Q} - 1, '-', {_Q} + 2, ')') WHEN 5 THEN concat({_Q}, ',4 per 100,000')
  WHEN 6 THEN concat({_Q}, ',', 100 + {_Q}) WHEN 7 THEN concat(1990 + {_Q}) WHEN 8 THEN concat({_Q}, '.125%') WHEN 9 THEN concat('about ', {_Q}) WHEN 10 THEN concat({_Q}, ',', {_Q} % 10, '%')
  WHEN 11 THEN concat({_Q}, ' ', 100 + {_Q}, ' ', 200 + {_Q}) WHEN 12 THEN concat('0.', {_Q}, '%') ELSE concat({_Q}, '.', 100 + {_Q}, ',5 percent') END"""
SIZE_TEXT = f"CASE CAST(l_partkey % 6 AS INT) WHEN 0 THEN concat('n = ', {_Q}) WHEN 1 THEN concat({_Q}, ',', 100 + {_Q}, ' adults') WHEN 2 THEN concat({_Q}, ' of ', {_P}) WHEN 3 THEN concat({_Q}, '.5') WHEN 4 THEN concat({_Q}, ' ', 100 + {_Q}, ' people') ELSE 'adults' END"


def written_values(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct value text with its value, unit and bounds."""
    t = table(spark, d, "lineitem").selectExpr(f"{VALUE_TEXT} AS text").distinct()
    return t.withColumn("x", G.written_value(F.col("text"))).select("text", "x.*")


def sample_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(f"{SIZE_TEXT} AS text").distinct().select("text", G.sample_size(F.col("text")).alias("people"))


def values_with_unit(spark: SparkSession, d: str) -> DataFrame:
    """The unit as written, else that of the register for a bare number."""
    t = table(spark, d, "lineitem").selectExpr(f"{VALUE_TEXT} AS text", "CASE WHEN l_partkey % 2 = 0 THEN 'percent' ELSE 'people' END AS register").distinct()
    bare = plain_number(G.cleaned(F.col("text"))).cast("double")
    t = t.withColumn("x", G.written_value(F.col("text")))
    return t.select("text", "register", F.when(F.col("x.unparsed"), bare).otherwise(F.col("x.value")).alias("value"), F.coalesce("x.unit", F.when(F.col("x.unparsed") & bare.isNotNull(), F.col("register"))).alias("unit"))


def unsupported_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a turn, years apart, that its earlier turn doesn't have whole."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    shown = F.concat_ws(" ", F.col("text"), F.lit("has"), F.col("turn") * 7, F.concat(F.col("turn"), F.lit(".5 in 2019 and")), F.col("conv_id"))
    t = table(spark, d, "conversations").withColumn("now", shown).withColumn("before", F.lag("now").over(w))
    lost = F.array_except(G.number_tokens(F.col("now")), G.number_tokens(F.col("before")))
    return t.select("conv_id", "turn", "role", F.size(lost).cast("long").alias("unsupported"))


def numbers_standing(spark: SparkSession, d: str) -> DataFrame:
    """Whether each line's quantity stands in a text in one of its writings."""
    text = f"CASE CAST(l_partkey % 5 AS INT) WHEN 0 THEN concat('in all ', {_Q}, '.0 beds') WHEN 1 THEN concat({_Q} * 100, ' of them') WHEN 2 THEN concat('of ', {_Q} * 1000 + 1) WHEN 3 THEN concat('2', {_Q}, ' and ', {_Q}, ',0') ELSE concat('x', {_Q}, '5') END"
    t = table(spark, d, "lineitem").selectExpr(f"{_Q} AS q", f"{text} AS text").distinct()
    return t.select("q", "text", G.stands_in(F.col("q"), F.col("text")).alias("stands"))


def unknown_names(spark: SparkSession, d: str) -> DataFrame:
    """Names and acronyms of a document that its first half doesn't have: what a gate would take out."""
    t = table(spark, d, "documents").select("doc_id", "text", F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")).alias("allowed"))
    return t.select("doc_id", F.size(F.array_except(G.names_in(F.col("text")), G.names_in(F.col("allowed")))).cast("long").alias("unknown"))


STOP = ["the", "and", "de", "la", "der", "und", "el", "que", "of", "is"]


def question_words(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "benchmark")
    return t.select("item_id", F.array_join(G.words(F.col("text"), STOP, F.substring("text", 1, 12)), " ").alias("words"))


def dedup_keys(spark: SparkSession, d: str) -> DataFrame:
    """Key of what a claim says: its triple if it is a relation, else its kind, value and unit; claims of each."""
    c = claims(spark, d, "kind", "hundredths", "unit", "subject", "relation", "object")
    triple, plain = F.concat_ws("\x1f", "subject", "relation", "object"), F.concat_ws("\x1f", "kind", F.coalesce(F.col("hundredths").cast("string"), F.lit("")), "unit")
    return c.groupBy(F.sha2(F.when(F.col("kind") == "relation", triple).otherwise(plain), 256).alias("key")).agg(F.count(F.lit(1)).alias("n"))


NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def named_ids(spark: SparkSession, d: str) -> DataFrame:
    """Name-based uuid, short base-32 id and file name of every page."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return table(spark, d, "pages").select("page_id", G.uuid5(NAMESPACE, url).alias("uuid"), G.base32(F.sha2(url, 256), 12).alias("short"), G.slug(url).alias("file"))


def anniversaries(spark: SparkSession, d: str) -> DataFrame:
    """The same day one and three years before each order date; whole months between the two dates of a line."""
    o, li = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day")), table(spark, d, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("ship"))
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("day", J.years_before(F.col("day"), 1).alias("one"), J.years_before(F.col("day"), 3).alias("three")).agg(F.sum(J.months_apart(F.col("day"), F.col("ship"))).cast("long").alias("months"))


def claim_flags(spark: SparkSession, d: str) -> DataFrame:
    """The date of publication stands in for a missing period; flags of what isn't stated, counted."""
    c = claims(spark, d)
    held = {"period_not_stated": F.col("ref_end").isNull(), "denominator_not_stated": ~F.col("denominator_stated"), "small_sample": F.col("sample_size") < 300, "non_representative": F.col("sampling") == "non_representative", "value_unparsed": F.col("hundredths").isNull(), "setting_not_stated": F.col("setting") == "not_stated", "translated": F.col("source_id") % 3 == 0}
    flags = F.array_join(F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in held.items()])), ",")
    return c.groupBy(flags.alias("flags"), F.coalesce(F.year("ref_end"), F.year("valid_from")).alias("year")).agg(F.count(F.lit(1)).alias("n"))


def grounded_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels whose numbers aren't in the evidence are cleared: sample, least age, year."""
    c = claims(spark, d, "claim_id", "sample_size", "age_min", "ref_end").withColumn("evidence", F.concat_ws(" ", F.lit("We asked"), F.when(F.col("claim_id") % 2 == 0, F.col("sample_size")), F.lit("people aged"), F.when(F.col("claim_id") % 3 == 0, F.col("age_min")), F.lit("or more in"), F.when(F.col("claim_id") % 5 == 0, F.year("ref_end"))))
    kept = lambda x: F.when(G.stands_in(x, F.col("evidence")), x)
    return c.select("claim_id", kept(F.col("sample_size")).alias("sample_size"), kept(F.col("age_min")).alias("age_min"), kept(F.year("ref_end")).alias("year"))


def canonical_records(spark: SparkSession, d: str) -> DataFrame:
    """Official figures as one line each, read back and compared field by field; per indicator."""
    c = claims(spark, d, "indicator", "city_id", "ref_end", "hundredths").where("hundredths IS NOT NULL")
    line = F.concat_ws(";", F.concat(F.lit("indicator="), "indicator"), F.concat(F.lit("place="), "city_id"), F.concat(F.lit("year="), F.coalesce(F.year("ref_end").cast("string"), F.lit(""))), F.concat(F.lit("value="), "hundredths"))
    again = F.str_to_map(F.col("line"), F.lit(";"), F.lit("="))
    c = c.withColumn("line", line).withColumn("again", again)
    same = (F.col("again")["indicator"].cast("int") == F.col("indicator")) & (F.col("again")["place"].cast("long") == F.col("city_id")) & (F.col("again")["year"].try_cast("int").eqNullSafe(F.year("ref_end"))) & (F.col("again")["value"].cast("long") == F.col("hundredths"))
    return c.groupBy("indicator").agg(F.count_if(same).alias("same"), F.count(F.lit(1)).alias("n"), F.min("line").alias("first"))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """A supported verdict with any issue is insufficient; the rationale has 40 characters at most."""
    j = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id")
    plain = F.when(F.col("quality") == 1, "supported").otherwise("refuted")
    return j.select("doc_id", F.when((plain == "supported") & (F.col("toxic") == 1), "insufficient").otherwise(plain).alias("verdict"), F.substring("text", 1, 40).alias("rationale"))


def highlights(spark: SparkSession, d: str) -> DataFrame:
    """The first mention of a term with 30 characters on each side, and where it is in them."""
    t = table(spark, d, "documents").select("doc_id", "text", F.instr(F.lower("text"), " the ").alias("at")).where("at > 0")
    start = F.greatest(F.col("at") - 30, F.lit(1))
    return t.select("doc_id", F.substring("text", start, (F.col("at") - start + 35).cast("int")).alias("window"), (F.col("at") - start).cast("long").alias("from"), (F.col("at") - start + 5).cast("long").alias("to"))


def search_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of more than three letters in a part's name and type, sorted, once each."""
    ws = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), "[^a-z0-9]+")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(F.filter(ws, lambda w: F.length(w) > 3))), " ").alias("words"))


def public_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that a fetch may go to, of ones made from page numbers."""
    address = "CASE WHEN page_id % 7 = 0 THEN concat('10.', page_id % 256, '.0.1') WHEN page_id % 7 = 1 THEN concat('172.', page_id % 64, '.1.1') WHEN page_id % 7 = 2 THEN concat('::ffff:192.168.', page_id % 300, '.9') WHEN page_id % 7 = 3 THEN concat(page_id % 256, '.', page_id % 70 + 60, '.3.4') WHEN page_id % 7 = 4 THEN '1.2.3' ELSE concat('169.', page_id % 5 + 251, '.7.7') END"
    return table(spark, d, "pages").selectExpr("page_id", f"{address} AS address").select("page_id", "address", G.is_public(F.col("address")).alias("public"))


AI_KEYS = ["train-ai", "ai-output"]


def usage_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Whether a page's usage header forbids use by models: any AI key that says n or no."""
    header = "CASE CAST(page_id % 6 AS INT) WHEN 0 THEN 'train-ai=n' WHEN 1 THEN 'search=y, Train-AI=y' WHEN 2 THEN 'ai-output=NO; search=n' WHEN 3 THEN 'train-ai=n, train-ai=y' WHEN 4 THEN NULL ELSE 'nonsense, train-ai' END"
    p = table(spark, d, "pages").selectExpr("page_id", f"{header} AS header").withColumn("prefs", G.preferences(F.col("header")))
    blocked = F.lit(False)
    for key in AI_KEYS:
        blocked = blocked | F.coalesce(F.try_element_at("prefs", F.lit(key)).isin("n", "no"), F.lit(False))
    return p.select("page_id", blocked.alias("blocked"))


def retry_waits(spark: SparkSession, d: str) -> DataFrame:
    """Seconds to wait, and what a failed fetch counts as."""
    header = "CASE CAST(event_id % 5 AS INT) WHEN 0 THEN concat(event_id) WHEN 1 THEN 'Tue, 30 Jan 2024 12:00:00 GMT' WHEN 2 THEN 'soon' WHEN 3 THEN NULL ELSE '-5' END"
    e = table(spark, d, "events").selectExpr("event_id", "ts", "event_type", f"{header} AS header")
    outcome = F.when(F.col("event_type") == "error", "unreachable").when(F.col("event_type").isin("login", "signup"), "blocked_login").when(F.col("header").isNull(), "blocked_robots").otherwise("fetched")
    return e.select("event_id", G.retry_after(F.col("header"), F.date_trunc("second", "ts"), 3600).alias("wait"), outcome.alias("outcome"))


QUERIES = {f.__name__: f for f in (written_values, sample_sizes, values_with_unit, unsupported_numbers, numbers_standing, unknown_names, question_words, dedup_keys, named_ids, anniversaries, claim_flags, grounded_labels, canonical_records, verdicts, highlights, search_words, public_addresses, usage_decisions, retry_waits)}


def _num(t: str) -> str:
    """DuckDB: a whole string as a number, or null."""
    m = lambda p: f"regexp_full_match({t}, '{p}')"
    return f"""CASE WHEN {m('[0-9]+')} THEN TRY_CAST({t} AS DOUBLE) WHEN {m('0[.,][0-9]+')} THEN TRY_CAST(replace({t}, ',', '.') AS DOUBLE)
      WHEN {m('[1-9][0-9]{0,2}([, ][0-9]{3})+([.][0-9]+)?')} AND NOT regexp_matches({t}, '^[0-9]+,[0-9]{{3}} ') THEN TRY_CAST(regexp_replace({t}, '[, ]', '', 'g') AS DOUBLE)
      WHEN {m('[1-9][0-9]{0,2}([.][0-9]{3})+(,[0-9]+)?')} THEN TRY_CAST(replace(replace({t}, '.', ''), ',', '.') AS DOUBLE)
      WHEN {m('[0-9]+[.][0-9]+')} THEN TRY_CAST({t} AS DOUBLE) WHEN {m('[0-9]+,[0-9]{1,2}')} THEN TRY_CAST(replace({t}, ',', '.') AS DOUBLE) END"""


def _re(p: str) -> str:
    return p.replace("'", "''")


_T = "lower(trim(regexp_replace(translate(text, '–—−   ％', '---   %'), '\\s+', ' ', 'g')))"
_PARSED = f"""s AS (SELECT *, {_T} AS t FROM raw), x AS (SELECT *, CASE WHEN regexp_matches(t, '{_re(G._CI)}') THEN 1 WHEN regexp_matches(t, '{_re(G._RANGE)}') THEN 2 WHEN regexp_matches(t, '{_re(G._SHARE)}') THEN 3 WHEN regexp_matches(t, '{_re(G._RATE)}') THEN 4 WHEN regexp_matches(t, '{_re(G._GROUPED)}') THEN 5 ELSE 0 END AS form FROM s),
  y AS (SELECT *, CASE form WHEN 1 THEN regexp_extract(t, '{_re(G._CI)}', 1) WHEN 3 THEN regexp_extract(t, '{_re(G._SHARE)}', 1) WHEN 4 THEN regexp_extract(t, '{_re(G._RATE)}', 1) WHEN 5 THEN t END AS v,
    CASE form WHEN 1 THEN regexp_extract(t, '{_re(G._CI)}', 3) WHEN 2 THEN regexp_extract(t, '{_re(G._RANGE)}', 1) END AS lo, CASE form WHEN 1 THEN regexp_extract(t, '{_re(G._CI)}', 4) WHEN 2 THEN regexp_extract(t, '{_re(G._RANGE)}', 2) END AS hi,
    CASE WHEN form IN (2, 3) OR (form = 1 AND regexp_extract(t, '{_re(G._CI)}', 2) <> '') THEN 'percent' WHEN form = 4 THEN 'per_100k' WHEN form = 5 THEN 'count' END AS u FROM x),
  z AS (SELECT *, form > 0 AND (v IS NULL OR {_num('v')} IS NOT NULL) AND (lo IS NULL OR {_num('lo')} IS NOT NULL) AND (hi IS NULL OR {_num('hi')} IS NOT NULL)
    AND NOT (u = 'percent' AND (coalesce(regexp_matches(v, '{G._ONE_GROUP}'), false) OR coalesce(regexp_matches(lo, '{G._ONE_GROUP}'), false) OR coalesce(regexp_matches(hi, '{G._ONE_GROUP}'), false))) AS ok_ FROM y),
  p AS (SELECT *, coalesce(ok_, form > 0 AND u IS NULL AND {_num('v')} IS NOT NULL AND {_num('lo')} IS NOT NULL AND {_num('hi')} IS NOT NULL) AS ok FROM z)"""
_TOKENS = "regexp_extract_all({}, '[0-9]+(?:[.,][0-9]+)*')"
_GATE = "list_filter(list_distinct(" + _TOKENS.format("coalesce({}, '')") + "), lambda x: NOT regexp_full_match(x, '(19|20)[0-9]{{2}}'))"
_WRITINGS = "[{0}::VARCHAR, {0} || '.0', {0} || ',0', format('{{:,}}', {0}), replace(format('{{:,}}', {0}), ',', '.')]"


def _stands(n: str, text: str) -> str:
    return f"list_has_any({_WRITINGS.format(n)}, {_TOKENS.format(text)})"


_NAMES = "list_distinct(regexp_extract_all({}, '[A-Z][a-z]+(?: [A-Z][a-z]+)+|[A-Z]{{2,}}'))"
_ADDR = "CASE WHEN page_id % 7 = 0 THEN concat('10.', page_id % 256, '.0.1') WHEN page_id % 7 = 1 THEN concat('172.', page_id % 64, '.1.1') WHEN page_id % 7 = 2 THEN concat('::ffff:192.168.', page_id % 300, '.9') WHEN page_id % 7 = 3 THEN concat(page_id % 256, '.', page_id % 70 + 60, '.3.4') WHEN page_id % 7 = 4 THEN '1.2.3' ELSE concat('169.', page_id % 5 + 251, '.7.7') END"
_FLAGS = "list_filter([CASE WHEN ref_end IS NULL THEN 'period_not_stated' END, CASE WHEN NOT denominator_stated THEN 'denominator_not_stated' END, CASE WHEN sample_size < 300 THEN 'small_sample' END, CASE WHEN sampling = 'non_representative' THEN 'non_representative' END, CASE WHEN hundredths IS NULL THEN 'value_unparsed' END, CASE WHEN setting = 'not_stated' THEN 'setting_not_stated' END, CASE WHEN source_id % 3 = 0 THEN 'translated' END], lambda x: x IS NOT NULL)"
_NETS = " OR ".join(f"(n >> {32 - k}) = {sum(int(x) << s for x, s in zip(a.split('.'), (24, 16, 8, 0))) >> (32 - k)}" for a, k in G.CLOSED_NETWORKS)
_STAND_TEXT = f"CASE CAST(l_partkey % 5 AS INT) WHEN 0 THEN concat('in all ', {_Q}, '.0 beds') WHEN 1 THEN concat({_Q} * 100, ' of them') WHEN 2 THEN concat('of ', {_Q} * 1000 + 1) WHEN 3 THEN concat('2', {_Q}, ' and ', {_Q}, ',0') ELSE concat('x', {_Q}, '5') END"

ORACLES = {
    "written_values": f"WITH raw AS (SELECT DISTINCT {VALUE_TEXT} AS text FROM lineitem), {_PARSED} SELECT text, CASE WHEN ok AND form <> 2 THEN {_num('v')} END AS value, CASE WHEN ok THEN u END AS unit, CASE WHEN ok THEN {_num('lo')} END AS lower, CASE WHEN ok THEN {_num('hi')} END AS upper, NOT ok AS unparsed FROM p",
    "sample_sizes": rf"""WITH raw AS (SELECT DISTINCT {SIZE_TEXT} AS text FROM lineitem), s AS (SELECT text, regexp_replace(lower(text), '([0-9])[ ,.]([0-9]{{3}})\b', '\1\2', 'g') AS t FROM raw)
        SELECT text, CASE WHEN len(regexp_extract_all(t, '[0-9]+')) = 1 AND NOT regexp_matches(t, '[0-9][.,][0-9]{{1,2}}\b') THEN nullif(TRY_CAST(regexp_extract(t, '[0-9]+') AS BIGINT), 0) END AS people FROM s""",
    "values_with_unit": f"WITH raw AS (SELECT DISTINCT {VALUE_TEXT} AS text, CASE WHEN l_partkey % 2 = 0 THEN 'percent' ELSE 'people' END AS register FROM lineitem), {_PARSED} SELECT text, register, CASE WHEN ok THEN CASE WHEN form <> 2 THEN {_num('v')} END ELSE {_num('t')} END AS value, CASE WHEN ok THEN u WHEN {_num('t')} IS NOT NULL THEN register END AS unit FROM p",
    "unsupported_numbers": f"""WITH c AS (SELECT *, concat_ws(' ', text, 'has', turn * 7, concat(turn, '.5 in 2019 and'), conv_id) AS now FROM conversations), b AS (SELECT *, lag(now) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c)
        SELECT conv_id, turn, role, len(list_filter({_GATE.format('now')}, lambda x: NOT list_contains({_GATE.format('before')}, x)))::BIGINT AS unsupported FROM b""",
    "numbers_standing": f"WITH raw AS (SELECT DISTINCT {_Q} AS q, {_STAND_TEXT} AS text FROM lineitem) SELECT q, text, {_stands('q', 'text')} AS stands FROM raw",
    "unknown_names": f"SELECT doc_id, len(list_filter({_NAMES.format('text')}, lambda x: NOT list_contains({_NAMES.format('substring(text, 1, length(text) // 2)')}, x)))::BIGINT AS unknown FROM documents",
    "question_words": rf"""WITH w AS (SELECT item_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS ws FROM benchmark),
        f AS (SELECT item_id, list_filter(ws, lambda w: NOT list_contains({STOP}, w) AND NOT list_contains(regexp_split_to_array(lower(substring(text, 1, 12)), ' +'), w)) AS ws FROM w)
        SELECT item_id, array_to_string(list_filter(ws, lambda w, i: list_position(ws, w) = i), ' ') AS words FROM f""",
    "dedup_keys": f"WITH {CLAIM_SQL} SELECT sha256(CASE WHEN kind = 'relation' THEN concat_ws(chr(31), subject, relation, object) ELSE concat_ws(chr(31), kind, coalesce(hundredths::VARCHAR, ''), unit) END) AS key, count(*) AS n FROM claim GROUP BY ALL",
    "named_ids": rf"""WITH p AS (SELECT page_id, coalesce(url, '') AS u FROM pages), h AS (SELECT *, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode(u)) AS h, sha256(u) AS s FROM p)
        SELECT page_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || substring('89ab', CAST(('0x' || substring(h, 17, 1))::INT % 4 AS INT) + 1, 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS uuid,
          array_to_string(list_transform(range(12), lambda i: substring('abcdefghijklmnopqrstuvwxyz234567', CAST((('0x' || substring(s, CAST(i // 4 * 5 + 1 AS INT), 5))::INT >> (15 - 5 * (i % 4))::INT) & 31 AS INT) + 1, 1)), '') AS short,
          regexp_replace(regexp_replace(lower(u), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS file FROM h""",
    "anniversaries": """WITH j AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(l_shipdate AS DATE) AS ship FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
        SELECT day, CAST(day - INTERVAL 1 YEAR AS DATE) AS one, CAST(day - INTERVAL 3 YEAR AS DATE) AS three, sum(datediff('month', least(day, ship), greatest(day, ship)) - CASE WHEN day(greatest(day, ship)) < day(least(day, ship)) THEN 1 ELSE 0 END)::BIGINT AS months FROM j GROUP BY day""",
    "claim_flags": f"WITH {CLAIM_SQL} SELECT array_to_string({_FLAGS}, ',') AS flags, coalesce(year(ref_end), year(valid_from))::INT AS year, count(*) AS n FROM claim GROUP BY ALL",
    "grounded_labels": f"""WITH {CLAIM_SQL}, e AS (SELECT *, concat_ws(' ', 'We asked', CASE WHEN claim_id % 2 = 0 THEN sample_size END, 'people aged', CASE WHEN claim_id % 3 = 0 THEN age_min END, 'or more in', CASE WHEN claim_id % 5 = 0 THEN year(ref_end) END) AS ev, year(ref_end)::INT AS yr FROM claim)
        SELECT claim_id, CASE WHEN {_stands('sample_size', 'ev')} THEN sample_size END AS sample_size, CASE WHEN {_stands('age_min', 'ev')} THEN age_min END AS age_min, CASE WHEN {_stands('yr', 'ev')} THEN yr END AS year FROM e""",
    "canonical_records": f"WITH {CLAIM_SQL}, l AS (SELECT indicator, 'indicator=' || indicator || ';place=' || city_id || ';year=' || coalesce(year(ref_end)::VARCHAR, '') || ';value=' || hundredths AS line FROM claim WHERE hundredths IS NOT NULL) SELECT indicator, count(*) AS same, count(*) AS n, min(line) AS first FROM l GROUP BY ALL",
    "verdicts": "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'insufficient' WHEN quality = 1 THEN 'supported' ELSE 'refuted' END AS verdict, substring(text, 1, 40) AS rationale FROM documents JOIN labels USING (doc_id)",
    "highlights": """WITH t AS (SELECT doc_id, text, strpos(lower(text), ' the ') AS p FROM documents), s AS (SELECT *, greatest(p - 30, 1) AS st FROM t WHERE p > 0)
        SELECT doc_id, substring(text, st, p - st + 35) AS "window", (p - st)::BIGINT AS "from", (p - st + 5)::BIGINT AS "to" FROM s""",
    "search_words": "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda w: length(w) > 3))), ' ') AS words FROM part",
    "public_addresses": f"""WITH a AS (SELECT page_id, {_ADDR} AS address FROM pages), b AS (SELECT *, regexp_replace(address, '^::ffff:', '') AS s FROM a),
        n AS (SELECT *, CASE WHEN regexp_full_match(s, '[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}') AND len(list_filter(string_split(s, '.'), lambda x: x::INT > 255)) = 0 THEN list_reduce(list_transform(string_split(s, '.'), lambda x: x::BIGINT), lambda x, y: x * 256 + y) END AS n FROM b)
        SELECT page_id, address, coalesce(NOT ({_NETS}), false) AS public FROM n""",
    "usage_decisions": "SELECT page_id, CAST(page_id % 6 AS INT) IN (0, 2) AS blocked FROM pages",
    "retry_waits": """SELECT event_id, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN least(event_id, 3600) WHEN 1 THEN least(greatest(epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(date_trunc('second', ts)), 0), 3600)::BIGINT END AS wait,
        CASE WHEN event_type = 'error' THEN 'unreachable' WHEN event_type IN ('login', 'signup') THEN 'blocked_login' WHEN event_id % 5 = 3 THEN 'blocked_robots' ELSE 'fetched' END AS outcome FROM events""",
}

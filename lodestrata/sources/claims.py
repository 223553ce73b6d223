"""Claims with labels, derived from order lines: one row a line, the same for Spark and for the oracles.

The expressions are plain SQL that Spark and DuckDB both read; what the queries compute from them is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.sources.tables import table

#: The vocabularies, finest or best first where they have an order.
LEVELS = ["city_wide", "sub_city_area", "sub_city_population", "metro_region", "district", "state_province", "national", "global"]
PUBLISHERS = ["government", "multilateral", "academic", "ngo", "news", "other"]
SAMPLING = ["census", "representative_sample", "modelled", "not_stated", "not_applicable", "non_representative"]
RELATIONS = ["LEADS", "GOVERNS", "RUNS", "FUNDS", "PARTNER_OF"]
MEASURES = ["measured_prevalence", "self_reported_prevalence", "screening_positivity", "cascade_awareness", "count"]
SETTINGS = ["community", "facility", "school", "workplace", "not_stated"]


def _pick(values: list[str | None], number: str) -> str:
    """CASE that picks by the remainder of a number."""
    whens = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"CASE CAST(({number}) % {len(values)} AS INT) {whens} END"


def _days(date: str, days: int) -> str:
    return f"CAST({date} + INTERVAL '{days}' DAY AS DATE)"


_SHIP = "CAST(l_shipdate AS DATE)"
_KIND = _pick(["statistic", "relation", "statement"], "l_partkey")
_EXPRESSIONS = {
    "claim_id": "CAST((l_orderkey * 10 + l_linenumber) * 100000000 + round(l_extendedprice * 100) AS BIGINT)",
    "city_id": "CAST(o_custkey AS BIGINT)",
    "run_id": "CAST(l_orderkey AS BIGINT)",
    "slot": "CAST(l_partkey % 16 AS INT)",
    "source_id": "CAST(l_suppkey AS BIGINT)",
    "kind": _KIND,
    "status": "CASE WHEN l_returnflag = 'R' THEN 'insufficient' WHEN l_returnflag = 'A' AND l_linenumber % 2 = 0 THEN 'contested' ELSE 'supported' END",
    "level": _pick(LEVELS, "l_suppkey"),
    "fit": _pick(["city", "nearby", "contains_city", None, "elsewhere"], "l_linenumber"),
    "fit_level": "CASE WHEN l_linenumber = 5 THEN 'sub_city_population' END",
    "publisher": _pick(PUBLISHERS, "l_suppkey"),
    "sampling": _pick(SAMPLING, "l_partkey"),
    "ref_start": f"CASE WHEN l_quantity > 45 OR l_quantity < 5 THEN NULL ELSE {_days(_SHIP, -180)} END",
    "ref_end": f"CASE WHEN l_quantity > 45 THEN NULL ELSE {_SHIP} END",
    "proxy": "l_tax >= 0.08",
    "sample_size": "CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST(l_quantity * 20 AS INT) END",
    "subgroup": "CASE WHEN l_partkey % 11 = 0 THEN 'women' END",
    "setting": _pick(SETTINGS, "l_suppkey"),
    "indicator": "CAST(l_partkey % 40 AS INT)",
    "measure": _pick(MEASURES, "l_partkey"),
    "denominator_stated": "l_linestatus = 'F'",
    "sex": _pick(["all", "female", "male", "not_stated"], "l_suppkey"),
    "age_min": "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(l_partkey % 3 AS INT) * 15 END",
    "unit": _pick(["percent", "count"], "l_partkey"),
    "hundredths": "CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_partkey % 2 = 0 THEN CAST(round(l_discount * 10000) AS BIGINT) ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END",
    "scope_verified": "l_tax < 0.06",
    "fallback": "l_linenumber = 7",
    "subject": "CAST(l_suppkey AS BIGINT)",
    "object": "CAST(l_partkey % 500 AS BIGINT)",
    "relation": _pick(RELATIONS, "l_linenumber"),
    "valid_from": f"CASE WHEN l_discount = 0 THEN NULL ELSE {_SHIP} END",
    "valid_to": f"CASE WHEN l_tax <= 0.02 THEN {_days(_SHIP, 400)} END",
    "from_proxy": "l_quantity < 10",
}

#: CTE named `claim` for the oracles, to be put after WITH.
CLAIM_SQL = "claim AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _EXPRESSIONS.items()) + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def claims(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The derived claims; only the columns named (all if none) reach the scan."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    return joined.selectExpr(*(f"{_EXPRESSIONS[c]} AS {c}" for c in (columns or _EXPRESSIONS)))

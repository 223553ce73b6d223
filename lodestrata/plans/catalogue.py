"""All queries of the library proper, each with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.plans import answers, assembly, claims, counts, events, facts, fulltext, grammar, graph, judging, panels, parsing, places, retrieval, rules, text, upkeep, writes

MODULES = (facts, claims, counts, retrieval, text, events, rules, writes, assembly, judging, grammar, places, graph, upkeep, answers, parsing, panels, fulltext)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}

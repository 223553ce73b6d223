"""Parquet tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.runtime import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Columns and filters of later steps reach the scan; nothing is read here."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")

"""Readers of reference catalogues: tab-separated gazetteers and statistics in JSON."""

from __future__ import annotations

import io
import itertools
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The places file's columns that are kept, by position.
PLACE_COLUMNS = {"place_id": 0, "name": 1, "ascii_name": 2, "alternates": 3, "lat": 4, "lon": 5, "country": 8, "admin1": 10, "admin2": 11, "population": 14, "timezone": 17}


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """Lines split at tabs; blank lines and comments are left out."""
    lines = _zipped_lines(spark, path) if path.endswith(".zip") else spark.read.text(path)
    return lines.where(~F.col("value").rlike(r"^\s*(#|$)")).select(F.split("value", "\t").alias("f"))


def _zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the one text file in each zip archive; a damaged archive is an error."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    if bad := archive.testzip():
                        raise ValueError(f"damaged archive member {bad}")
                    (name,) = [n for n in archive.namelist() if n.endswith(".txt")]
                    with archive.open(name) as file:
                        lines = io.TextIOWrapper(file, "utf-8")
                        while part := list(itertools.islice(lines, 10_000)):
                            yield pa.RecordBatch.from_arrays([pa.array([x.rstrip("\r\n") for x in part])], names=["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")


def places(spark: SparkSession, path: str) -> DataFrame:
    """One row a place, from text or zipped text; empty fields are null, alternates a list."""
    f = _fields(spark, path)
    columns = {n: F.nullif(F.get("f", F.lit(i)), F.lit("")) for n, i in PLACE_COLUMNS.items()}
    numbers = {"lat": "double", "lon": "double", "population": "long"}
    return f.select(*[F.split(c, ",").alias(n) if n == "alternates" else c.try_cast(numbers[n]).alias(n) if n in numbers else c.alias(n) for n, c in columns.items()])


def countries(spark: SparkSession, path: str) -> DataFrame:
    """iso2, iso3, name, languages: distinct two-letter codes in the order they are given."""
    codes = F.filter(F.transform(F.split(F.get("f", F.lit(15)), ","), lambda c: F.lower(F.substring_index(c, "-", 1))), lambda c: F.length(c) == 2)
    return _fields(spark, path).select(F.get("f", F.lit(0)).alias("iso2"), F.get("f", F.lit(1)).alias("iso3"), F.get("f", F.lit(4)).alias("name"), F.array_distinct(codes).alias("languages"))


def admin1(spark: SparkSession, path: str) -> DataFrame:
    """country, code, name, from keys like CC.code."""
    key = F.get("f", F.lit(0))
    return _fields(spark, path).select(F.substring_index(key, ".", 1).alias("country"), F.regexp_replace(key, r"^[^.]*\.", "").alias("code"), F.get("f", F.lit(1)).alias("name"))


def known_places(place: DataFrame, country: DataFrame) -> DataFrame:
    """Places whose country is known."""
    return place.join(country.select(F.col("iso2").alias("country")), "country", "left_semi")


def skipped_places(place: DataFrame, country: DataFrame) -> DataFrame:
    """How many places were left out by each unknown country."""
    return place.join(country.select(F.col("iso2").alias("country")), "country", "left_anti").groupBy("country").agg(F.count(F.lit(1)).alias("skipped"))


def odata_values(spark: SparkSession, path: str) -> DataFrame:
    """Statistics as `value` lists: code, area, year, sex and the leading number of the shown text (empty if none)."""
    schema = "value array<struct<IndicatorCode string, SpatialDim string, TimeDim int, Dim1 string, Dim2Type string, Dim2 string, Value string>>"
    v = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("value").alias("v")).select("v.*")
    shown = v.where("TimeDim IS NOT NULL AND Value IS NOT NULL")
    return shown.select(F.col("IndicatorCode").alias("code"), F.col("SpatialDim").alias("area"), F.col("TimeDim").alias("year"), F.col("Dim1").alias("sex"), F.when(F.col("Dim2Type") == "AGEGROUP", F.col("Dim2")).alias("age"), F.regexp_extract("Value", r"^\s*(-?\d+(?:\.\d+)?)", 1).alias("value"))


def paged_values(spark: SparkSession, path: str) -> DataFrame:
    """Statistics as a pair of page and list: indicator, country, year and value; nulls and years that aren't digits go."""
    schema = "array<struct<indicator struct<id string>, countryiso3code string, date string, value decimal(38,10)>>"
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json(F.get_json_object("value", "$[1]"), schema)).alias("r")).select("r.*")
    return rows.where(F.col("value").isNotNull() & F.col("date").rlike("^[0-9]+$")).select(F.col("indicator.id").alias("code"), F.col("countryiso3code").alias("area"), F.col("date").cast("int").alias("year"), "value")


def latest_record(values: DataFrame) -> DataFrame:
    """Latest year of each code and area, none where two records share it."""
    last = values.groupBy("code", "area").agg(F.max("year").alias("year"))
    kept = values.join(last, ["code", "area", "year"]).groupBy("code", "area", "year").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value"))
    return kept.where("n = 1").drop("n")

"""Fixtures shared by the subpackage's tests."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a long one, repeated rows, and columns that clash with own names."""
    long = "the river and a stone of many colours was on the hill " * 4000
    rows = [
        (1, "The cat sat on the mat and looked at the old grey house by the river", "en", "b", 10),
        (2, "The cat sat on the mat and looked at the old grey house by the lake", "en", "a", 10),
        (3, "", "en", "a", 0),
        (4, None, None, None, None),
        (5, " \t\n ", "de", "a", 4),
        (6, long, "en", "b", len(long)),
        (7, "ünï çødé ’ 中文 text 😀 with signs\x0bhere", "fr", "b", 20),
        (8, "The cat sat on the mat and looked at the old grey house by the river", "en", "c", 10),
        (8, "The cat sat on the mat and looked at the old grey house by the river", "en", "c", 10),
        (None, "no id here but some plain words of text follow it", "en", "c", 5),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "doc_id AS shard", "text AS fp", "1 AS size", "2 AS place", "'x' AS h", "3 AS seq", "4 AS part", "5 AS row_id", "true AS left", "7 AS range")


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)

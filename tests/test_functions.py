from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import chunking
from lodestrata.functions import values as V


@pytest.mark.parametrize(
    ("text", "value"),
    [("12", "12"), ("1,234", "1234"), ("1.234", "1234"), ("1 234 567", "1234567"), ("0.234", "0.234"), ("0,5", "0.5"), ("1,234.5", "1234.5"), ("1.234,5", "1234.5"), ("12.3456", "12.3456"), ("3,14", "3.14"), ("about 3", None), ("1,23,4", None), ("", None), (None, None), ("-7", "-7")],
)
def test_plain_number(spark, text, value):
    (row,) = spark.createDataFrame([(text,)], "t string").select(V.plain_number(F.col("t")).alias("v")).collect()
    assert row.v == (None if value is None else Decimal(value))


@pytest.mark.parametrize(
    ("url", "out"),
    [("HTTP://A.Example.com:80", "http://a.example.com/"), ("https://a.b./x?utm_source=q&b=1&gclid=2#f", "https://a.b/x?b=1"), ("https://a.b:443/x?ref=1", "https://a.b/x"), ("http://a.b:8080/x?refer=1", "http://a.b:8080/x?refer=1")],
)
def test_canonical_url(spark, url, out):
    (row,) = spark.createDataFrame([(url,)], "u string").select(V.canonical_url(F.col("u")).alias("v")).collect()
    assert row.v == out


def test_haversine_and_cosine(spark):
    (row,) = spark.range(1).select(V.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("half"), V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"), V.cosine(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(2.0), F.lit(2.0))).alias("one")).collect()
    assert abs(row.half - 20015.0868) < 1e-3 and row.zero == 0.0 and abs(row.one - 1) < 1e-12


@given(st.text(st.sampled_from("ab .!?\n。"), max_size=300), st.integers(5, 60), st.integers(0, 2))
def test_chunks_cover_the_text(text, budget, overlap):
    spans = chunking.chunks(text, budget, overlap)
    assert all(0 < b - a <= budget for a, b in spans)
    covered = set()
    for a, b in spans:
        covered |= set(range(a, b))
    assert covered == set(range(len(text)))
    assert all(p[0] < q[0] for p, q in zip(spans, spans[1:]))

"""Edge rules of the text parsing and rounding helpers (hand-made rows)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from salesflow.functions.columns import cn_date, na_to_null, round0, round1, try_number

D = dt.datetime(2024, 3, 15)

DATES = [
    ("2024年3月15日", D), (" 2024年3月15日 ", D), ("2024-03-15 00:00:00", D), ("20240315", D),
    ("2024-3-15", D), ("3/15/2024", D), ("2024.3.15", D), ("2024-3", dt.datetime(2024, 3, 1)),
    ("2024年13月1日", None), ("2024年2月30日", None), ("45366", None), ("", None), ("   ", None),
    (None, None), ("2024年3月", None), ("待定", None),
]
NUMBERS = [
    ("12", 12.0), (" 12 ", 12.0), ("+5", 5.0), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("-2.5", -2.5),
    ("1,200", None), ("待确认", None), ("12元", None), ("12d", None), ("12f", None), ("1_000", None),
    ("nan", None), ("Infinity", None), ("", None), (None, None),
]
TOKENS = [
    ("NA", None), ("N/A", None), ("null", None), ("None", None), ("nan", None), ("#N/A", None), ("", None),
    ("<NA>", None), ("ok", "ok"), (" NA ", " NA "), (None, None),
]


def _check(spark, cases, fn):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, s string")
    got = {r.i: (r.a, r.b) for r in df.select("i", fn("s").alias("a"), fn(F.col("s")).alias("b")).collect()}
    for i, (text, expected) in enumerate(cases):
        assert got[i] == (expected, expected), text


def test_cn_date(spark):
    _check(spark, DATES, cn_date)


def test_try_number(spark):
    _check(spark, NUMBERS, try_number)


def test_na_tokens(spark):
    _check(spark, TOKENS, na_to_null)


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-2.5,), (0.25,), (12.45,), (0.05,)], "x double")
    got = [(r.a, r.b) for r in df.select(round0(F.col("x")).alias("a"), round1(F.col("x")).alias("b")).collect()]
    assert [a for a, _ in got] == [0.0, 2.0, 2.0, -2.0, 0.0, 12.0, 0.0]
    assert [b for _, b in got] == [0.5, 1.5, 2.5, -2.5, 0.2, 12.4, 0.0]

"""Exact quantile: matches numpy's linear interpolation, handles skew and empty input."""

import re

import numpy as np
import pytest

from salesflow.operators import conform
from salesflow.operators.quantile import exact_quantile
from salesflow.sources.fixtures import FixtureCatalog

from conftest import SF_SMALL


def q_of(spark, values, q, slices=1 << 18):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    return exact_quantile(df, "x", q, slices).first()


def test_survey_example(spark):
    r = q_of(spark, [1, 2, 3, 4, 100], 0.99)
    assert r["n"] == 5
    assert r["value"] == pytest.approx(96.16, abs=1e-12)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_matches_numpy(spark, seed, q):
    rng = np.random.default_rng(seed)
    x = np.round(rng.lognormal(3, 1, 500), 2)
    r = q_of(spark, list(x), q, slices=7)
    assert r["value"] == np.percentile(x, q * 100)


def test_hot_value_and_nulls(spark):
    # one value holds a third of the rows; NULLs are ignored
    rng = np.random.default_rng(7)
    x = list(np.round(rng.uniform(0, 100, 600), 2)) + [42.0] * 300 + [None] * 50
    r = q_of(spark, x, 0.99, slices=5)
    clean = np.array([v for v in x if v is not None])
    assert r["n"] == len(clean)
    assert r["value"] == np.percentile(clean, 99)


def test_single_and_empty(spark):
    assert q_of(spark, [5.0], 0.99)["value"] == 5.0
    r = q_of(spark, [None], 0.99)
    assert r["n"] == 0 and r["value"] is None


def scans(df):
    """File scans that ran: those under an operator with generated code (a plan that did not run has none).

    A subquery that several expressions name is printed with each of them, with the same columns.
    """
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return len({line[line.index("FileScan"):] for above, line in zip(lines, lines[1:])
                if "FileScan" in line and re.search(r"\*\(\d+\) ", above)})


def test_crowded_beside_outliers(spark):
    """Values that differ in their last digits only, beside far ones of either sign."""
    rng = np.random.default_rng(11)
    x = 1000 + rng.integers(0, 40_000, 30_000) * 1e-12
    x = np.r_[x, 1e300, 1e15, -1e300, 0.0, -0.0, 5e-324, 2.5e-310, -7.0]
    for q in (0.99, 0.5, 0.0, 0.0001, 0.9999, 1.0):
        assert q_of(spark, list(x), q)["value"] == np.percentile(x, q * 100), q
    assert q_of(spark, list(x), 0.5, slices=2)["value"] == np.percentile(x, 50)


def test_infinite_and_nan(spark):
    r = q_of(spark, [1.0, 2.0, float("inf"), float("nan"), None], 0.5)
    assert (r["n"], r["value"]) == (3, 2.0)


def test_input_is_scanned_once(spark, tmp_path):
    rng = np.random.default_rng(3)
    path = str(tmp_path / "t")
    spark.createDataFrame([(float(v),) for v in rng.lognormal(3, 1, 2000)], "x double").write.parquet(path)
    assert scans(exact_quantile(spark.read.parquet(path), "x", 0.99)) == 1


def test_sheet_scans(spark):
    src = FixtureCatalog(spark, SF_SMALL)
    assert scans(conform.dealer_price_cap(src)) == 1
    assert scans(conform.dealer_orders(src)) == 2  # the cap, then the rows

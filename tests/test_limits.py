"""Amounts, dates, files and re-runs at the edges of what the sources hold."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from salesflow import Analysis, AnalysisParams
from salesflow.functions.columns import cn_date, money_sum, try_number
from salesflow.operators import conform, metrics
from salesflow.operators.quantile import exact_quantile
from salesflow.plans import report
from salesflow.plans.pipeline import SECTIONS
from salesflow.sinks.snapshot import read_snapshot, write_snapshot
from salesflow.sources.catalog import DEALER_SHEET_COLUMNS, FrameCatalog, SourceCatalog, dealer_sheet_spec, jdbc_options
from salesflow.sources.fixtures import FixtureCatalog
from conftest import SF_SMALL

DAY = dt.datetime(2024, 3, 15)


@pytest.mark.parametrize("amounts,total", [
    ([12.345] * 3, 37.035), ([0.004] * 1000, 4.0), ([9e16] * 3, 2.7e17), ([1e20, 5.0], 1e20), ([1e300, 1.0], 1e300),
    ([150_000_000.0, 0.5], 150_000_000.5), ([None, None], 0.0), ([], 0.0), ([-1e9, 1e9, 0.01], 0.01),
])
def test_money_sum(spark, amounts, total):
    frame = spark.createDataFrame([(a,) for a in amounts], "a double")
    assert frame.agg(money_sum(F.col("a"))).first()[0] == pytest.approx(total, rel=1e-12)


def test_money_out_of_range_raises(spark):
    frame = spark.range(200).selectExpr("CAST(9.9e27 AS DOUBLE) * 0 + 9.9e19 AS a").repartition(3)
    assert frame.agg(money_sum(F.col("a"))).first()[0] == pytest.approx(200 * 9.9e19)
    with pytest.raises(PySparkException):
        spark.sql("SELECT raise_error('money total out of range')").collect()


def test_large_amounts_reach_the_results(spark):
    payments = spark.createDataFrame([(1, 1, 150_000_000.0, "completed", DAY), (2, None, 7.0, "pending", DAY)],
                                     "payment_id long, order_id long, amount double, status string, payment_time timestamp_ntz")
    orders = spark.createDataFrame([(1, 5)], "order_id long, user_id long")
    users = spark.createDataFrame([(5, "Ann")], "user_id long, username string")
    rows = {r.payment_id: r for r in conform.collections(
        FrameCatalog({"payments": payments, "orders": orders, "users": users})).collect()}
    assert (rows[1].receivable, rows[1].outstanding, rows[1].customer_name) == (150_000_000.0, 0.0, "Ann")
    assert (rows[2].customer_name, rows[2].outstanding) == (None, 7.0)


@pytest.mark.parametrize("text,want", [
    ("2024/3/15", DAY), ("2024/03/15", DAY), ("2024-03-15T10:00:00", DAY.replace(hour=10)), ("2024-3-15\t", DAY),
    ("2024年3月15日　", DAY), (" 2024-03-15", DAY), ("2024-03-15 10:00:00.5", DAY.replace(hour=10, microsecond=500_000)),
    ("3/15/2024", DAY), ("2024/3/15 9:05", DAY.replace(hour=9, minute=5)), ("2024-2-30", None), ("  ", None), ("待定", None),
])
def test_dates(spark, text, want):
    frame = spark.createDataFrame([(text,)], "s string")
    assert tuple(frame.select(cn_date("s"), cn_date(F.col("s"))).first()) == (want, want)


def test_infinite_numbers_are_missing(spark):
    frame = spark.createDataFrame([("1e999",), ("-1e999",), ("1e20",)], "s string")
    assert [r[0] for r in frame.select(try_number("s")).collect()] == [None, None, 1e20]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_quantile_needs_no_exchange_reuse(spark, adaptive):
    frame = spark.range(600_000).select((F.pmod(F.xxhash64("id"), F.lit(10**9)) / F.lit(1111.0) + F.col("id") * 1e-7).alias("v"))
    frame = frame.unionByName(spark.createDataFrame([(1e20,), (-5.0,), (0.0,)], "v double"))
    want = frame.agg(F.percentile("v", F.lit(0.99))).first()[0]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.exchange.reuse", "false")
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        got = {exact_quantile(frame, "v", 0.99).first()["value"] for _ in range(2)}
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert len(got) == 1 and got.pop() == pytest.approx(want, rel=1e-12)


def test_sheet_columns_are_bound_by_header(spark, tmp_path):
    names = [DEALER_SHEET_COLUMNS[i] for i in (1, 0, 6, 5, 4, 3, 2)]
    (tmp_path / "a.csv").write_text(",".join(names) + "\n2024/3/15,D1,20.5,10.25,2,Tea,Shop\n", encoding="utf-8")
    rows = conform.dealer_typed(SourceCatalog(spark, {"dealer_sheet": dealer_sheet_spec(str(tmp_path / "a.csv"))})).collect()
    assert [(r.order_id, r.order_date, r.quantity, r.amount) for r in rows] == [("D1", DAY, 2.0, 20.5)]
    (tmp_path / "b.csv").write_text(",".join(names[1:]) + "\nD1,20.5,10.25,2,Tea,Shop\n", encoding="utf-8")
    with pytest.raises(ValueError):
        dealer_sheet_spec(str(tmp_path / "b.csv")).read(spark)


def test_replacing_a_month_by_nothing_clears_it(spark, tmp_path):
    frame, path = spark.createDataFrame([(1,)], "a int"), str(tmp_path / "t")
    for month in ("202401", "202402"):
        write_snapshot(frame, path, month)
    for skip in (True, False):
        write_snapshot(frame, path, "202401", replace_month=True)
        write_snapshot(frame.filter("a > 1"), path, "202401", replace_month=True, skip_empty=skip)
        assert [r.report_month for r in read_snapshot(spark, path, frame.schema).collect()] == ["202402"]


def test_digest_keeps_the_ranking_of_unrounded_quantities(spark):
    orders = spark.createDataFrame([("1", "z", 10.4, 5.0), ("2", "a", 10.3, 5.0)],
                                   "order_id string, product_name string, quantity double, amount double")
    ranked = metrics.ranked_products(orders)
    assert [(r.product_name, r["rank"]) for r in ranked.orderBy("rank").collect()] == [("z", 1), ("a", 2)]
    monthly = spark.createDataFrame([("2024-01", 2, 10.0)], "order_month string, order_lines long, sales double")
    totals = spark.createDataFrame([(0.0, 0.0, None)], "receivable double, collected double, recovery_pct double")
    debt = spark.createDataFrame([], "customer_name string, outstanding double")
    rows = report.digest(monthly, ranked, totals, debt).filter("section = 'top_product'").collect()
    assert sorted((r["rank"], r.label) for r in rows) == [(1, "z"), (2, "a")]


def test_sections_plan_only_what_they_need(spark):
    for section, names in SECTIONS.items():
        keys = set(Analysis(FixtureCatalog(spark, SF_SMALL), AnalysisParams(report=section)).run())
        assert keys == set(names) | ({"report_headline"} if section == "sales" else set())
    full = set(Analysis(FixtureCatalog(spark, SF_SMALL), AnalysisParams()).run())
    assert {"digest", "load_counts", "dq_report", "report_headline"} <= full


def test_encryption_is_the_callers_choice():
    assert "encrypt=true" in jdbc_options("mssql")["url"]
    assert "encrypt=false" in jdbc_options("mssql", encrypt=False)["url"]

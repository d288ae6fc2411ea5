"""Bucketed order tables, partial totals of batches, and rejected dealer rows."""

import pytest
from pyspark.sql import functions as F

from salesflow.operators import conform, metrics, partials
from salesflow.sources.bucketed import BucketedCatalog
from salesflow.sources.catalog import DEALER_SHEET_COLUMNS, FrameCatalog
from salesflow.sources.fixtures import FixtureCatalog

from conftest import SF_SMALL


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_bucketed_joins_move_no_orders(spark, tmp_path, no_broadcast):
    plain = FixtureCatalog(spark, SF_SMALL)
    src = BucketedCatalog(spark, plain, str(tmp_path), 4)
    for load in (conform.orders_fact, conform.collections):
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(order_id" in plan(load(plain))
        found = plan(load(src))
        assert "hashpartitioning(order_id" not in found and "SortMergeJoin [order_id" in found
        assert found.count("Bucketed: true") == 2
        assert rows(load(src)) == rows(load(plain))


def test_bucketed_files_are_used_again(spark, tmp_path):
    plain = FixtureCatalog(spark, SF_SMALL)
    src = BucketedCatalog(spark, plain, str(tmp_path), 3)
    want = rows(src.table("orders"))
    spark.sql(f"DROP TABLE `{src.name('orders')}`")  # as a new session would find it: files, but no name
    again = BucketedCatalog(spark, FrameCatalog({}), str(tmp_path), 3)
    assert rows(again.table("orders")) == want
    with pytest.raises(ValueError):
        BucketedCatalog(spark, plain, str(tmp_path), 0)


def test_payments_without_an_order_are_spread(spark, no_broadcast):
    pay = spark.range(2000).selectExpr("id AS payment_id", "CASE WHEN id < 3 THEN id ELSE NULL END AS order_id",
                                       "CAST(1 AS DECIMAL(10,2)) AS amount", "'completed' AS status",
                                       "TIMESTAMP_NTZ '2026-01-01' AS payment_time")
    orders = spark.createDataFrame([(0, 5), (1, None), (2, 9)], "order_id long, user_id long")
    users = spark.createDataFrame([(5, "Ann"), (None, "nobody")], "user_id long, username string")
    out = conform.collections(FrameCatalog({"payments": pay, "orders": orders, "users": users}))
    names = {r.payment_id: r.customer_name for r in out.collect()}
    assert len(names) == 2000 and {k for k, v in names.items() if v} == {0} and names[0] == "Ann"
    assert "_spread" not in out.columns


def test_batches_add_up(spark, tmp_path):
    src = FixtureCatalog(spark, SF_SMALL)
    lines = conform.all_orders(src)
    parts = [str(tmp_path / "a"), str(tmp_path / "b")]
    cut = F.coalesce(F.dayofmonth("order_date") % 2 == 0, F.lit(False))
    lines.filter(cut).write.parquet(parts[0])
    lines.filter(~cut).write.parquet(parts[1])
    path = str(tmp_path / "partials")
    for name, part in zip(("202601", "202602"), parts):
        read = spark.read.parquet(part)
        assert all(part in f for f in partials.sales_partials(read).inputFiles())
        partials.add_batch(read, path, name)
    partials.add_batch(spark.read.parquet(parts[1]), path, "202602")  # run again
    both = partials.merged(spark, path)
    assert all("/partials/" in f for f in both.inputFiles())  # no order line is read
    done = metrics.from_rollup(partials.as_rollup(both))
    assert rows(done["monthly"]) == rows(metrics.monthly_trend(lines))
    assert rows(done["status"]) == rows(metrics.order_status(lines))
    assert rows(metrics.top_products(None, per_product=done["product"])) == rows(metrics.top_products(lines))
    assert rows(metrics.customer_value(None, per_customer=done["customer"])) == rows(metrics.customer_value(lines))
    products = conform.products(src)
    assert rows(metrics.category_sales(None, products, partials.per_name(both))) == rows(
        metrics.category_sales(lines, products))


def test_money_of_batches_is_exact(spark, tmp_path):
    path = str(tmp_path / "p")
    for i, amounts in enumerate(([0.1, 0.005, None], [1e20, -0.1], [])):
        lines = spark.createDataFrame([("1", "2026-01", "p", None, "s", a, 1.0) for a in amounts],
                                      "order_id string, order_month string, product_name string, customer_name string, "
                                      "status string, amount double, quantity double")
        partials.add_batch(lines, path, f"b{i}")
    got = {(r.level, r.key): r for r in partials.merged(spark, path).collect()}
    month = got["month", "2026-01"]
    assert (month.order_lines, month.rows, month.n, str(month.exact), month.huge) == (5, 5, 4, "0.0050000000", 1e20)
    assert got["customer", None].rows == 5 and got["product", "p"].quantity == 5.0


def test_accepted_and_rejected_make_the_sheet(spark):
    src = FixtureCatalog(spark, SF_SMALL)
    sheet, kept, gone = src.table("dealer_sheet").count(), conform.dealer_orders(src), conform.dealer_rejects(src)
    assert kept.count() + gone.count() == sheet
    assert kept.select("order_id").join(gone.select("order_id"), "order_id").count() == 0
    assert gone.filter("reason = 'price_above_cap'").count() > 0


def test_reasons(spark):
    good = ("D", "2024年3月15日", "Ann", "Tea", "2", "10", "20")
    lacks = lambda i, cell: tuple(cell if j == i else c for j, c in enumerate(good))
    cases = [(good, None), (lacks(1, "待定"), "no_order_date"), (lacks(6, "待确认"), "no_amount"),
             (lacks(5, None), "no_unit_price"), (lacks(4, "two"), "no_quantity"), (lacks(2, "N/A"), "no_customer_name"),
             (("D", None, None, None, None, None, None), "no_order_date"), (lacks(5, "99"), "price_above_cap")]
    sheet = spark.createDataFrame([c for c, _ in cases], ", ".join(f"`{c}` string" for c in DEALER_SHEET_COLUMNS))
    got = conform.dealer_classified(FrameCatalog({"dealer_sheet": sheet}))
    assert sorted((r.reason or "") for r in got.collect()) == sorted(w or "" for _, w in cases)
    gone = conform.dealer_rejects(FrameCatalog({"dealer_sheet": sheet}))
    assert gone.columns == ["order_id", "date_str", "customer_name", "product_name", "quantity", "unit_price", "amount", "reason"]
    assert {(r.amount, r.reason) for r in gone.collect()} >= {("待确认", "no_amount")}

"""The monthly run: section gating, channel pruning, data-quality report."""

import pytest
from pyspark.sql import functions as F

from salesflow.operators import conform, quality
from salesflow.plans.pipeline import Analysis, AnalysisParams
from salesflow.sources.fixtures import FixtureCatalog

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def fx(spark):
    return FixtureCatalog(spark, SF_SMALL)


def test_sections(fx):
    full = Analysis(fx, AnalysisParams(report_month="202608")).run()
    assert {"monthly_trend", "inventory_value", "debt_top", "digest"} <= set(full)
    inv = Analysis(fx, AnalysisParams(report_month="202608", report="inventory")).run()
    assert "inventory_value" in inv and "monthly_trend" not in inv and "debt_top" not in inv
    with pytest.raises(ValueError):
        AnalysisParams(report="everything")
    with pytest.raises(ValueError):
        AnalysisParams(channel="other")


def test_channel_filter_prunes_branch(fx):
    shop = Analysis(fx, AnalysisParams(channel=conform.CHANNEL_SHOP)).orders
    files = shop.inputFiles()
    assert not any("dealer_sheet" in f for f in files)
    assert any("order_items" in f for f in files)
    assert shop.filter(F.col("channel") != conform.CHANNEL_SHOP).count() == 0


def test_persisted_run_matches(fx):
    a = Analysis(fx, AnalysisParams(persist=True))
    b = Analysis(fx, AnalysisParams())
    assert sorted(a.monthly_trend.collect()) == sorted(b.monthly_trend.collect())
    a.orders.unpersist()


def test_dq_report_passes_on_fixture(fx):
    dq = Analysis(fx).dq_report().collect()
    failed = {(r.table_name, r.rule) for r in dq if not r.passed}
    # the fixture keeps negative stock out (conform clamps it) and always has a margin
    assert ("inventory", "stock_nonneg") not in failed
    assert ("products", "columns") not in failed
    assert {r.rule for r in dq if r.table_name == "dealer_orders"} == {
        "nonempty", "columns", "channel_const", "amount_notnull", "amount_pos"}


def test_dq_report_counts_violations(spark):
    p = spark.createDataFrame([(1, "a", "c", 1.0, 2.0, -5.0), (2, "b", "c", 1.0, 2.0, None)],
                              "product_id int, product_name string, category string, cost_price double, "
                              "unit_price double, gross_margin_pct double")
    c = spark.createDataFrame([(1, None)], "customer_id int, customer_name string")
    o = spark.createDataFrame([], "order_id string, order_date timestamp_ntz, order_month string, "
                                  "customer_name string, product_name string, quantity double, amount double")
    i = spark.createDataFrame([(1, -1)], "inventory_id int, current_stock int")
    d = spark.createDataFrame([("x", None, None, "M", "n", "p", 1.0, 0.0)],
                              "channel string, order_date timestamp_ntz, order_month string, customer_name string, "
                              "product_name string, order_id string, quantity double, amount double")
    k = spark.createDataFrame([(None, 1.0, 0.0)], "receivable double, collected double, outstanding double")
    src = FixtureCatalog(spark, SF_SMALL)
    tables = {"products": p, "customers": c, "orders": o, "inventory": i, "dealer_orders": d, "collections": k}
    got = {(r.table_name, r.rule): (r.violations, r.total, r.passed)
           for r in quality.dq_report(src, {n: lambda df=df: df for n, df in tables.items()}).collect()}
    assert got[("products", "margin_nonneg")] == (2, 2, False)   # negative and missing margin
    assert got[("customers", "name_notnull")] == (1, 1, False)
    assert got[("orders", "nonempty")] == (1, 0, False)
    assert got[("inventory", "stock_nonneg")] == (1, 1, False)
    assert got[("dealer_orders", "channel_const")] == (1, 1, False)
    assert got[("dealer_orders", "amount_pos")] == (1, 1, False)
    assert got[("collections", "receivable_notnull")] == (1, 1, False)
    assert got[("all_orders", "contract")][0] == 0


class Altered:
    """A catalog with one table replaced."""

    def __init__(self, base, **tables):
        self.base, self.tables = base, tables

    def table(self, name):
        return self.tables.get(name) if name in self.tables else self.base.table(name)


def test_dq_report_checks_the_sources(fx):
    """A missing source column is reported, not raised; a textual order time fails its rule."""
    src = Altered(fx, payments=fx.table("payments").drop("amount", "status"),
                  orders=fx.table("orders").withColumn("created_at", F.col("created_at").cast("string")))
    got = {(r.table_name, r.rule): (r.violations, r.passed) for r in Analysis(src).dq_report().collect()}
    assert got[("collections", "columns")] == (2, False)
    assert ("collections", "nonempty") not in got
    assert got[("orders", "date_type")] == (1, False)
    assert got[("products", "columns")] == (0, True)


def test_expiry_reaches_the_digest(fx):
    late = F.when(F.col("product_id") % 2 == 0, "临期").otherwise("正常")
    a = Analysis(Altered(fx, inventory=fx.table("inventory").withColumn("expiry_status", late)))
    alert = a.digest().filter("section = 'inventory_alert'").first()
    assert alert.value1 == a.inventory.filter("expiry_status <> '正常'").count() > 0


def test_receivables_read_payments_once(fx):
    """The gate comes from the grouped payments: the groups are shuffled once and used twice."""
    a = Analysis(fx)
    df = a.receivables_by_customer()
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert "ReusedExchange" in final


def test_receivables_gate(spark, fx):
    """Nothing is listed when the total of all payments, those without a customer included, is not positive."""
    schema = "customer_name string, outstanding double, receivable double, collected double"
    from salesflow.operators.metrics import receivables_by_customer
    back = spark.createDataFrame([("a", 1.0, 5.0, 4.0), (None, -5.0, -5.0, 0.0)], schema)
    assert receivables_by_customer(back).collect() == []
    owed = spark.createDataFrame([("a", 1.0, 5.0, 4.0), (None, 2.0, 2.0, 0.0), ("b", None, None, None)], schema)
    assert sorted(map(tuple, receivables_by_customer(owed).collect())) == [
        ("a", 1.0, 5.0, 4.0, 80.0), ("b", 0.0, 0.0, 0.0, None)]


def test_snapshots_need_a_lasting_folder(fx):
    with pytest.raises(ValueError):
        Analysis(fx).save_snapshots()


def test_full_run_matches_single_queries(fx):
    """The one-pass rollups give exactly the per-key results."""
    a = Analysis(fx, AnalysisParams())
    run = Analysis(fx, AnalysisParams(one_pass=True)).run()
    assert set(run) == set(a.run())
    single = {
        "monthly_trend": a.monthly_trend, "top_products": a.top_products,
        "customer_value": a.customer_value(), "customer_value_series": a.customer_value_series(),
        "order_status": a.order_status(), "month_over_month": a.month_over_month(),
        "best_month": a.best_month(), "latest_month": a.latest_month(),
        "receivables_by_customer": a.receivables_by_customer(), "debt_top": a.debt_top,
        "receivable_totals": a.receivable_totals,
    }
    for name, df in single.items():
        assert sorted(run[name].collect()) == sorted(df.collect()), name


def test_results_independent_of_session_zone_and_ansi(spark, fx):
    """Dates are timestamp_ntz and lossy casts are try_ forms: zone / ANSI settings do not matter."""
    def run():
        a = Analysis(fx, AnalysisParams())
        return (sorted(a.monthly_trend.collect()), sorted(a.dealer_orders.collect()),
                sorted(a.receivable_totals.collect()))
    base = run()
    old_tz, old_ansi = spark.conf.get("spark.sql.session.timeZone"), spark.conf.get("spark.sql.ansi.enabled")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        spark.conf.set("spark.sql.ansi.enabled", "false")
        assert run() == base
    finally:
        spark.conf.set("spark.sql.session.timeZone", old_tz)
        spark.conf.set("spark.sql.ansi.enabled", old_ansi)


@pytest.mark.parametrize("channel", [conform.CHANNEL_ALL, conform.CHANNEL_DEALER])
def test_load_counts_match_direct_counts(fx, channel):
    a = Analysis(fx, AnalysisParams(channel=channel))
    got = {r.table_name: r.row_count for r in a.load_counts().collect()}
    assert got == {"products": a.products.count(), "customers": a.customers.count(),
                   "inventory": a.inventory.count(), "collections": a.collections.count(),
                   "shop_orders": a.shop_orders.count(), "dealer_orders": a.dealer_orders.count(),
                   "all_orders": a.orders.count()}


def test_relabel_and_digest_text(fx):
    from salesflow.plans.labels import digest_text, relabel
    a = Analysis(fx, AnalysisParams())
    assert relabel(a.top_products, "top_products").columns == ["产品", "销量", "销售额"]
    with pytest.raises(KeyError):
        relabel(a.top_products, "nope")
    lines = [r.line for r in a.digest().collect()]
    out = digest_text(a.digest(), "月度销售摘要").first()
    assert out.text.startswith("月度销售摘要\n" + "=" * 40 + "\n本月订单: ")
    assert "\n热销产品 TOP5:\n  1. " in out.text and "\n需催收客户:\n  " in out.text
    assert all(line in out.text for line in lines)
    assert out.preview == out.text[:500]

"""Conform and metric rules on small hand-made source tables."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from salesflow.operators import conform, metrics
from salesflow.sources.catalog import DEALER_SHEET_SCHEMA, FrameCatalog

T0 = dt.datetime(2024, 1, 5)


@pytest.fixture(scope="module")
def cat(spark):
    dec = lambda x: None if x is None else Decimal(x)
    products = spark.createDataFrame(
        [(1, "Alpha", dec("10.00"), "on", 5), (2, "Beta", dec("20.00"), "on", 3),
         (3, "Gamma", dec("0.00"), "off", 1), (4, "Alpha", dec("7.50"), "on", 0)],
        "product_id bigint, name string, price decimal(10,2), status string, quantity int")
    pcat = spark.createDataFrame([("c1", "Herbs"), ("c2", "Oils")], "category_id string, name string")
    pcr = spark.createDataFrame([(1, "c1"), (1, "c2"), (2, "c1"), (2, "c1"), (4, "c9")],
                                "product_id bigint, category_id string")
    inventory = spark.createDataFrame(
        [(10, 1, -3, dec("4.1234"), "s", T0), (11, 1, 7, dec("3.005"), "s", T0),
         (12, 2, None, None, "s", T0), (13, 99, 5, dec("1.00"), "s", T0)],
        "inventory_id bigint, product_id bigint, quantity int, purchase_price decimal(14,4), "
        "supplier_info string, created_at timestamp_ntz")
    users = spark.createDataFrame([(1, "ann", "active"), (2, "bob", "inactive"), (3, None, "active")],
                                  "user_id bigint, username string, status string")
    orders = spark.createDataFrame(
        [(100, 1, dt.datetime(2024, 1, 5), "completed"), (101, 2, dt.datetime(2024, 2, 1), "pending"),
         (102, 9, dt.datetime(2024, 2, 2), "pending"), (103, 3, None, None)],
        "order_id bigint, user_id bigint, created_at timestamp_ntz, status string")
    items = spark.createDataFrame(
        [(1000, 100, 1, 2), (1001, 100, 2, 1), (1002, 101, 1, 3), (1003, 102, 1, 1), (1004, 101, 77, 1),
         (1005, 103, 2, 1)],
        "order_item_id bigint, order_id bigint, product_id bigint, quantity int")
    payments = spark.createDataFrame(
        [(1, 100, dec("50.00"), "completed", T0), (2, 101, dec("30.00"), "pending", T0),
         (3, 101, dec("5.00"), None, T0), (4, 555, dec("8.00"), "pending", T0),
         (5, 100, None, "completed", T0)],
        "payment_id bigint, order_id bigint, amount decimal(12,2), status string, payment_time timestamp_ntz")
    sheet = spark.createDataFrame(
        [("D1", "2024年1月3日", "Shop A", "Alpha", "2", "10", "20"),
         ("D2", "2024年2月30日", "Shop A", "Alpha", "1", "10", "10"),
         ("D3", "2024年2月1日", "Shop B", "Beta", "1", "20", "待确认"),
         ("D4", "2024年2月2日", None, "Beta", "1", "20", "20"),
         ("D5", "2024年2月3日", "Shop B", "Beta", "1", "9999", "9999"),
         ("D6", "2024年2月4日", "NA", "Beta", "1", "20", "20"),
         ("D7", "2024年2月5日", "Shop C", "Gamma", "3", "5", "15")],
        DEALER_SHEET_SCHEMA)
    return FrameCatalog({"products": products, "product_categories": pcat,
                         "product_category_relationship": pcr, "inventory": inventory, "users": users,
                         "orders": orders, "order_items": items, "payments": payments,
                         "dealer_sheet": sheet})


def test_products(cat):
    got = {(r.product_id, r.category): r for r in conform.products(cat).collect()}
    # product 1 is in two categories; duplicate relationship rows of 2 collapse; 3 has none; 4's is unknown
    assert sorted(got) == [(1, "Herbs"), (1, "Oils"), (2, "Herbs"), (3, "未分类"), (4, "未分类")]
    assert got[(1, "Herbs")].cost_price == 3.01          # lowest purchase price, rounded half-up
    assert got[(2, "Herbs")].cost_price == 8.0           # no purchase price: 40 % of the price
    assert got[(1, "Herbs")].gross_margin_pct == 69.9
    assert got[(3, "未分类")].gross_margin_pct is None  # zero price: no margin


def test_customers_active_only(cat):
    assert sorted(r.customer_id for r in conform.customers(cat).collect()) == [1, 3]


def test_orders_fact_inner_joins(cat):
    rows = {r.order_item_id: r for r in conform.orders_fact(cat).collect()}
    assert sorted(rows) == [1000, 1001, 1002, 1005]      # unknown product / user drop out
    assert rows[1000].amount == 20.0 and rows[1000].order_month == "2024-01"
    assert rows[1005].order_month == "NaT"               # missing date keeps a month label
    assert rows[1002].customer_name == "bob"             # inactive buyers stay in the orders


def test_inventory_negative_stock(cat):
    rows = {r.inventory_id: r for r in conform.inventory(cat).collect()}
    assert sorted(rows) == [10, 11, 12]
    assert rows[10].current_stock == 0 and rows[11].current_stock == 7
    assert rows[12].current_stock is None                # missing stays missing
    assert rows[10].safety_stock == 50


def test_dealer_orders(cat):
    rows = {r.order_id: r for r in conform.dealer_orders(cat).collect()}
    # D2 bad date, D3 placeholder amount, D4/D6 no customer, D5 above the p99 cap
    assert sorted(rows) == ["D1", "D7"]
    assert rows["D1"].channel == "经销商" and rows["D1"].status == "completed"
    assert rows["D1"].order_month == "2024-01"


def test_collections(cat):
    rows = {r.payment_id: r for r in conform.collections(cat).collect()}
    assert (rows[1].collected, rows[1].outstanding) == (50.0, 0.0)
    assert (rows[3].collected, rows[3].outstanding) == (0.0, 5.0)   # NULL status: nothing collected
    assert rows[4].customer_name is None                            # order deleted
    assert (rows[5].receivable, rows[5].collected, rows[5].outstanding) == (None, 0.0, None)


def test_all_orders_union_and_channel(cat):
    allo = conform.all_orders(cat)
    assert dict(allo.dtypes)["order_id"] == "string"
    assert allo.count() == 6
    dealer = conform.all_orders(cat, conform.CHANNEL_DEALER)
    assert {r.channel for r in dealer.collect()} == {"经销商"}
    assert dealer.filter(F.col("order_item_id").isNotNull()).count() == 0
    assert conform.all_orders(cat, conform.CHANNEL_ERP).count() == 0
    with pytest.raises(ValueError):
        conform.all_orders(cat, "nope")


def test_monthly_and_mom(spark, cat):
    m = {r.order_month: r for r in metrics.monthly_trend(conform.all_orders(cat)).collect()}
    assert sorted(m) == ["2024-01", "2024-02", "NaT"]
    assert m["2024-01"].order_lines == 3 and m["2024-01"].sales == 60.0  # 20 + 20 shop, 20 dealer
    monthly = spark.createDataFrame(
        [(f"2024-0{i + 1}", 1, float(s)) for i, s in enumerate([100, 150, 0, 0, 30])],
        "order_month string, order_lines bigint, sales double")
    mom = [r.mom_pct for r in metrics.month_over_month(monthly).orderBy("order_month").collect()]
    assert mom == [None, 50.0, -100.0, None, None]


def test_group_rules(spark):
    orders = spark.createDataFrame(
        [("m1", "a", None, "x"), ("m1", "a", None, "x"), (None, None, 5.0, None), ("m2", "b", 2.5, "y")],
        "order_month string, customer_name string, amount double, status string"
    ).withColumn("order_id", F.lit("o")).withColumn("product_name", F.col("customer_name")) \
     .withColumn("quantity", F.lit(1.0))
    m = {r.order_month: r for r in metrics.monthly_trend(orders).collect()}
    assert None not in m                                       # NULL key dropped
    assert (m["m1"].sales, m["m1"].avg_amount) == (0.0, None)  # all-NULL amounts: sum 0, mean NULL
    assert m["m2"].sales == 2.0                                # half-to-even
    st = {r.status: r for r in metrics.order_status(orders).collect()}
    assert st["x"].order_lines == 2 and st["x"].share_pct == 66.7


def test_ties_break_on_key(spark):
    orders = spark.createDataFrame(
        [(n, 1.0, 1.0) for n in "dcbalkjihgfe"], "product_name string, quantity double, amount double"
    ).withColumn("order_id", F.lit("o")).withColumn("customer_name", F.col("product_name"))
    top = [r.product_name for r in metrics.top_products(orders).collect()]
    assert top == sorted("dcbalkjihgfe")[:10]


def test_category_name_join(spark):
    orders = spark.createDataFrame(
        [("o1", "A", 10.0), ("o2", "A", 5.0), ("o3", "Z", 1.0), ("o4", None, 2.0)],
        "order_id string, product_name string, amount double")
    products = spark.createDataFrame(
        [("A", "Herbs"), ("A", "Oils"), ("A", "Herbs"), (None, "Misc")], "product_name string, category string")
    got = {r.category: (r.order_lines, r.sales) for r in metrics.category_sales(orders, products).collect()}
    # A counts twice under Herbs (two catalogue rows), once under Oils; Z unknown; NULL matches NULL
    assert got == {"Herbs": (4, 30.0), "Oils": (2, 15.0), "Misc": (1, 2.0)}


def test_receivables(cat):
    coll = conform.collections(cat)
    tot = metrics.receivable_totals(coll).first()
    assert (tot.receivable, tot.collected) == (93.0, 50.0)
    assert tot.recovery_pct == 53.8
    debt = {r.customer_name: r for r in metrics.receivables_by_customer(coll).collect()}
    assert None not in debt
    assert debt["bob"].outstanding == 35.0
    assert [r.customer_name for r in metrics.debt_top(coll).collect()] == ["bob"]


def test_receivables_gate_zero_total(spark, cat):
    coll = conform.collections(cat).withColumn("receivable", F.lit(0.0))
    assert metrics.receivables_by_customer(coll).count() == 0
    assert metrics.receivable_totals(coll).first().recovery_pct is None


def test_inventory_value_order(cat):
    inv = conform.inventory(cat)
    rows = metrics.inventory_value(inv).collect()
    assert [r.inventory_id for r in rows] == [11, 10, 12]  # NULL value last
    assert rows[0].stock_value == pytest.approx(21.07)

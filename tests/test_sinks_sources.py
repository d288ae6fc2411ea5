"""Snapshots (append / replace a month), CSV landing source, JDBC options."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from salesflow.operators import conform, metrics
from salesflow.sinks.snapshot import read_snapshot, write_snapshot
from salesflow.sources import fixtures
from salesflow.sources.catalog import (
    SOURCE_TABLES, SourceCatalog, SourceSpec, dealer_sheet_spec, jdbc_options, jdbc_options_from_env, jdbc_table,
)
from salesflow.sources.fixtures import FixtureCatalog

from conftest import SF_SMALL


def test_snapshot_append_and_replace(spark):
    path = tempfile.mkdtemp(prefix="snap-", dir="/tmp") + "/t"
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    write_snapshot(df, path, "202608")
    write_snapshot(df, path, "202608")                       # plain append duplicates the month
    write_snapshot(df.limit(1), path, "202609")
    assert read_snapshot(spark, path, df.schema, "202608").count() == 6
    write_snapshot(df, path, "202608", replace_month=True)  # dynamic overwrite of that month only
    snap = read_snapshot(spark, path, df.schema)
    assert snap.filter(F.col("report_month") == "202608").count() == 3
    assert snap.filter(F.col("report_month") == "202609").count() == 1
    assert dict(snap.dtypes)["report_month"] == "string"
    plan = read_snapshot(spark, path, df.schema, "202609")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "202609" in plan


def test_snapshot_skips_empty(spark):
    path = tempfile.mkdtemp(prefix="snap-", dir="/tmp") + "/t"
    df = spark.createDataFrame([], "id int")
    assert write_snapshot(df, path, "202608", skip_empty=True) is False


def test_dealer_sheet_from_csv(spark):
    """The dealer sheet read as an all-text CSV export gives the same dealer orders."""
    fx = FixtureCatalog(spark, SF_SMALL)
    out = tempfile.mkdtemp(prefix="landing-", dir="/tmp") + "/dealer_csv"
    fx.derive("dealer_sheet").write.option("header", "true").csv(out)
    csv_cat = SourceCatalog(spark, {"dealer_sheet": dealer_sheet_spec(out)})
    a = conform.dealer_orders(csv_cat).orderBy("order_id").collect()
    b = conform.dealer_orders(fx).orderBy("order_id").collect()
    assert len(a) == len(b) > 0
    assert a == b


def test_parquet_catalog(spark):
    fx = FixtureCatalog(spark, SF_SMALL)
    base = tempfile.mkdtemp(prefix="lake-", dir="/tmp")
    for name in ("users", "orders", "order_items", "products"):
        fx.derive(name).write.parquet(f"{base}/{name}")
    cat = SourceCatalog.parquet_dir(spark, base)
    assert conform.orders_fact(cat).count() == conform.orders_fact(fx).count()
    plan = conform.customers(cat)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,active)]" in plan


def test_jdbc_options():
    assert jdbc_options("mysql", "h", 3306, "u", "p", "db")["url"].startswith("jdbc:mysql://h:3306/db")
    assert jdbc_options("mssql", "h", 1433, "u", "p", "db")["url"].startswith("jdbc:sqlserver://h:1433")
    assert jdbc_options("sqlite", database="/x.db") == {"url": "jdbc:sqlite:/x.db", "driver": "org.sqlite.JDBC"}
    with pytest.raises(ValueError):
        jdbc_options("oracle")
    env = {"ERP_DB_TYPE": "sqlite", "ERP_DB_NAME": "/d.db"}
    assert jdbc_options_from_env("ERP", env)["url"] == "jdbc:sqlite:/d.db"
    spec = jdbc_table(jdbc_options("sqlite", database="/d.db"), "orders", partition_column="order_id",
                      lower=1, upper=1000, partitions=8)
    assert isinstance(spec, SourceSpec) and spec.options["numPartitions"] == "8"
    with pytest.raises(ValueError):
        jdbc_table({}, "t", partition_column="id")


def test_sql_text_source(spark):
    """A source given as SQL text over the session's views."""
    FixtureCatalog(spark, SF_SMALL, land=False).derive("users").createOrReplaceTempView("users_src")
    cat = SourceCatalog(spark, {"users": SourceSpec("sql", "SELECT * FROM users_src WHERE user_id > 0")})
    got = conform.customers(cat)
    want = conform.customers(FixtureCatalog(spark, SF_SMALL)).filter("customer_id > 0")
    assert got.count() == want.count() > 0


def test_large_tables_are_read_as_they_are(spark, tmp_path, monkeypatch):
    day = dt.datetime(2024, 3, 5)
    tables = {
        "part": ([(k, "p", "b", "t", 46, 10.5 * n) for n, k in enumerate((1, 2, 7, 7, None))],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "supplier": ([(1, "s"), (20, None)], "s_suppkey long, s_name string"),
        "customer": ([(1, "c1", "MACHINERY"), (2, None, None)], "c_custkey long, c_name string, c_mktsegment string"),
        "orders": ([(k, c, "F", 9.0, day) for k, c in ((1, 1), (1, 2), (50, 1), (None, 2))],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz"),
        "lineitem": ([(o, p, s, n, 3.0, 0.1, day) for n, (o, p, s) in enumerate(
            ((1, 1, 1), (1, 7, 20), (50, 2, 1), (None, 7, 1), (50, None, 1), (3, 2, None), (50, 2, 1)))],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, "
            "l_shipdate timestamp_ntz"),
        "events": ([(k, day, u, 2.5) for k, u in ((1, 1), (17, 2), (23, 7), (5, None))],
                   "event_id long, ts timestamp_ntz, user_id long, value double"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/in/{name}.parquet")
    base = spark.conf.get("salesflow.warehouse.dir", None)
    spark.conf.set("salesflow.warehouse.dir", f"{tmp_path}/shared")
    try:
        small = FixtureCatalog(spark, f"{tmp_path}/in")
        landed = {t: sorted(map(str, small.table(t).collect())) for t in SOURCE_TABLES}
        monkeypatch.setattr(fixtures, "LAND_BELOW_ROWS", 5)   # what comes from lineitem and part does not land
        spark.conf.set("salesflow.warehouse.dir", f"{tmp_path}/other")
        large = FixtureCatalog(spark, f"{tmp_path}/in")
        for t in SOURCE_TABLES:
            assert sorted(map(str, large.table(t).collect())) == landed[t]
            assert large.table(t).dtypes == small.table(t).dtypes
        wrote = set(os.listdir(os.path.dirname(large.landing_path("orders"))))
        assert wrote == {"users", "orders", "payments", "dealer_sheet"}
        sales = [metrics.category_sales(conform.all_orders(c), conform.products(c)).collect() for c in (small, large)]
        assert sales[0] == sales[1] and len(sales[0]) > 0
    finally:
        if base is None:
            spark.conf.unset("salesflow.warehouse.dir")
        else:
            spark.conf.set("salesflow.warehouse.dir", base)

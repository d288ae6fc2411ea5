"""The spark-submit job over Parquet sources writes every result and the snapshots."""

import argparse
import tempfile

import pytest

from salesflow.sinks.snapshot import read_snapshot
from salesflow.sources.catalog import SOURCE_TABLES
from salesflow.sources.fixtures import FixtureCatalog
from scripts.monthly_run import parse_args, run, source_spec

from conftest import SF_SMALL


def test_monthly_run(spark):
    base = tempfile.mkdtemp(prefix="job-", dir="/tmp")
    fx = FixtureCatalog(spark, SF_SMALL, land=False)
    for name in SOURCE_TABLES:
        if name != "dealer_sheet":
            fx.derive(name).write.parquet(f"{base}/sources/{name}")
    fx.derive("dealer_sheet").write.option("header", "true").csv(f"{base}/sheet")
    args = parse_args(["--sources", f"{base}/sources", "--out", f"{base}/out", "-m", "202608",
                       "--report", "sales", "--source", f"dealer_sheet=csv:{base}/sheet"])
    written = run(spark, args)
    assert "monthly_trend" in written and "inventory_value" not in written
    got = spark.read.parquet(written["monthly_trend"])
    assert got.count() > 0 and got.columns == ["order_month", "order_lines", "sales", "avg_amount"]
    path = f"{base}/out/snapshots/report_orders"
    data_schema = spark.read.parquet(path).drop("report_month").schema
    snap = read_snapshot(spark, path, data_schema, "202608")
    assert snap.count() > 0 and "channel" in snap.columns


def test_source_spec():
    name, spec = source_spec("users=sql:select * from u")
    assert name == "users" and spec.format == "sql" and spec.path == "select * from u"
    for bad in ("users", "nothing=csv:/x", "users=xls:/x", "users=csv:"):
        with pytest.raises(argparse.ArgumentTypeError):
            source_spec(bad)

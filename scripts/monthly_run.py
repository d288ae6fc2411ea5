"""The monthly job as a spark-submit entry point.

    spark-submit scripts/monthly_run.py --sources /lake/sales --out /lake/reports \
        --month 202608 --channel 全部 --report full [--source dealer_sheet=csv:/landing/dealer] \
        [--no-persist] [--one-pass] [--replace-month]

Reads the operational tables from ``--sources/<table>`` (Parquet), or where a
``--source table=format:path`` names another place (``parquet``, ``orc``,
``csv``, ``json``, ``table``, or ``sql`` with a statement as its path), writes
every result of the requested report sections to ``--out/<month>/<name>``
(Parquet, overwritten per run) and appends the cleaned tables as monthly
snapshots under ``--out/snapshots``. The session's own settings are used;
nothing here is specific to one cluster.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from salesflow.operators.conform import CHANNEL_ALL, CHANNELS  # noqa: E402
from salesflow.plans.pipeline import REPORTS, Analysis, AnalysisParams  # noqa: E402
from salesflow.sources.catalog import (  # noqa: E402
    SOURCE_TABLES, SourceCatalog, SourceSpec, dealer_sheet_spec,
)

FORMATS = ("parquet", "orc", "csv", "json", "table", "sql")


def source_spec(text: str) -> tuple[str, SourceSpec]:
    """``table=format:path`` as a named source."""
    name, _, place = text.partition("=")
    fmt, _, path = place.partition(":")
    if name not in SOURCE_TABLES or fmt not in FORMATS or not path:
        raise argparse.ArgumentTypeError(f"expected table=format:path, got {text!r}")
    if name == "dealer_sheet" and fmt == "csv":
        return name, dealer_sheet_spec(path)
    return name, SourceSpec(fmt, path, {"header": "true", "inferSchema": "true"} if fmt == "csv" else {})


def parse_args(argv=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Monthly sales, stock and receivables analysis")
    p.add_argument("--sources", required=True, help="folder with one Parquet table per source")
    p.add_argument("--out", required=True, help="output folder (results and snapshots)")
    p.add_argument("--month", "-m", default=None, help="report month tag, yyyyMM (default: current)")
    p.add_argument("--channel", "-c", default=CHANNEL_ALL, choices=CHANNELS)
    p.add_argument("--report", "-r", default="full", choices=REPORTS)
    p.add_argument("--source", action="append", type=source_spec, default=[], metavar="TABLE=FORMAT:PATH",
                   help="where one table is, if not under --sources (repeatable)")
    p.add_argument("--persist", action=argparse.BooleanOptionalAction, default=True,
                   help="keep the order lines for all analyses")
    p.add_argument("--one-pass", action="store_true", help="sales metrics from one GROUPING SETS pass")
    p.add_argument("--replace-month", action="store_true", help="rewrite this month's snapshot")
    return p.parse_args(argv)


def run(spark: SparkSession, args: argparse.Namespace) -> dict[str, str]:
    params = {"channel": args.channel, "report": args.report, "persist": args.persist,
              "one_pass": args.one_pass}
    if args.month:
        params["report_month"] = args.month
    catalog = SourceCatalog.parquet_dir(spark, args.sources)
    a = Analysis(SourceCatalog(spark, catalog.specs | dict(args.source)), AnalysisParams(**params))
    out = args.out.rstrip("/")
    written = {}
    try:
        for name, df in a.run().items():
            path = f"{out}/{a.params.report_month}/{name}"
            df.write.mode("overwrite").parquet(path)
            written[name] = path
        a.save_snapshots(f"{out}/snapshots", replace_month=args.replace_month)
    finally:
        if args.persist:
            a.orders.unpersist()
    return written


def main(argv=None) -> None:
    args = parse_args(argv)
    spark = SparkSession.builder.appName("salesflow-monthly").getOrCreate()
    for name, path in sorted(run(spark, args).items()):
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()

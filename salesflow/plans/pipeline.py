"""The monthly analysis run: conform, unify, analyse, snapshot.

``Analysis`` builds every conformed table and metric lazily from a source
catalog and a set of ``AnalysisParams``. Nothing executes until a result is
written or collected. ``run()`` returns the DataFrames of the requested
report sections; ``save_snapshots()`` appends the cleaned tables under the
report month.

The channel filter is applied to the union *before* it is persisted, so the
pruned channel's branch is never read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from functools import cached_property, reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow.operators import conform, metrics, quality
from salesflow.plans import report
from salesflow.session import shared_dir
from salesflow.sinks.snapshot import read_snapshot, snapshot_counts, write_snapshot

REPORTS = ("full", "sales", "inventory", "collection")

SECTIONS = {
    "sales": ("monthly_trend", "month_over_month", "best_month", "latest_month", "top_products",
              "category_sales", "customer_value", "customer_value_series", "order_status"),
    "inventory": ("inventory_value", "inventory_top10", "low_stock"),
    "collection": ("receivables_by_customer", "debt_top", "receivable_totals"),
}

SNAPSHOT_TABLES = ("products", "orders", "inventory", "collections")
# Columns whose ranges the files of a snapshot hold; the second spreads a time that many rows share.
SNAPSHOT_ORDER = {"orders": ("order_date", "order_id")}


@dataclass(frozen=True)
class AnalysisParams:
    """Run parameters. ``report_month`` only tags snapshots; it filters nothing."""

    report_month: str = field(default_factory=lambda: date.today().strftime("%Y%m"))
    channel: str = conform.CHANNEL_ALL
    report: str = "full"
    persist: bool = False
    # Compute the sales metrics (and receivables) from one GROUPING SETS pass
    # instead of one aggregation each. Worth it when the order-line joins are
    # large shuffles that are not persisted; with broadcast joins or a
    # persisted union, separate aggregations are cheaper.
    one_pass: bool = False

    def __post_init__(self):
        if self.channel not in conform.CHANNELS:
            raise ValueError(f"channel must be one of {conform.CHANNELS}")
        if self.report not in REPORTS:
            raise ValueError(f"report must be one of {REPORTS}")

    def sections(self) -> tuple[str, ...]:
        return tuple(SECTIONS) if self.report == "full" else (self.report,)


class Analysis:
    """The monthly run over one source catalog (see the module docstring)."""

    def __init__(self, catalog, params: AnalysisParams | None = None):
        self.catalog = catalog
        self.params = params or AnalysisParams()

    # -- conformed tables --------------------------------------------------
    @cached_property
    def products(self) -> DataFrame:
        return conform.products(self.catalog)

    @cached_property
    def customers(self) -> DataFrame:
        return conform.customers(self.catalog)

    @cached_property
    def shop_orders(self) -> DataFrame:
        return conform.orders_fact(self.catalog)

    @cached_property
    def dealer_orders(self) -> DataFrame:
        return conform.dealer_orders(self.catalog)

    @cached_property
    def inventory(self) -> DataFrame:
        return conform.inventory(self.catalog)

    @cached_property
    def collections(self) -> DataFrame:
        return conform.collections(self.catalog)

    @cached_property
    def orders(self) -> DataFrame:
        """All order lines of the selected channel (persisted when asked to)."""
        df = conform.all_orders(self.catalog, self.params.channel,
                                shop=self.shop_orders, dealer=self.dealer_orders)
        if self.params.persist:
            # Recomputable from lineage if an executor is lost.
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
        return df

    # -- metrics -----------------------------------------------------------
    @cached_property
    def monthly_trend(self) -> DataFrame:
        return metrics.monthly_trend(self.orders)

    def month_over_month(self) -> DataFrame:
        return metrics.month_over_month(self.monthly_trend)

    def best_month(self) -> DataFrame:
        return metrics.best_month(self.monthly_trend)

    def latest_month(self) -> DataFrame:
        return metrics.latest_month(self.monthly_trend)

    @cached_property
    def top_products(self) -> DataFrame:
        return metrics.top_products(self.orders)

    def category_sales(self) -> DataFrame:
        return metrics.category_sales(self.orders, self.products)

    def customer_value(self) -> DataFrame:
        return metrics.customer_value(self.orders)

    def customer_value_series(self) -> DataFrame:
        return metrics.customer_value_series(self.orders)

    def order_status(self) -> DataFrame:
        return metrics.order_status(self.orders)

    def inventory_value(self) -> DataFrame:
        return metrics.inventory_value(self.inventory)

    def inventory_top10(self) -> DataFrame:
        return metrics.inventory_top(self.inventory)

    def low_stock(self) -> DataFrame:
        return metrics.low_stock(self.inventory)

    def receivables_by_customer(self) -> DataFrame:
        return metrics.receivables_by_customer(self.collections)

    @cached_property
    def debt_top(self) -> DataFrame:
        return metrics.debt_top(self.collections)

    @cached_property
    def receivable_totals(self) -> DataFrame:
        return metrics.receivable_totals(self.collections)

    # -- reports -----------------------------------------------------------
    def report_headline(self) -> DataFrame:
        return report.report_headline(self.orders, self.products, self.customers)

    def load_counts(self) -> DataFrame:
        tables = {"products": self.products, "customers": self.customers,
                  "inventory": self.inventory, "collections": self.collections}
        if self.params.channel == conform.CHANNEL_ALL:
            # shop, dealer and all order lines from one pass over the union
            return report.load_counts(tables, (self.orders, {
                "shop_orders": conform.CHANNEL_SHOP, "dealer_orders": conform.CHANNEL_DEALER,
                "all_orders": "*"}))
        return report.load_counts({**tables, "shop_orders": self.shop_orders,
                                   "dealer_orders": self.dealer_orders, "all_orders": self.orders})

    # -- one-pass rollups (used by the full run and the digest) -------------
    @cached_property
    def sales(self) -> dict[str, DataFrame]:
        """Month / product / customer / status results from one pass over the order lines."""
        return metrics.from_rollup(metrics.sales_rollup(self.orders))

    @cached_property
    def receivables(self) -> dict[str, DataFrame]:
        """Per-customer and total receivables from one pass over the payments."""
        return metrics.receivables_rollup(self.collections)

    def digest(self) -> DataFrame:
        if self.params.one_pass:
            s, r = self.sales, self.receivables
            return report.digest(s["monthly"], metrics.ranked_products(None, per_product=s["product"]),
                                 r["totals"], metrics.debt_top_of(r["by_customer"]), self.inventory)
        return report.digest(self.monthly_trend, metrics.ranked_products(self.orders), self.receivable_totals,
                             self.debt_top, self.inventory)

    def dq_report(self) -> DataFrame:
        return quality.dq_report(self.catalog, {
            "products": lambda: self.products, "customers": lambda: self.customers,
            "orders": lambda: self.shop_orders, "inventory": lambda: self.inventory,
            "dealer_orders": lambda: self.dealer_orders, "collections": lambda: self.collections})

    # -- run ---------------------------------------------------------------
    def run(self) -> dict[str, DataFrame]:
        """Plans of every metric in the requested sections plus the reports.

        With ``one_pass`` the sales metrics share one GROUPING SETS pass over
        the order lines and the receivables one pass over the payments.
        """
        out = {}
        sections = self.params.sections()
        if not self.params.one_pass:
            for section in sections:
                for name in SECTIONS[section]:
                    attr = getattr(self, name)
                    out[name] = attr() if callable(attr) else attr
        elif "sales" in sections:
            s = self.sales
            out.update(
                monthly_trend=s["monthly"],
                month_over_month=metrics.month_over_month(s["monthly"]),
                best_month=metrics.best_month(s["monthly"]),
                latest_month=metrics.latest_month(s["monthly"]),
                top_products=metrics.top_products(None, per_product=s["product"]),
                category_sales=self.category_sales(),
                customer_value=metrics.customer_value(None, per_customer=s["customer"]),
                customer_value_series=metrics.customer_value_series(None, per_customer=s["customer"]),
                order_status=s["status"],
            )
        if self.params.one_pass and "inventory" in sections:
            out.update(inventory_value=self.inventory_value(), inventory_top10=self.inventory_top10(),
                       low_stock=self.low_stock())
        if self.params.one_pass and "collection" in sections:
            r = self.receivables
            out.update(receivables_by_customer=r["by_customer"],
                       debt_top=metrics.debt_top_of(r["by_customer"]),
                       receivable_totals=r["totals"])
        if "sales" in sections:
            out["report_headline"] = self.report_headline()
        if self.params.report == "full":
            out["digest"] = self.digest()
            out["load_counts"] = self.load_counts()
            out["dq_report"] = self.dq_report()
        return out

    # -- snapshots ---------------------------------------------------------
    def snapshot_sources(self) -> dict[str, DataFrame]:
        return {"products": self.products, "orders": self.orders,
                "inventory": self.inventory.withColumn("stock_value", metrics.stock_value()),
                "collections": self.collections}

    def snapshot_path(self, table: str, base: str | None = None) -> str:
        """``base``, else the folder named by ``salesflow.warehouse.dir``: history must outlive a run."""
        spark = self.products.sparkSession
        if base is None and not spark.conf.get("salesflow.warehouse.dir", None):
            raise ValueError("name a lasting folder: pass base, or set salesflow.warehouse.dir")
        root = base or shared_dir(spark, "snapshots")
        return f"{root.rstrip('/')}/report_{table}"

    def save_snapshot(self, table: str, base: str | None = None, replace_month: bool = False) -> bool:
        """Append one cleaned table under the report month; empty stock/payments are skipped.

        Order lines lie in ranges of their time, so that a reader of some days skips the other row groups.
        """
        return write_snapshot(self.snapshot_sources()[table], self.snapshot_path(table, base),
                              self.params.report_month, replace_month=replace_month,
                              skip_empty=table in ("inventory", "collections"),
                              cluster_by=SNAPSHOT_ORDER.get(table, ()))

    def save_snapshots(self, base: str | None = None, replace_month: bool = False) -> dict[str, bool]:
        """Append every cleaned table under the report month (never overwriting by default)."""
        return {t: self.save_snapshot(t, base, replace_month) for t in SNAPSHOT_TABLES}

    def read_snapshot(self, table: str, base: str | None = None, month: str | None = None, latest: bool = False,
                      drift: bool = False) -> DataFrame:
        df = self.snapshot_sources()[table]
        return read_snapshot(df.sparkSession, self.snapshot_path(table, base), df.schema, month, latest, drift)

    def snapshot_counts(self, base: str | None = None) -> DataFrame:
        """(table_name, row_count) of the report month, counted as the snapshots were written: no scan."""
        spark = self.products.sparkSession
        month = F.col("report_month") == self.params.report_month
        parts = [snapshot_counts(spark, self.snapshot_path(t, base), latest=True).filter(month)
                 .select(F.lit(t).alias("table_name"), "row_count") for t in SNAPSHOT_TABLES]
        return reduce(DataFrame.unionByName, parts)

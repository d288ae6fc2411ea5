"""Source tables of the sales business, derived from the test-data star schema.

The test data is a TPC-H-like star (part, customer, orders, lineitem, ...)
plus an ``events`` table. These adapters reshape it into the operational
tables the conform layer reads (products, categories, inventory, users,
orders, order items, payments and the dealer sheet), with the edge cases the
business data has: uncategorised products, products in two categories,
negative stock, missing purchase prices, inactive users, payments whose order
was deleted, unparseable dates and placeholder amounts on the dealer sheet.

The same shapes are written as SQL in ``salesflow.plans.oracle`` so DuckDB can
check every query independently.
"""

from __future__ import annotations

import threading

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.session import parallelism, shared_dir
from salesflow.sources.catalog import DEALER_SHEET_COLUMNS, DEALER_SHEET_SCHEMA, SOURCE_TABLES

# Bump when the derived dealer sheet changes, so stale landing copies are not reused.
LANDING_VERSION = "v4"
_LANDING_LOCK = threading.Lock()   # one writer per process while a table lands
# Test tables of so many rows hold row groups enough for every core: what is derived from them is not landed,
# so a large table is not dealt out and written again, and a query computes the columns that it reads.
LAND_BELOW_ROWS = 1 << 22
# Test table whose rows each source table has, about.
BASE_TABLES = {
    "products": "part", "product_categories": "part", "product_category_relationship": "part",
    "inventory": "lineitem", "users": "customer", "orders": "orders", "order_items": "lineitem",
    "payments": "orders", "dealer_sheet": "events",
}

def _cat(*parts: Column) -> Column:
    # `||` semantics: NULL if any part is NULL.
    return F.concat(*parts)


class FixtureCatalog:
    """``SourceCatalog``-compatible view over ``{sf_dir}/*.parquet``.

    ``product_names='unique'`` names each product ``"<p_name> #<partkey>"``;
    ``'raw'`` uses the bare ``p_name`` (few distinct values), which makes the
    name join of category sales fan out.

    With ``land=True`` (default) each source table derived from less than
    ``LAND_BELOW_ROWS`` rows is written once as Parquet under the session's
    shared folder (``landing/...``) and read back from there, the way the
    operational tables exist as files or database tables for the real job.
    Larger ones, and with ``land=False`` all, are lazy plans over the test
    tables.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, product_names: str = "unique",
                 land: bool = True):
        if product_names not in ("unique", "raw"):
            raise ValueError(f"product_names must be 'unique' or 'raw', got {product_names!r}")
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.product_names = product_names
        self.land = land
        self._tables: dict[str, DataFrame] = {}

    def landing_path(self, name: str) -> str:
        slug = "".join(ch if ch.isalnum() else "_" for ch in self.sf_dir.strip("/"))
        return shared_dir(self.spark, f"landing/{LANDING_VERSION}/{slug}_{self.product_names}/{name}")

    def landed(self, name: str) -> DataFrame:
        """The landed copy of a source table, written on first use."""
        path = self.landing_path(name)
        reader = self.spark.read
        if name == "dealer_sheet":
            reader = reader.schema(DEALER_SHEET_SCHEMA)
        with _LANDING_LOCK:
            try:
                self.spark.read.text(f"{path}/_SUCCESS")   # only a committed landing is reused
                return reader.parquet(path)
            except AnalysisException:
                # One file per core, like a table in a lake (the test files hold a
                # single row group each, which would leave scans with one task).
                files = max(1, parallelism(self.spark))
                self.derive(name).repartition(files).write.mode("overwrite").parquet(path)
                return reader.parquet(path)

    # -- raw test tables ---------------------------------------------------
    def land_all(self) -> None:
        """Land every source table that lands now (otherwise each lands on first use)."""
        for name in SOURCE_TABLES:
            self.table(name)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _product_name(self, part: DataFrame) -> Column:
        if self.product_names == "raw":
            return part.p_name
        return _cat(part.p_name, F.lit(" #"), part.p_partkey.cast("string"))

    # -- operational tables ------------------------------------------------
    def table(self, name: str) -> DataFrame:
        """The source table; the DataFrame (and its file listing) is built once per catalog."""
        if not hasattr(self, f"_t_{name}"):
            raise KeyError(f"unknown source table {name!r}")
        if name not in self._tables:
            self._tables[name] = self.landed(name) if self.lands(name) else self.derive(name)
        return self._tables[name]

    def lands(self, name: str) -> bool:
        """Whether a source table is landed; the rows are counted from the footers of the test table's files."""
        return self.land and self.raw(BASE_TABLES[name]).count() < LAND_BELOW_ROWS

    def derive(self, name: str) -> DataFrame:
        """The source table as a plan over the test tables."""
        return getattr(self, f"_t_{name}")()

    def _t_products(self) -> DataFrame:
        p = self.raw("part")
        return p.select(
            p.p_partkey.alias("product_id"),
            self._product_name(p).alias("name"),
            p.p_retailprice.cast("decimal(10,2)").alias("price"),
            F.when(p.p_size > 45, "off").otherwise("on").alias("status"),
            p.p_size.alias("quantity"),
        )

    def _t_product_categories(self) -> DataFrame:
        p = self.raw("part")
        types = p.select(p.p_type.alias("category_id"), p.p_type.alias("name")).distinct()
        brands = p.select(p.p_brand.alias("category_id"), p.p_brand.alias("name")).distinct()
        return types.unionByName(brands)

    def _t_product_category_relationship(self) -> DataFrame:
        p = self.raw("part")
        by_type = p.filter(p.p_partkey % 10 != 0).select(
            p.p_partkey.alias("product_id"), p.p_type.alias("category_id"))
        by_brand = p.filter(p.p_partkey % 7 == 0).select(
            p.p_partkey.alias("product_id"), p.p_brand.alias("category_id"))
        return by_type.unionByName(by_brand)

    def _t_inventory(self) -> DataFrame:
        # Every order line is a stock batch; batches of parts whose key is a multiple of 11
        # have no purchase price (their cost falls back to 40 % of the price).
        li = self.raw("lineitem")
        part = self.raw("part").select("p_partkey", "p_retailprice")
        supp = self.raw("supplier").select("s_suppkey", "s_name")
        j = li.join(part, li.l_partkey == part.p_partkey).join(supp, li.l_suppkey == supp.s_suppkey)
        price = (F.col("p_retailprice").cast("decimal(10,2)")
                 * (F.lit(0.3) + F.col("l_discount")).cast("decimal(3,2)")).cast("decimal(14,4)")
        return j.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("inventory_id"),
            F.col("l_partkey").alias("product_id"),
            (F.col("l_quantity").cast("int") - 10).alias("quantity"),
            F.when((F.col("l_suppkey") % 20 == 0) | (F.col("l_partkey") % 11 == 0), F.lit(None)).otherwise(price).alias("purchase_price"),
            F.col("s_name").alias("supplier_info"),
            F.col("l_shipdate").alias("created_at"),
        )

    def _t_users(self) -> DataFrame:
        c = self.raw("customer")
        return c.select(
            c.c_custkey.alias("user_id"),
            c.c_name.alias("username"),
            F.when(c.c_mktsegment == "MACHINERY", "inactive").otherwise("active").alias("status"),
        )

    def _t_orders(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            o.o_orderkey.alias("order_id"),
            o.o_custkey.alias("user_id"),
            o.o_orderdate.alias("created_at"),
            F.when(o.o_orderstatus == "F", "completed")
             .when(o.o_orderstatus == "O", "pending")
             .otherwise("cancelled").alias("status"),
        )

    def _t_order_items(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.select(
            (li.l_orderkey * 10 + li.l_linenumber).alias("order_item_id"),
            li.l_orderkey.alias("order_id"),
            li.l_partkey.alias("product_id"),
            li.l_quantity.cast("int").alias("quantity"),
        )

    def _t_payments(self) -> DataFrame:
        o = self.raw("orders")
        k = o.o_orderkey
        return o.select(
            k.alias("payment_id"),
            F.when(k % 50 == 0, F.lit(-1) - k).otherwise(k).alias("order_id"),
            F.when(k % 97 == 0, F.lit(None)).otherwise(o.o_totalprice.cast("decimal(12,2)")).alias("amount"),
            F.when(k % 31 == 0, F.lit(None).cast("string"))
             .when(o.o_orderstatus == "F", "completed")
             .otherwise("pending").alias("status"),
            o.o_orderdate.alias("payment_time"),
        )

    def _t_dealer_sheet(self) -> DataFrame:
        """The hand-kept dealer sheet: seven text columns with the sheet's headers."""
        e = self.raw("events")
        p = self.raw("part").select("p_partkey", "p_name")
        j = e.join(p, e.user_id == p.p_partkey)
        eid = F.col("event_id")
        qty = F.lit(1) + eid % 9
        date_text = _cat(F.year("ts").cast("string"), F.lit("年"),
                         F.month("ts").cast("string"), F.lit("月"),
                         F.dayofmonth("ts").cast("string"), F.lit("日"))
        cols = [
            _cat(F.lit("D"), eid.cast("string")),
            F.when(eid % 23 == 0, F.lit(None).cast("string"))
             .when(eid % 41 == 0, F.lit("待定"))
             .otherwise(date_text),
            F.when(eid % 29 == 0, F.lit(None).cast("string"))
             .otherwise(_cat(F.lit("Dealer"), F.col("user_id").cast("string"))),
            self._product_name(p),
            qty.cast("string"),
            F.col("value").cast("string"),
            F.when(eid % 17 == 0, F.lit("待确认"))
             .otherwise(F.round(qty * F.col("value"), 2).cast("string")),
        ]
        return j.select(*[c.alias(n) for c, n in zip(cols, DEALER_SHEET_COLUMNS)])

"""Named sources: where each operational table lives and how to read it.

A ``SourceCatalog`` maps table names (``products``, ``users``, ``orders``,
``order_items``, ``inventory``, ``product_categories``,
``product_category_relationship``, ``payments``, ``dealer_sheet``) to a
``SourceSpec``: a Parquet/ORC/CSV path, a metastore table, or a JDBC
connection. Reads are lazy; column pruning and filters reach the scan
(Parquet ``PushedFilters``/``ReadSchema``, JDBC ``WHERE`` clauses).
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# The dealer sheet's headers and their conformed names
# ---------------------------------------------------------------------------
DEALER_SHEET_RENAME = {
    "订单号": "order_id",
    "日期": "date_str",
    "客户单位": "customer_name",
    "货品名称": "product_name",
    "数量": "quantity",
    "单价": "unit_price",
    "金额": "amount",
}
DEALER_SHEET_COLUMNS = list(DEALER_SHEET_RENAME)

# The sheet is typed by hand, so every cell is read as text and typed later.
DEALER_SHEET_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), True) for c in DEALER_SHEET_COLUMNS])

SOURCE_TABLES = (
    "products", "product_categories", "product_category_relationship",
    "inventory", "users", "orders", "order_items", "payments", "dealer_sheet",
)

# Database types a connection may name, with their JDBC URL and driver class.
_JDBC = {
    "mysql": ("jdbc:mysql://{host}:{port}/{db}?characterEncoding=utf8&useUnicode=true",
              "com.mysql.cj.jdbc.Driver"),
    "mssql": ("jdbc:sqlserver://{host}:{port};databaseName={db};encrypt={encrypt}",
              "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "sqlite": ("jdbc:sqlite:{db}", "org.sqlite.JDBC"),
}


def jdbc_options(db_type: str = "mysql", host: str = "127.0.0.1", port: str | int = 3306,
                 user: str = "", password: str = "", database: str = "", encrypt: bool = True) -> dict[str, str]:
    """JDBC reader options for one connection; unknown types raise ValueError. ``encrypt`` is for mssql."""
    if db_type not in _JDBC:
        raise ValueError(f"unsupported database type: {db_type}")
    url, driver = _JDBC[db_type]
    opts = {"url": url.format(host=host, port=port, db=database, encrypt=str(encrypt).lower()), "driver": driver}
    if db_type != "sqlite":
        opts.update(user=user, password=password)
    return opts


def jdbc_options_from_env(prefix: str, environ: Mapping[str, str] | None = None) -> dict[str, str]:
    """Connection options from ``{prefix}_DB_TYPE/_HOST/_PORT/_USER/_PASSWORD/_NAME``."""
    env = os.environ if environ is None else environ
    get = lambda k, d="": env.get(f"{prefix}_DB_{k}", d)
    return jdbc_options(get("TYPE", "mysql"), get("HOST", "127.0.0.1"), get("PORT", "3306"),
                        get("USER"), get("PASSWORD"), get("NAME"))


@dataclass(frozen=True)
class SourceSpec:
    """How to read one table.

    format: ``parquet`` | ``orc`` | ``csv`` | ``json`` | ``table`` | ``sql`` | ``jdbc``.
    ``table`` reads a metastore table named by ``path``; ``sql`` runs the SQL
    text in ``path`` over the session's tables and views.
    For ``jdbc`` give ``options`` with url/driver/credentials and either
    ``dbtable`` or ``query``; add ``partitionColumn``/``lowerBound``/
    ``upperBound``/``numPartitions`` for a parallel read.
    """

    format: str
    path: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)
    schema: T.StructType | str | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        if self.format == "table":
            return spark.table(self.path)
        if self.format == "sql":
            return spark.sql(self.path)
        if self.format == "csv":
            return self._read_csv(spark)
        reader = spark.read.format(self.format)
        if self.schema is not None:
            reader = reader.schema(self.schema)
        reader = reader.options(**dict(self.options))
        return reader.load(self.path) if self.path else reader.load()

    def _read_csv(self, spark: SparkSession) -> DataFrame:
        """Columns are bound by header, whatever their order in the file; a missing one raises."""
        raw = spark.read.option("header", "true").options(**dict(self.options)).csv(self.path)
        if self.schema is None:
            return raw
        schema = T.StructType.fromDDL(self.schema) if isinstance(self.schema, str) else self.schema
        missing = [f.name for f in schema.fields if f.name not in raw.columns]
        if missing:
            raise ValueError(f"{self.path} lacks the columns {missing}")
        return raw.select(*[raw[f"`{f.name}`"].cast(f.dataType) for f in schema.fields])


def jdbc_table(connection: Mapping[str, str], table: str, *, partition_column: str | None = None,
               lower: int | None = None, upper: int | None = None,
               partitions: int | None = None, fetchsize: int = 10000) -> SourceSpec:
    """A JDBC table; with a partition column the read is split into range queries."""
    opts = dict(connection, dbtable=table, fetchsize=str(fetchsize))
    if partition_column:
        if lower is None or upper is None or not partitions:
            raise ValueError("partitioned JDBC read needs lower, upper and partitions")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower),
                    upperBound=str(upper), numPartitions=str(partitions))
    return SourceSpec("jdbc", options=opts)


def dealer_sheet_spec(path: str, fmt: str = "csv", **options: str) -> SourceSpec:
    """The dealer sheet exported as text (CSV or Parquet) into a landing folder."""
    return SourceSpec(fmt, path=path, options=options, schema=DEALER_SHEET_SCHEMA if fmt == "csv" else None)


class SourceCatalog:
    """Name → ``SourceSpec``; ``table(name)`` returns a lazy DataFrame."""

    def __init__(self, spark: SparkSession, specs: Mapping[str, SourceSpec]):
        self.spark = spark
        self.specs = dict(specs)
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """Lazy DataFrame of the table, built once per catalog."""
        if name not in self.specs:
            raise KeyError(f"no source configured for table {name!r}")
        if name not in self._tables:
            self._tables[name] = self.specs[name].read(self.spark)
        return self._tables[name]

    @classmethod
    def parquet_dir(cls, spark: SparkSession, base: str) -> "SourceCatalog":
        """Every table at ``{base}/{name}`` (a Parquet file or folder)."""
        base = base.rstrip("/")
        return cls(spark, {t: SourceSpec("parquet", f"{base}/{t}") for t in SOURCE_TABLES})


class FrameCatalog:
    """Name → DataFrame, for tables already in hand (tests, notebooks)."""

    def __init__(self, frames: Mapping[str, DataFrame]):
        self.frames = dict(frames)

    def table(self, name: str) -> DataFrame:
        if name not in self.frames:
            raise KeyError(f"no frame for table {name!r}")
        return self.frames[name]

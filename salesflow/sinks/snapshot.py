"""Monthly snapshot tables: cleaned tables appended under a ``report_month`` tag.

Layout of a table: ``data/report_month=.../batch_id=...`` holds Parquet files,
``_log/commits`` one row for each batch that was published (version, month,
batch, action, rows, schema); ``_log`` is hidden from a plain read of the
folder, and tables that an older release wrote hold part of it in ``commits``.
A write puts a new batch aside and then publishes it by adding its row to
``_log/commits``; readers see published batches only. So a write that fails,
or a job that is run again after a lost driver, changes nothing that can be
read, and a month is replaced in one step, also from a frame that reads the
same table.

The history is never overwritten by default: appending a month twice keeps
both batches, as a plain append does. ``replace_month=True`` makes the month
consist of the new batch alone (nothing, if that is empty) and leaves every
other month as it was; use it to make re-runs idempotent. ``latest=True``
reads the last batch of each month only, so that a month that was appended
twice is not counted twice. Batches that a replacement left behind stay on
disk until housekeeping removes the folders that ``obsolete_batches`` names.

A reader keeps the batches that ``_log/commits`` names by a join on the partition
columns, so Spark prunes the other folders (a month asked for by name is
pruned at once). Columns whose type differs between batches are reconciled
batch by batch before the union by name (``drift=True``).

One job writes a table at a time; two that publish at once both stay readable.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONTH_COLUMN = "report_month"
BATCH_COLUMN = "batch_id"
OLD_COMMITS = "commits"  # folder in which an older release published
COMMIT_SCHEMA = ("version long, report_month string, batch_id string, action string, row_count long, "
                 "data_schema string, committed_at timestamp")


def snapshot_schema(data_schema: T.StructType) -> T.StructType:
    fields = [f for f in data_schema.fields if f.name not in (MONTH_COLUMN, BATCH_COLUMN)]
    return T.StructType(fields + [T.StructField(MONTH_COLUMN, T.StringType(), True)])


def _paths(path: str) -> tuple[str, str]:
    base = path.rstrip("/")
    return f"{base}/data", f"{base}/_log/commits"


# ---------------------------------------------------------------------------
# Commits
# ---------------------------------------------------------------------------

def commits(spark: SparkSession, path: str) -> DataFrame:
    """The published batches of a table, replaced ones included; empty before the first."""
    parts = []
    for folder in (_paths(path)[1], f"{path.rstrip('/')}/{OLD_COMMITS}"):
        try:
            parts.append(spark.read.schema(COMMIT_SCHEMA).parquet(folder))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], COMMIT_SCHEMA)


def live_batches(spark: SparkSession, path: str, latest: bool = False) -> DataFrame:
    """``commits`` that a reader sees: those since a month's last replacement, or its last one only."""
    # One window row for each batch of a month: a table of writes, not of data.
    w = Window.partitionBy(MONTH_COLUMN)
    first = F.max(F.when(F.col("action") == "replace", F.col("version"))).over(w)
    seen = commits(spark, path).withColumn("first_seen", F.coalesce(first, F.lit(0)))
    if latest:
        last = F.max(F.struct("version", BATCH_COLUMN)).over(w)
        return seen.withColumn("last_seen", last).filter(
            F.struct("version", BATCH_COLUMN) >= F.col("last_seen")).drop("first_seen", "last_seen")
    return seen.filter(F.col("version") >= F.col("first_seen")).drop("first_seen")


def obsolete_batches(spark: SparkSession, path: str) -> DataFrame:
    """report_month, batch_id of published batches that a replacement left behind."""
    keys = [MONTH_COLUMN, BATCH_COLUMN]
    return commits(spark, path).select(*keys).join(live_batches(spark, path).select(*keys), keys, "left_anti")


def snapshot_counts(spark: SparkSession, path: str, latest: bool = False) -> DataFrame:
    """report_month, row_count of a table from its commits alone: no data is read."""
    return (live_batches(spark, path, latest).groupBy(MONTH_COLUMN)
            .agg(F.sum("row_count").alias("row_count")))


# ---------------------------------------------------------------------------
# Writing
# ---------------------------------------------------------------------------

def _clustered(df: DataFrame, columns: tuple[str, ...], files: int | None) -> DataFrame:
    """Rows in ranges of ``columns``, sorted: files and row groups hold narrow ranges that a filter skips."""
    spread = df.repartitionByRange(files, *columns) if files else df.repartitionByRange(*columns)
    return spread.sortWithinPartitions(*columns)


def write_snapshot(df: DataFrame, path: str, report_month: str, replace_month: bool = False,
                   skip_empty: bool = False, cluster_by: tuple[str, ...] = (), files: int | None = None) -> bool:
    """Write ``df`` tagged with ``report_month``; returns False if skipped as empty.

    ``cluster_by`` range-partitions the batch by those columns, into ``files`` files if given. A column that
    many rows share should be followed by one that tells them apart, so that a hot value spreads.
    """
    spark, (data, log) = df.sparkSession, _paths(path)
    month, batch = str(report_month), f"{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex}"
    out = df.drop(MONTH_COLUMN, BATCH_COLUMN)
    fields = out.schema.simpleString()
    if cluster_by:
        out = _clustered(out, cluster_by, files)
    (out.withColumns({MONTH_COLUMN: F.lit(month), BATCH_COLUMN: F.lit(batch)})
     .write.partitionBy(MONTH_COLUMN, BATCH_COLUMN).mode("append").parquet(data))
    n = _written(spark, f"{data}/{MONTH_COLUMN}={month}/{BATCH_COLUMN}={batch}")
    if skip_empty and not replace_month and not n:
        return False
    version = commits(spark, path).agg(F.max("version")).first()[0] or 0
    publish = spark.createDataFrame(
        [(version + 1, month, batch, "replace" if replace_month else "append", n, fields, dt.datetime.now(dt.UTC))],
        COMMIT_SCHEMA)
    publish.coalesce(1).write.mode("append").parquet(log)
    return True


def _written(spark: SparkSession, folder: str) -> int:
    """Rows of one batch's folder, from its files' footers; an empty batch has no folder."""
    try:
        return spark.read.parquet(folder).count()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


# ---------------------------------------------------------------------------
# Reading
# ---------------------------------------------------------------------------

def _ddl(fields: str) -> T.StructType:
    return T.StructType.fromDDL(fields.removeprefix("struct<").removesuffix(">"))


def read_snapshot(spark: SparkSession, path: str, data_schema: T.StructType, report_month: str | None = None,
                  latest: bool = False, drift: bool = False) -> DataFrame:
    """Published rows of a snapshot with an explicit schema.

    A month prunes to its folders; the batches to read are pruned when the query runs. With ``drift`` the
    batches are read by the schema that each was written with (one scan for each distinct schema), their
    columns cast to ``data_schema`` (a value that has no such form becomes NULL), missing columns added.
    """
    live = live_batches(spark, path, latest)
    wanted = snapshot_schema(data_schema)
    if report_month is not None:
        live = live.filter(F.col(MONTH_COLUMN) == str(report_month))
    if not drift:
        return _batches(spark, path, data_schema, live, report_month).select(*[F.col(f"`{f.name}`") for f in wanted])
    schemas = [r.data_schema for r in live.select("data_schema").distinct().collect()]  # one for each change of types
    parts = []
    for fields in schemas:
        own = _ddl(fields)
        rows = _batches(spark, path, own, live.filter(F.col("data_schema") == fields), report_month)
        parts.append(rows.select(*[
            (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType))
            .alias(f.name) for f in wanted]))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], wanted)


def _batches(spark: SparkSession, path: str, data_schema: T.StructType, live: DataFrame,
             report_month: str | None) -> DataFrame:
    """Rows of the ``live`` batches, read with ``data_schema``."""
    schema = T.StructType(snapshot_schema(data_schema).fields + [T.StructField(BATCH_COLUMN, T.StringType(), True)])
    try:
        data = spark.read.schema(schema).parquet(_paths(path)[0])
    except AnalysisException as missing:  # a table that no batch was written to yet
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if report_month is not None:
        data = data.filter(F.col(MONTH_COLUMN) == str(report_month))
    # One row for each batch: small against the data that it selects, and Spark prunes the scan by it.
    return data.join(F.broadcast(live.select(BATCH_COLUMN)), BATCH_COLUMN, "left_semi")

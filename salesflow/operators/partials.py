"""Sales totals by month, product, customer and status, kept as partial aggregates of each batch of order lines.

``sales_partials`` reduces a batch to one row for each group with parts that
add up: counts, exact money, quantities. They are stored as a snapshot table,
one batch for each load, so a new load reads its own lines and nothing older;
``merged`` adds the stored parts and gives the same results as one pass over
all lines. A load that is run again replaces its batch and nothing else.
Sums of money are exact, so the number of batches does not change them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesflow.functions.columns import exact_money, huge_money, whole_money
from salesflow.operators.metrics import ROLLUP_KEYS
from salesflow.sinks.snapshot import read_snapshot, write_snapshot

SCHEMA = (T.StructType().add("level", "string").add("key", "string").add("order_lines", "long").add("rows", "long")
          .add("exact", T.DecimalType(38, 10)).add("huge", "double").add("n", "long").add("quantity", "double"))


def sales_partials(lines: DataFrame) -> DataFrame:
    """One row for each group of each level of a batch; a NULL key is kept as a group."""
    keys = list(ROLLUP_KEYS.values())
    level = F.lit(None).cast("string")
    for i, name in enumerate(ROLLUP_KEYS):
        only = (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i))  # of the keys only this one is grouped
        level = F.when(F.col("_gid") == only, F.lit(name)).otherwise(level)
    return lines.groupingSets([[k] for k in keys], *keys).agg(
        F.count("order_id").alias("order_lines"), F.count(F.lit(1)).alias("rows"),
        exact_money(F.col("amount")).cast(SCHEMA["exact"].dataType).alias("exact"), huge_money(F.col("amount")).alias("huge"),
        F.count("amount").alias("n"), F.sum(F.col("quantity").cast("double")).alias("quantity"),
        F.grouping_id(*keys).alias("_gid"),
    ).select(level.alias("level"), F.coalesce(*keys).alias("key"), "order_lines", "rows", "exact", "huge", "n", "quantity")


def add_batch(lines: DataFrame, path: str, batch: str) -> None:
    """Store the partials of one load under its name; loading it again replaces them."""
    write_snapshot(sales_partials(lines), path, batch, replace_month=True)


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The stored partials added up: one row for each group, as columns of ``SCHEMA``."""
    return (read_snapshot(spark, path, SCHEMA).groupBy("level", "key")
            .agg(*[F.sum(c).alias(c) for c in ("order_lines", "rows", "exact", "huge", "n", "quantity")]))


def as_rollup(parts: DataFrame) -> DataFrame:
    """Merged partials in the form that ``metrics.from_rollup`` finishes."""
    return parts.select(
        *[F.col("key").alias(k) for k in ROLLUP_KEYS.values()], F.col("level").alias("_level"), "order_lines",
        F.col("rows").alias("_rows"), whole_money(F.col("exact"), F.col("huge")).alias("_sum"), F.col("n").alias("_n"),
        F.col("quantity").alias("_qty"))


def per_name(parts: DataFrame) -> DataFrame:
    """Merged partials by product name, as ``metrics.category_sales`` joins them to the catalogue."""
    return parts.filter(F.col("level") == "product").select(
        F.col("key").alias("product_name"), F.col("order_lines").alias("_lines"), F.col("exact").alias("_exact"),
        F.col("huge").alias("_huge"))

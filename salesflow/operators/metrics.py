"""Sales, stock and receivables metrics over the conformed tables.

Conventions (those of a pandas group-by, which the reports were built on):
NULL group keys are dropped; ``count`` counts non-null values (order
*lines*, not orders); a sum over no values is 0; a mean over no values is
NULL; rounding is half-to-even. Money is summed exactly and
rounded after the sort, so the ranking uses unrounded values. Ties in a
ranking are broken by the group key, ascending.

Every aggregation is a two-phase hash aggregate (partial per task, final
after the shuffle), so a key holding a third of the rows is combined
map-side. Windows only run over already-aggregated, bounded results
(months, a top-k list); shares of a total use a scalar subquery. Top-k uses ``orderBy().limit()``, which Spark
plans as a per-partition top-k merge (``TakeOrderedAndProject``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesflow.functions.columns import (
    MONEY, exact_money, huge_money, money_sum, percent1, ratio, round0, round1, whole_money,
)

TOP_PRODUCTS = 10
TOP_CUSTOMERS = 15
LABELLED_CUSTOMERS = 8
BUBBLE_SCALE = 40
TOP_STOCK = 10
TOP_DEBTORS = 10


def _sales_aggs():
    """Per-group sums every sales metric is finished from (one partial/final aggregate)."""
    return [
        F.count("order_id").alias("order_lines"),
        F.count(F.lit(1)).alias("_rows"),
        money_sum(F.col("amount")).alias("_sum"),
        F.count("amount").alias("_n"),
        F.sum("quantity").alias("_qty"),
    ]


# Grouping of the one-pass rollup: name -> grouping key.
ROLLUP_KEYS = {"month": "order_month", "product": "product_name",
               "customer": "customer_name", "status": "status"}


def sales_rollup(orders: DataFrame) -> DataFrame:
    """Month, product, customer and status totals in one pass (GROUPING SETS).

    One scan and one shuffle feed every sales metric; ``_level`` names the
    grouping of each row. Rows whose key is NULL are kept here and dropped by
    the finishing steps, as a per-key group-by would.
    """
    keys = list(ROLLUP_KEYS.values())
    g = orders.groupingSets([[k] for k in keys], *keys).agg(
        *_sales_aggs(), F.grouping_id(*keys).alias("_gid"))
    level = F.lit(None).cast("string")
    for i, (name, key) in enumerate(ROLLUP_KEYS.items()):
        gid = (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i))   # only `key` grouped
        level = F.when(F.col("_gid") == gid, F.lit(name)).otherwise(level)
    return g.withColumn("_level", level).drop("_gid")


def rollup_level(rollup: DataFrame, name: str) -> DataFrame:
    """The rows of one grouping of ``sales_rollup``."""
    return rollup.filter(F.col("_level") == name)


def _finish_monthly(g: DataFrame) -> DataFrame:
    return g.filter(F.col("order_month").isNotNull()).select(
        "order_month", "order_lines",
        round0(F.coalesce(F.col("_sum"), F.lit(0.0))).alias("sales"),
        round0(ratio(F.col("_sum"), F.col("_n"))).alias("avg_amount"),
    )


def _finish_products(g: DataFrame) -> DataFrame:
    return (g.filter(F.col("product_name").isNotNull())
            .select("product_name", F.coalesce(F.col("_qty"), F.lit(0.0)).alias("_qty"),
                    F.coalesce(F.col("_sum"), F.lit(0.0)).alias("_sales")))


def _finish_customers(g: DataFrame) -> DataFrame:
    return (g.filter(F.col("customer_name").isNotNull())
            .select("customer_name", "order_lines", F.coalesce(F.col("_sum"), F.lit(0.0)).alias("_spend")))


def _finish_status(g: DataFrame) -> DataFrame:
    # The total is a scalar subquery over the same grouped rows (its exchange is
    # reused), so no single task has to hold every status group.
    g = g.filter(F.col("status").isNotNull())
    total = g.agg(F.sum("_rows")).scalar()
    return g.select("status", F.col("_rows").alias("order_lines"),
                    round1(F.lit(100.0) * ratio(F.col("_rows"), total)).alias("share_pct"))


# ---------------------------------------------------------------------------
# Monthly trend, month over month, best / latest month
# ---------------------------------------------------------------------------

def monthly_trend(orders: DataFrame) -> DataFrame:
    """Per month: order lines, sales and mean line amount (both rounded to 0)."""
    return _finish_monthly(orders.groupBy("order_month").agg(*_sales_aggs()))


def month_over_month(monthly: DataFrame) -> DataFrame:
    """Change of rounded monthly sales against the previous month present, in %.

    Runs over the monthly result (one row per month), so the un-partitioned
    window sees a handful of rows. A zero previous month gives NULL.
    """
    w = Window.orderBy("order_month")
    prev = F.lag("sales").over(w)
    pct = round1((ratio(F.col("sales"), prev) - F.lit(1.0)) * F.lit(100.0))
    return (monthly.select("order_month", "sales", pct.alias("mom_pct"))
            .withColumn("direction", F.when(F.col("mom_pct") < 0, "down").otherwise("up"))
            .withColumn("label", F.when(F.col("mom_pct").isNull(), F.lit(""))
                        .otherwise(F.format_string("%+.1f%%", F.col("mom_pct")))))


def best_month(monthly: DataFrame) -> DataFrame:
    """The month with the highest sales; the earliest month wins a tie."""
    return (monthly.orderBy(F.col("sales").desc(), F.col("order_month").asc())
            .limit(1).select("order_month", "order_lines", "sales"))


def latest_month(monthly: DataFrame) -> DataFrame:
    """The last month present (a missing-date 'NaT' month sorts last)."""
    return (monthly.orderBy(F.col("order_month").desc())
            .limit(1).select("order_month", "order_lines", "sales"))


# ---------------------------------------------------------------------------
# Rankings
# ---------------------------------------------------------------------------

def product_sales(orders: DataFrame) -> DataFrame:
    """Unrounded quantity and sales per product name."""
    return _finish_products(orders.filter(F.col("product_name").isNotNull())
                            .groupBy("product_name").agg(*_sales_aggs()))


def top_products(orders: DataFrame, n: int = TOP_PRODUCTS, per_product: DataFrame | None = None) -> DataFrame:
    """Top products by quantity sold (``per_product``: precomputed ``product_sales``)."""
    return ranked_products(orders, n, per_product).drop("rank")


def ranked_products(orders: DataFrame, n: int = TOP_PRODUCTS, per_product: DataFrame | None = None) -> DataFrame:
    """``top_products`` with its rank, which goes by the unrounded quantity."""
    order = [F.col("_qty").desc(), F.col("product_name").asc()]
    return ((product_sales(orders) if per_product is None else per_product)
            .orderBy(*order).limit(n)
            .select("product_name", round0(F.col("_qty")).alias("quantity"), round0(F.col("_sales")).alias("sales"),
                    F.row_number().over(Window.orderBy(*order)).alias("rank")))


def category_sales(orders: DataFrame | None, products: DataFrame, per_name: DataFrame | None = None) -> DataFrame:
    """Order lines and sales per category, joining lines to products by name.

    A product listed under several categories counts in each; a name the
    catalogue does not know drops out; a NULL name matches a NULL name.
    Lines are first reduced to one row per product name and catalogue rows
    to one row per (name, category) with their multiplicity, so the join
    never materialises the name fan-out: the totals are weighted instead.
    ``per_name``: lines already reduced by name (see ``partials.per_name``).
    """
    if per_name is None:
        per_name = orders.groupBy("product_name").agg(
            F.count("order_id").alias("_lines"),
            exact_money(F.col("amount")).alias("_exact"),
            huge_money(F.col("amount")).alias("_huge"),
        )
    per_cat = (products.select(F.col("product_name").alias("_name"), "category")
               .groupBy("_name", "category").agg(F.count(F.lit(1)).alias("_k")))
    j = per_name.join(per_cat, per_name.product_name.eqNullSafe(per_cat._name))
    g = (j.filter(F.col("category").isNotNull())
         .groupBy("category")
         .agg(F.coalesce(F.sum(F.col("_lines") * F.col("_k")), F.lit(0)).cast("bigint").alias("order_lines"),
              whole_money(F.sum(F.col("_exact") * F.col("_k")), F.sum(F.col("_huge") * F.col("_k"))).alias("_s")))
    return (g.orderBy(F.col("_s").desc(), F.col("category").asc())
            .select("category", "order_lines", round0(F.col("_s")).alias("sales")))


def _customer_totals(orders: DataFrame) -> DataFrame:
    return _finish_customers(orders.filter(F.col("customer_name").isNotNull())
                             .groupBy("customer_name").agg(*_sales_aggs()))


def customer_value(orders: DataFrame, n: int = TOP_CUSTOMERS, per_customer: DataFrame | None = None) -> DataFrame:
    """Top customers by number of order lines, with their spend."""
    return ((_customer_totals(orders) if per_customer is None else per_customer)
            .orderBy(F.col("order_lines").desc(), F.col("customer_name").asc())
            .limit(n)
            .select("customer_name", "order_lines", round0(F.col("_spend")).alias("spend")))


def customer_value_series(orders: DataFrame, n: int = TOP_CUSTOMERS,
                          labelled: int = LABELLED_CUSTOMERS, per_customer: DataFrame | None = None) -> DataFrame:
    """``customer_value`` plus the scatter's bubble size and label flag."""
    top = customer_value(orders, n, per_customer)
    w = Window.orderBy(F.col("order_lines").desc(), F.col("customer_name").asc())
    return top.select(
        "customer_name", "order_lines", "spend",
        (F.col("order_lines") * F.lit(BUBBLE_SCALE)).alias("bubble_size"),
        (F.row_number().over(w) <= labelled).alias("labelled"),
    )


def order_status(orders: DataFrame) -> DataFrame:
    """Lines per status with the share of all lines that have a status, in %."""
    return _finish_status(orders.filter(F.col("status").isNotNull()).groupBy("status").agg(*_sales_aggs()))


def from_rollup(rollup: DataFrame) -> dict[str, DataFrame]:
    """Monthly, per-product, per-customer and per-status results of one ``sales_rollup``."""
    return {
        "monthly": _finish_monthly(rollup_level(rollup, "month")),
        "product": _finish_products(rollup_level(rollup, "product")),
        "customer": _finish_customers(rollup_level(rollup, "customer")),
        "status": _finish_status(rollup_level(rollup, "status")),
    }


# ---------------------------------------------------------------------------
# Stock
# ---------------------------------------------------------------------------

def inventory_value(inv: DataFrame) -> DataFrame:
    """Stock value of each batch, highest first (missing values last).

    The global sort range-partitions on (value, inventory_id, ...), so a value
    shared by many batches (e.g. zero stock) still splits across tasks; the
    extra keys make the order total even when batch ids repeat.
    """
    return (inv.select("inventory_id", "product_name", "current_stock",
                       F.col("purchase_price").cast("double").alias("purchase_price"),
                       stock_value().alias("stock_value"))
            .orderBy(F.col("stock_value").desc_nulls_last(), F.col("inventory_id").asc(),
                     F.col("product_name").asc(), F.col("current_stock").asc(),
                     F.col("purchase_price").asc()))


def stock_value():
    """Value of a batch: stock times purchase price."""
    return (F.col("current_stock") * F.col("purchase_price").cast(MONEY)).cast("double")


def inventory_top(inv: DataFrame, n: int = TOP_STOCK) -> DataFrame:
    return inventory_value(inv).limit(n)


def low_stock(inv: DataFrame) -> DataFrame:
    """Batches below their safety stock."""
    return (inv.filter(F.col("current_stock") < F.col("safety_stock"))
            .select("inventory_id", "product_id", "product_name", "current_stock", "safety_stock"))


# ---------------------------------------------------------------------------
# Receivables
# ---------------------------------------------------------------------------

def receivables_rollup(coll: DataFrame) -> dict[str, DataFrame]:
    """Per-customer and grand totals of receivables in one pass (GROUPING SETS).

    Returns ``{"by_customer": ..., "totals": ...}`` with the same columns as
    ``receivables_by_customer`` and ``receivable_totals``.
    """
    g = coll.groupingSets([["customer_name"], []], "customer_name").agg(
        money_sum(F.col("outstanding")).alias("outstanding"),
        money_sum(F.col("receivable")).alias("receivable"),
        money_sum(F.col("collected")).alias("collected"),
        F.grouping_id("customer_name").alias("_gid"))
    totals = (g.filter(F.col("_gid") == 1)
              .select("receivable", "collected", "outstanding",
                      F.when(F.col("receivable") > 0,
                             percent1(F.col("collected"), F.col("receivable"))).alias("recovery_pct")))
    total = totals.select("receivable").scalar()
    by_customer = (g.filter((F.col("_gid") == 0) & F.col("customer_name").isNotNull() & (total > 0))
                   .select("customer_name", "outstanding", "receivable", "collected",
                           percent1(F.col("collected"), F.col("receivable")).alias("recovery_pct")))
    return {"by_customer": by_customer, "totals": totals}


def debt_top_of(by_customer: DataFrame, n: int = TOP_DEBTORS) -> DataFrame:
    """Customers who still owe money, largest balance first, from per-customer totals."""
    return (by_customer.filter(F.col("outstanding") > 0)
            .orderBy(F.col("outstanding").desc(), F.col("customer_name").asc())
            .limit(n))


def receivable_totals(coll: DataFrame) -> DataFrame:
    """One row: total receivable, collected, outstanding and recovery rate.

    Payments without a customer (deleted orders) are included here.
    """
    g = coll.agg(money_sum(F.col("receivable")).alias("receivable"),
                 money_sum(F.col("collected")).alias("collected"),
                 money_sum(F.col("outstanding")).alias("outstanding"))
    r = F.col("receivable")
    return g.withColumn("recovery_pct", F.when(r > 0, percent1(F.col("collected"), r)))


def receivables_by_customer(coll: DataFrame) -> DataFrame:
    """Per customer: outstanding, receivable, collected and recovery rate.

    Empty unless the total receivable (all payments) is positive. The total is
    a scalar subquery over the same groups, the one without a customer
    included, so the payments are joined and aggregated once.
    """
    g = coll.groupBy("customer_name").agg(
        F.count(F.lit(1)).alias("_rows"),
        money_sum(F.col("outstanding")).alias("outstanding"),
        exact_money(F.col("receivable")).alias("_exact"),
        huge_money(F.col("receivable")).alias("_huge"),
        money_sum(F.col("collected")).alias("collected"))
    # Both sides read every column of the groups and neither filters below them: one exchange serves both.
    total = g.agg(F.struct(
        whole_money(F.sum("_exact"), F.sum("_huge")).alias("receivable"),
        F.sum("_rows"), F.sum("outstanding"), F.sum("collected")).alias("_all")).scalar()
    named = F.when(F.col("_rows") > 0, F.col("customer_name").isNotNull())
    receivable = whole_money(F.col("_exact"), F.col("_huge"))
    return (g.filter(named).filter(total.getField("receivable") > 0)
            .select("customer_name", "outstanding", receivable.alias("receivable"), "collected",
                    percent1(F.col("collected"), receivable).alias("recovery_pct")))


def debt_top(coll: DataFrame, n: int = TOP_DEBTORS) -> DataFrame:
    """Customers who still owe money, largest balance first."""
    return debt_top_of(receivables_by_customer(coll), n)

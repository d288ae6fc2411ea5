"""Report datasets: the numbers behind the headline, the digest and the load log.

Each is a small DataFrame built from the metric plans; delivery (charts,
e-mail, chat) belongs to whatever consumes these rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow.functions.columns import money_sum, round0

DIGEST_TOP_PRODUCTS = 5
DIGEST_TOP_DEBTORS = 3

# ---------------------------------------------------------------------------
# The digest's line texts ({n} = thousands-separated integer)
# ---------------------------------------------------------------------------
EXPIRY_OK = "正常"   # expiry status of a batch that needs no alert
LINE_LATEST = "本月订单: {lines} 单 | 销售额: {sales} 元"
LINE_BEST = "年度最高: {month} | {sales} 元"
LINE_PRODUCT = "  {rank}. {name} — {qty} 件 / {sales} 元"
LINE_RECOVERY = "回款率: {rate}% | 已回: {collected} | 未回: {uncollected}"
LINE_ALERT = "库存预警: {n} 批次临期或过期，请通知仓库主管"
LINE_DEBTOR = "  {name} — 未回款 {outstanding} 元"
LINE_HEADLINE = "总销售额: {sales} 元 | 总订单: {lines} 条 | 产品: {products} 种 | 客户: {customers} 个"


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _thousands(expr: str) -> str:
    """SQL: whole number with thousands separators, ties to even ('1,234')."""
    return f"format_number(CAST({expr} AS DOUBLE), 0)"


def _fill(template: str, **parts: str) -> str:
    """SQL ``concat`` of ``template``'s text and the given SQL parts (NULL if a part is NULL)."""
    out, rest = [], template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        key, rest = tail.split("}", 1)
        if head:
            out.append(_lit(head))
        out.append(f"CAST({parts[key]} AS STRING)")
    if rest:
        out.append(_lit(rest))
    return "concat(" + ", ".join(out) + ")"


def report_headline(orders: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    """One row: total sales, order lines, catalogue rows, active customers and the text line."""
    return orders.agg(
        round0(money_sum(F.col("amount"))).alias("total_sales"),
        F.count(F.lit(1)).alias("order_lines"),
    ).select(
        "total_sales", "order_lines",
        products.agg(F.count(F.lit(1))).scalar().alias("products"),
        customers.agg(F.count(F.lit(1))).scalar().alias("customers"),
    ).withColumn("line", F.expr(_fill(LINE_HEADLINE, sales=_thousands("total_sales"),
                                      lines=_thousands("order_lines"), products="products",
                                      customers="customers")))


def load_counts(tables: dict[str, DataFrame], by_channel: tuple[DataFrame, dict[str, str]] | None = None
                ) -> DataFrame:
    """(table_name, row_count) for each named table, one global count each.

    ``by_channel = (orders, {table_name: channel or "*"})`` counts several
    order tables from one pass over the union, grouped by channel.
    """
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
               .select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    if by_channel is not None:
        orders, names = by_channel
        g = orders.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
        counts = g.agg(*[F.coalesce(F.sum(F.col("n") if ch == "*" else
                                          F.when(F.col("channel") == ch, F.col("n"))), F.lit(0))
                         .cast("bigint").alias(name) for name, ch in names.items()])
        stack = ", ".join(f"{_lit(name)}, `{name}`" for name in names)
        parts.append(counts.selectExpr(f"stack({len(names)}, {stack}) AS (table_name, row_count)"))
    return reduce(DataFrame.unionByName, parts)


def digest(monthly: DataFrame, top_products: DataFrame, totals: DataFrame,
           debt_top: DataFrame, inv: DataFrame | None = None) -> DataFrame:
    """The text digest as rows: (section, rank, label, value1, value2, value3, line).

    Sections: ``latest_month`` and ``best_month`` (lines, sales);
    ``top_product`` 1..5 (quantity, sales); ``recovery`` (rate, collected,
    uncollected) when anything is receivable; ``inventory_alert`` (count)
    when positive; ``debtor`` 1..3 (outstanding). ``line`` is the digest's
    text line for the row. ``top_products`` carries its ``rank``.
    """
    def rows(df: DataFrame, section: str, rank: str, label: str, line: str,
             v1: str, v2: str = "NULL", v3: str = "NULL") -> DataFrame:
        return df.selectExpr(
            f"{_lit(section)} AS section", f"CAST({rank} AS BIGINT) AS rank",
            f"CAST({label} AS STRING) AS label", f"CAST({v1} AS DOUBLE) AS value1",
            f"CAST({v2} AS DOUBLE) AS value2", f"CAST({v3} AS DOUBLE) AS value3", f"{line} AS line")

    c = F.col
    latest = rows(monthly.orderBy(c("order_month").desc()).limit(1), "latest_month", "1", "order_month",
                  _fill(LINE_LATEST, lines="order_lines", sales=_thousands("sales")), "order_lines", "sales")
    best = rows(monthly.orderBy(c("sales").desc(), c("order_month").asc()).limit(1), "best_month", "1",
                "order_month", _fill(LINE_BEST, month="order_month", sales=_thousands("sales")),
                "order_lines", "sales")
    prods = rows(top_products.filter(c("rank") <= DIGEST_TOP_PRODUCTS),
                 "top_product", "rank", "product_name",
                 _fill(LINE_PRODUCT, rank="rank", name="product_name", qty="CAST(quantity AS BIGINT)",
                       sales=_thousands("sales")),
                 "quantity", "sales")
    recovery = rows(totals.filter(c("receivable") > 0), "recovery", "1", "NULL",
                    _fill(LINE_RECOVERY, rate="format_string('%.1f', recovery_pct)",
                          collected=_thousands("collected"), uncollected=_thousands("receivable - collected")),
                    "recovery_pct", "collected", "receivable - collected")
    debt_rank = "row_number() OVER (ORDER BY outstanding DESC, customer_name ASC)"
    debtors = rows(debt_top.orderBy(c("outstanding").desc(), c("customer_name").asc()).limit(DIGEST_TOP_DEBTORS),
                   "debtor", debt_rank, "customer_name",
                   _fill(LINE_DEBTOR, name="customer_name", outstanding=_thousands("outstanding")),
                   "outstanding")
    parts = [latest, best, prods, recovery]
    if inv is not None and "expiry_status" in inv.columns:
        alerts = (inv.agg(F.count_if(c("expiry_status") != EXPIRY_OK).alias("n")).filter(c("n") > 0))
        parts.append(rows(alerts, "inventory_alert", "1", "NULL", _fill(LINE_ALERT, n="n"), "n"))
    parts.append(debtors)
    return reduce(DataFrame.unionByName, parts)

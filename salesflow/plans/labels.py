"""Report output labels and the digest as one text.

Results use ASCII column names; ``relabel`` renames a result to the column
headers the business reports print, for consumers that expect them.
``digest_text`` joins the digest rows into the notification text (the digest
has at most a dozen rows, so one small aggregate is enough).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Printed column headers of each report table
# ---------------------------------------------------------------------------
REPORT_LABELS = {
    "monthly_trend": {"order_lines": "订单数", "sales": "销售额", "avg_amount": "均单金额"},
    "top_products": {"product_name": "产品", "quantity": "销量", "sales": "销售额"},
    "category_sales": {"category": "品类", "order_lines": "订单数", "sales": "销售额"},
    "customer_value": {"customer_name": "客户", "order_lines": "下单次数", "spend": "累计消费"},
    "month_over_month": {"order_month": "月份", "sales": "销售额", "mom_pct": "环比变化"},
    "order_status": {"status": "状态", "order_lines": "数量"},
    "inventory_value": {"product_name": "产品", "current_stock": "库存量", "purchase_price": "进价",
                        "stock_value": "库存金额"},
    "receivables_by_customer": {"outstanding": "未回款", "receivable": "应收", "collected": "已回",
                                "recovery_pct": "回款率"},
}
REPORT_LABELS["customer_value_series"] = REPORT_LABELS["customer_value"]
REPORT_LABELS["inventory_top10"] = REPORT_LABELS["inventory_value"]
REPORT_LABELS["debt_top"] = REPORT_LABELS["receivables_by_customer"]

# Digest headings placed before the first row of a section.
DIGEST_HEADINGS = {"top_product": "热销产品 TOP5:", "debtor": "需催收客户:"}
DIGEST_RULE = "=" * 40
PREVIEW_CHARS = 500

_SECTION_ORDER = ["latest_month", "best_month", "top_product", "recovery", "inventory_alert", "debtor"]


def relabel(df: DataFrame, report: str) -> DataFrame:
    """``df`` with the printed headers of ``report`` (columns without one keep their name)."""
    labels = REPORT_LABELS.get(report)
    if labels is None:
        raise KeyError(f"no labels for report {report!r}")
    return df.withColumnsRenamed({k: v for k, v in labels.items() if k in df.columns})


def digest_text(digest: DataFrame, title: str) -> DataFrame:
    """One row: ``text`` (title, rule, the digest lines in order) and its ``preview``.

    Sections are separated by a blank line and the product and debtor lists get
    their headings, as in the notification body. ``preview`` is the first 500
    characters, what a notification shows when it cannot send the whole body.
    """
    order = F.array_position(F.array(*[F.lit(s) for s in _SECTION_ORDER]), F.col("section"))
    heading = F.coalesce(*[F.when((F.col("section") == s) & (F.col("rank") == 1), F.lit("\n" + h + "\n"))
                           for s, h in DIGEST_HEADINGS.items()],
                         F.when((F.col("section") == "recovery") | (F.col("section") == "inventory_alert"),
                                F.lit("\n")),
                         F.lit(""))
    rows = digest.select(order.alias("o"), F.col("rank").alias("r"),
                         F.concat(heading, F.col("line")).alias("text"))
    body = rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "r", "text"))),
                                             lambda x: x["text"]), "\n").alias("body"))
    text = F.concat_ws("\n", F.lit(title), F.lit(DIGEST_RULE), F.col("body"))
    return body.select(text.alias("text")).withColumn("preview", F.substring("text", 1, PREVIEW_CHARS))

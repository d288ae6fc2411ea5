"""Data-quality expectations as one aggregation pass per table.

Each table gets a single ``agg`` with one conditional count per rule, turned
into rows ``(table_name, rule, violations, total, passed)``. Column and type
contracts are checked on the schemas when the plan is built (they cost no
data pass): ``columns`` counts the columns that a table's sources lack, and
such a table has no other row, for it cannot be read. A NULL in a checked
value counts as a violation, the way an ``all()`` over a comparison with a
missing value fails.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesflow.operators.conform import CHANNEL_DEALER
from salesflow.sources.catalog import DEALER_SHEET_RENAME

# ---------------------------------------------------------------------------
# The columns each table must have, and those its sources must have
# ---------------------------------------------------------------------------
REQUIRED_COLUMNS = {
    "products": ["product_id", "product_name", "category", "cost_price", "unit_price", "gross_margin_pct"],
    "customers": ["customer_id", "customer_name"],
    "orders": ["order_date", "order_month", "customer_name", "product_name", "quantity", "amount"],
    "inventory": ["current_stock"],
    "dealer_orders": ["channel", "order_date", "amount"],
    "collections": ["receivable", "collected", "outstanding"],
}
# Columns both order sources must share so they can be stacked.
MERGE_CONTRACT = ["order_id", "order_date", "order_month", "customer_name", "product_name",
                  "quantity", "amount"]
_PRODUCTS = ["product_id", "name", "price"]
_ORDERS = ["order_id", "user_id"]
_USERS = ["user_id", "username"]
SOURCE_COLUMNS = {
    "products": {"products": _PRODUCTS + ["status", "quantity"], "inventory": ["product_id", "purchase_price"],
                 "product_category_relationship": ["product_id", "category_id"],
                 "product_categories": ["category_id", "name"]},
    "customers": {"users": _USERS + ["status"]},
    "orders": {"order_items": ["order_item_id", "order_id", "product_id", "quantity"],
               "orders": _ORDERS + ["created_at", "status"], "users": _USERS, "products": _PRODUCTS},
    "inventory": {"inventory": ["inventory_id", "product_id", "quantity", "purchase_price", "supplier_info",
                                "created_at"], "products": ["product_id", "name"]},
    "dealer_orders": {"dealer_sheet": list(DEALER_SHEET_RENAME)},
    "collections": {"payments": ["payment_id", "order_id", "amount", "status", "payment_time"],
                    "orders": _ORDERS, "users": _USERS},
}


def missing_columns(src) -> dict[str, int]:
    """Per conformed table: how many columns its sources in the catalog lack.

    The dealer sheet may carry its own headers or the conformed names.
    """
    def lacking(source: str, cols: list[str]) -> int:
        have = src.table(source).columns
        return len([c for c in cols if c not in have and DEALER_SHEET_RENAME.get(c) not in have])

    return {table: sum(lacking(source, cols) for source, cols in sources.items())
            for table, sources in SOURCE_COLUMNS.items()}


def undated_type(src) -> int:
    """1 when the source's order time is no date or timestamp, else 0."""
    kind = src.table("orders").schema["created_at"].dataType
    return 0 if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else 1


def _fails(ok: str) -> str:
    """SQL: count rows where ``ok`` is false or unknown."""
    return f"CAST(count_if(NOT coalesce({ok}, false)) AS BIGINT)"


def _rules_for(name: str, df: DataFrame, data_rules: dict[str, str],
               schema_rules: dict[str, int]) -> DataFrame:
    """One aggregate over ``df`` (a count per data rule), unpivoted to one row per rule.

    A rule named ``table.rule`` is reported under that table.
    """
    aggs = ["count(1) AS total"] + [f"{_fails(ok)} AS {rule}" for rule, ok in data_rules.items()]
    g = df.agg(*[F.expr(a) for a in aggs])
    values = {"nonempty": "CAST(CASE WHEN total = 0 THEN 1 ELSE 0 END AS BIGINT)",
              **{rule: f"CAST({v} AS BIGINT)" for rule, v in schema_rules.items()},
              **{rule: rule for rule in data_rules}}
    rows = []
    for rule, expr in values.items():
        table, _, short = rule.rpartition(".")
        rows.append(f"'{table or name}', '{short}', {expr}")
    return g.selectExpr(f"stack({len(rows)}, {', '.join(rows)}) AS (table_name, rule, violations)",
                        "total").selectExpr("table_name", "rule", "violations", "total",
                                            "violations = 0 AS passed")


DATA_RULES = {
    "products": {"margin_nonneg": "gross_margin_pct >= 0"},
    "customers": {"name_notnull": "customer_name IS NOT NULL"},
    "orders": {"amount_nonneg": "amount >= 0"},
    "inventory": {"stock_nonneg": "current_stock >= 0"},
    "dealer_orders": {"channel_const": f"channel = '{CHANNEL_DEALER}'",
                      "amount_notnull": "amount IS NOT NULL",
                      "amount_pos": "amount > 0"},
    "collections": {"receivable_notnull": "receivable IS NOT NULL"},
}


def dq_report(src, tables: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """All rules over the conformed ``tables`` (name -> function giving it) of one catalog.

    Every table is read once: the contract of the two order tables
    (``all_orders``) is reported from the order lines' own pass.
    """
    missing = missing_columns(src)
    parts = []
    for name, data_rules in DATA_RULES.items():
        if missing[name]:
            parts.append(src.table(next(iter(SOURCE_COLUMNS[name]))).sparkSession.range(1).selectExpr(
                f"'{name}' AS table_name", "'columns' AS rule", f"CAST({missing[name]} AS BIGINT) AS violations",
                "CAST(NULL AS BIGINT) AS total", "false AS passed"))
            continue
        df = tables[name]()
        schema_rules = {"columns": len(set(REQUIRED_COLUMNS[name]) - set(df.columns))}
        if name == "orders":
            schema_rules["date_type"] = undated_type(src)
            if not missing["dealer_orders"]:
                shared = set(df.columns) & set(tables["dealer_orders"]().columns)
                schema_rules["all_orders.contract"] = len(set(MERGE_CONTRACT) - shared)
        parts.append(_rules_for(name, df, data_rules, schema_rules))
    return reduce(DataFrame.unionByName, parts)

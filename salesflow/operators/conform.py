"""Conform the operational sources into the engine's public tables.

``products``, ``customers``, ``orders_fact``, ``inventory``, ``dealer_orders``
and ``collections`` each read from a catalog (anything with ``.table(name)``)
and return a lazy DataFrame. Money stays decimal with two places through the
arithmetic and is exposed as double, the way the business reports read it.
``all_orders`` unions the shop and dealer channels by column name.

Every function is a pure DataFrame → DataFrame plan; Catalyst prunes the
columns each metric does not use down to the scans.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow.functions.columns import (
    MONEY, cn_date_sql, month_of, na_to_null_sql, percent1, try_number_sql,
)
from salesflow.operators.quantile import exact_quantile
from salesflow.sources.catalog import DEALER_SHEET_RENAME

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
UNCATEGORISED = "未分类"          # category of a product without one
FALLBACK_COST_RATE = Decimal("0.4")  # cost = price * 0.4 when no purchase price is known
SAFETY_STOCK = 50
ACTIVE = "active"
COMPLETED = "completed"
CHANNEL_ALL = "全部"      # no channel filter
CHANNEL_ERP = "金蝶"      # accepted as a filter value, never assigned to a row
CHANNEL_SHOP = "电商"     # online shop orders
CHANNEL_DEALER = "经销商"  # dealer orders from the hand-kept sheet
CHANNELS = (CHANNEL_ALL, CHANNEL_ERP, CHANNEL_SHOP, CHANNEL_DEALER)
DEALER_PRICE_QUANTILE = 0.99



def money_out(c):
    return c.cast("double")


# ---------------------------------------------------------------------------
# Products
# ---------------------------------------------------------------------------

def products(src) -> DataFrame:
    """One row per (product, category name): price, cost, stock and margin.

    Cost is the lowest purchase price seen in inventory, else 40 % of the
    price. Inventory is reduced to one row per product *before* the join so
    the join cannot fan out; duplicate (product, category) pairs collapse in
    the final group, as a GROUP BY over the joined rows would.
    """
    p = src.table("products").select("product_id", "name", "price", "status", "quantity")
    pcr = src.table("product_category_relationship").select("product_id", "category_id")
    pc = src.table("product_categories").select("category_id", F.col("name").alias("category_name"))
    lowest = (src.table("inventory").groupBy("product_id")
              .agg(F.min("purchase_price").alias("lowest_purchase")))

    joined = (p.join(pcr, "product_id", "left")
               .join(lowest, "product_id", "left")
               .join(pc, "category_id", "left"))
    keys = ["product_id", "name", "category_name", "price", "status", "quantity"]
    grouped = joined.groupBy(*keys).agg(F.min("lowest_purchase").alias("lowest_purchase"))

    unit = F.col("price").try_cast(MONEY)
    cost = F.coalesce(F.col("lowest_purchase"), F.col("price") * F.lit(FALLBACK_COST_RATE)).try_cast(MONEY)
    out = grouped.select(
        "product_id",
        F.col("name").alias("product_name"),
        F.coalesce(F.col("category_name"), F.lit(UNCATEGORISED)).alias("category"),
        money_out(unit).alias("unit_price"),
        money_out(cost).alias("cost_price"),
        "status",
        F.col("quantity").alias("stock"),
    )
    u, c = F.col("unit_price"), F.col("cost_price")
    return out.withColumn("gross_margin_pct", percent1(u - c, u))


# ---------------------------------------------------------------------------
# Customers
# ---------------------------------------------------------------------------

def customers(src) -> DataFrame:
    """Active customers; the status filter reaches the scan."""
    u = src.table("users")
    return (u.filter(F.col("status") == ACTIVE)
             .select(F.col("user_id").alias("customer_id"), F.col("username").alias("customer_name")))


# ---------------------------------------------------------------------------
# Shop order lines
# ---------------------------------------------------------------------------

def orders_fact(src) -> DataFrame:
    """Order lines of the shop joined to order header, buyer and product.

    Lines of unknown orders, buyers or products drop out (inner joins). Lines
    meet their orders first: where both tables are bucketed by order id that
    join, the largest, moves no rows (``sources.bucketed``). The product and
    user dimensions follow; Spark broadcasts them when their size is under the
    broadcast threshold and shuffles otherwise, and AQE splits a skewed key.
    """
    oi = src.table("order_items").select("order_item_id", "order_id", "product_id", "quantity")
    o = src.table("orders").select("order_id", "user_id", F.col("created_at").alias("order_date"),
                                   "status")
    u = src.table("users").select("user_id", F.col("username").alias("customer_name"))
    p = src.table("products").select("product_id", F.col("name").alias("product_name"), "price")

    j = oi.join(o, "order_id").join(p, "product_id").join(u, "user_id")
    order_date = F.col("order_date").cast("timestamp_ntz")
    return j.select(
        "order_item_id", "order_id",
        order_date.alias("order_date"),
        "customer_name", "product_name", "quantity",
        money_out(F.col("price").try_cast(MONEY)).alias("unit_price"),
        money_out((F.col("quantity") * F.col("price")).try_cast(MONEY)).alias("amount"),
        "status",
        month_of(order_date).alias("order_month"),
    )


# ---------------------------------------------------------------------------
# Inventory
# ---------------------------------------------------------------------------

def inventory(src) -> DataFrame:
    """Stock batches of catalogue products; negative stock is read as 0.

    ``expiry_status`` is passed on where the source has it (the digest counts it).
    """
    stock = src.table("inventory")
    optional = [c for c in ("expiry_status",) if c in stock.columns]
    i = stock.select("inventory_id", "product_id", "quantity", "purchase_price",
                     "supplier_info", "created_at", *optional)
    p = src.table("products").select("product_id", F.col("name").alias("product_name"))
    q = F.col("quantity")
    price = F.col("purchase_price").try_cast(MONEY)
    return i.join(p, "product_id").select(
        "inventory_id", "product_id", "product_name",
        # not greatest(q, 0): a missing stock figure must stay missing
        F.when(q < 0, F.lit(0)).otherwise(q).alias("current_stock"),
        F.lit(SAFETY_STOCK).alias("safety_stock"),
        money_out(price).alias("purchase_price"),
        "supplier_info",
        F.col("created_at").cast("timestamp_ntz").alias("check_date"),
        *optional,
    )


# ---------------------------------------------------------------------------
# Dealer sheet
# ---------------------------------------------------------------------------

def _dealer_cells(src) -> DataFrame:
    """Every row of the sheet with its cells as text, missing-value tokens as NULL."""
    raw = src.table("dealer_sheet")
    renamed = raw.withColumnsRenamed({k: v for k, v in DEALER_SHEET_RENAME.items() if k in raw.columns})
    return renamed.selectExpr(*[f"{na_to_null_sql(f'CAST(`{c}` AS STRING)')} AS {c}"
                                for c in DEALER_SHEET_RENAME.values()])


_DEALER_TYPED = [
    "order_id",
    f"{cn_date_sql('date_str')} AS order_date",
    "customer_name", "product_name",
    f"{try_number_sql('quantity')} AS quantity",
    f"{try_number_sql('unit_price')} AS unit_price",
    f"{try_number_sql('amount')} AS amount",
]
# What a row needs, in the order in which it is looked for; the reason of a rejected row is the first it lacks.
DEALER_NEEDS = ("order_date", "amount", "unit_price", "quantity", "customer_name")
REJECT_PRICE = "price_above_cap"


def dealer_typed(src) -> DataFrame:
    """Every dealer row with typed cells (NULL where a cell does not parse).

    Missing-value tokens are mapped in one projection and typed in the next,
    so each cell is cleaned once per row.
    """
    return _dealer_cells(src).selectExpr(*_DEALER_TYPED)


def dealer_classified(src, q: float = DEALER_PRICE_QUANTILE) -> DataFrame:
    """Every row of the sheet, typed, with its cells as ``cells`` and the ``reason`` it is rejected for.

    ``reason`` is NULL for an accepted row, else ``no_<column>`` of the first
    thing it lacks, or that its price is above the cap.
    """
    cap = exact_quantile(dealer_clean(src), "unit_price", q).select("value").scalar()
    typed = _dealer_cells(src).selectExpr(
        *_DEALER_TYPED, f"struct({', '.join(DEALER_SHEET_RENAME.values())}) AS cells")
    reason = F.when(F.col("unit_price") > cap, F.lit(REJECT_PRICE))
    for need in reversed(DEALER_NEEDS):
        reason = F.when(F.col(need).isNull(), F.lit(f"no_{need}")).otherwise(reason)
    return typed.withColumn("reason", reason)


def dealer_rejects(src, q: float = DEALER_PRICE_QUANTILE) -> DataFrame:
    """The rows of the sheet that ``dealer_orders`` leaves out: their cells as written, and the reason."""
    return dealer_classified(src, q).filter(F.col("reason").isNotNull()).select("cells.*", "reason")


def dealer_clean(src) -> DataFrame:
    """Dealer rows with a date and all of amount, price, quantity and customer."""
    return dealer_typed(src).dropna(subset=list(DEALER_NEEDS))


def dealer_price_cap(src, q: float = DEALER_PRICE_QUANTILE) -> DataFrame:
    """One row: the unit-price cap (q-quantile, linear interpolation)."""
    return exact_quantile(dealer_clean(src), "unit_price", q).select(F.col("value").alias("cap"))


def dealer_orders(src, q: float = DEALER_PRICE_QUANTILE) -> DataFrame:
    """Dealer orders: parsed dates and numbers, price outliers above the cap removed."""
    clean = dealer_clean(src)
    cap = exact_quantile(clean, "unit_price", q).select("value").scalar()
    kept = clean.filter(F.col("unit_price") <= cap)
    return kept.select(
        "order_id", "order_date",
        month_of(F.col("order_date")).alias("order_month"),
        "customer_name", "product_name", "quantity", "unit_price", "amount",
        F.lit(CHANNEL_DEALER).alias("channel"),
        F.lit(COMPLETED).alias("status"),
    )


# ---------------------------------------------------------------------------
# Collections
# ---------------------------------------------------------------------------

def collections(src) -> DataFrame:
    """Payments with buyer; collected/outstanding split on payment status.

    Payments whose order was deleted keep a NULL customer (left joins). A
    missing collected figure counts as 0; outstanding = receivable - collected.
    """
    pay = src.table("payments").select("payment_id", "order_id", "amount", "status", "payment_time")
    o = src.table("orders").select("order_id", "user_id")
    u = src.table("users").select("user_id", F.col("username").alias("customer_name"))
    # Payments meet their orders first (no exchange where both are bucketed by order id). Those without an
    # order, or without a buyer, would all share the key NULL in the next join; the second key spreads them.
    spread = F.when(F.col("user_id").isNull(), F.xxhash64("payment_id", "order_id")).otherwise(F.lit(0))
    j = (pay.join(o, "order_id", "left").withColumn("_spread", spread)
         .join(u.withColumn("_spread", F.lit(0).cast("bigint")), ["user_id", "_spread"], "left"))

    done = F.col("status") == COMPLETED
    receivable = F.col("amount").try_cast(MONEY)
    collected = F.coalesce(F.when(done, F.col("amount")).otherwise(F.lit(0)).try_cast(MONEY),
                           F.lit(0).cast(MONEY))
    return j.select(
        "payment_id", "order_id", "customer_name",
        money_out(receivable).alias("receivable"),
        money_out(collected).alias("collected"),
        money_out(receivable - collected).alias("outstanding"),
        "status",
        F.col("payment_time").cast("timestamp_ntz").alias("last_payment_date"),
    )


# ---------------------------------------------------------------------------
# All orders
# ---------------------------------------------------------------------------

def all_orders(src, channel: str = CHANNEL_ALL, shop: DataFrame | None = None,
               dealer: DataFrame | None = None) -> DataFrame:
    """Shop and dealer lines in one table, optionally narrowed to one channel.

    ``channel`` is a literal per branch: a branch the filter excludes is not
    built at all. The ERP channel is accepted but no row carries it, so its
    result is empty.
    """
    if channel not in CHANNELS:
        raise ValueError(f"channel must be one of {CHANNELS}, got {channel!r}")
    parts = []
    if channel in (CHANNEL_ALL, CHANNEL_SHOP, CHANNEL_ERP):
        parts.append(_shop_rows(orders_fact(src) if shop is None else shop))
    if channel in (CHANNEL_ALL, CHANNEL_DEALER, CHANNEL_ERP):
        parts.append(_dealer_rows(dealer_orders(src) if dealer is None else dealer))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if channel != CHANNEL_ALL:
        out = out.filter(F.col("channel") == channel)
    return out


def _shop_rows(shop: DataFrame) -> DataFrame:
    return shop.select(
        F.col("order_item_id").cast("bigint").alias("order_item_id"),
        F.col("order_id").cast("string").alias("order_id"),
        "order_date", "customer_name", "product_name",
        F.col("quantity").cast("double").alias("quantity"),
        "unit_price", "amount", "status", "order_month",
        F.lit(CHANNEL_SHOP).alias("channel"),
    )


def _dealer_rows(dealer: DataFrame) -> DataFrame:
    return dealer.select(
        F.lit(None).cast("bigint").alias("order_item_id"),
        F.col("order_id").cast("string").alias("order_id"),
        "order_date", "customer_name", "product_name",
        F.col("quantity").cast("double").alias("quantity"),
        F.col("unit_price").cast("double").alias("unit_price"),
        F.col("amount").cast("double").alias("amount"),
        "status", "order_month", "channel",
    )

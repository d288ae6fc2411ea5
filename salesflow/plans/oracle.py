"""Reference SQL for every registered query, for an independent engine (DuckDB).

Each query is one self-contained statement over the test tables (``part``,
``customer``, ``orders``, ``lineitem``, ``supplier``, ``events``). The
source shapes and the conform rules are restated here in plain SQL, joins
written the direct way (no pre-aggregation), so a Spark plan that
re-arranges the work is checked against the straightforward definition.

Rounding half-to-even is ``round_even``; money sums run over
wide decimals; divisions use ``nullif`` so a zero divisor gives NULL.
"""

from __future__ import annotations

# The cell texts that pandas reads as missing by default.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]
_NA_LIST = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)
_NUMBER_RE = r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*"
_DATE_FORMATS = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M", "%Y-%m", "%Y%m%d",
                 "%m-%d-%Y", "%m-%d-%Y %H:%M:%S", "%m-%d-%Y %H:%M", "%Y.%m.%d"]


def _name(table_alias: str, mode: str) -> str:
    if mode == "raw":
        return f"{table_alias}.p_name"
    return f"{table_alias}.p_name || ' #' || cast({table_alias}.p_partkey as varchar)"


def _na(c: str) -> str:
    return f"case when {c} in ({_NA_LIST}) then null else {c} end"


def _num(c: str) -> str:
    return f"case when regexp_full_match({c}, '{_NUMBER_RE}') then try_cast(trim({c}) as double) end"


def _date(c: str) -> str:
    s = (f"regexp_replace(replace(regexp_replace(replace(replace(replace({c}, '年', '-'), '月', '-'), '日', ''), "
         f"'^[\\s\u3000\u00a0]+|[\\s\u3000\u00a0]+$', '', 'g'), '/', '-'), '([0-9])T([0-9])', '\\1 \\2')")
    tries = ", ".join(f"try_strptime({s}, '{f}')" for f in _DATE_FORMATS)
    return f"case when {s} <> '' then cast(coalesce({tries}) as timestamp) end"


def _r0(x: str) -> str:
    return f"round_even(cast({x} as double), 0)"


def _r1(x: str) -> str:
    return f"round_even(cast({x} as double) * 10, 0) / 10"


def _msum(x: str) -> str:
    return f"coalesce(cast(sum(cast({x} as decimal(38,6))) as double), 0)"


def _k(x: str) -> str:
    """Whole number with thousands separators."""
    return f"format('{{:,.0f}}', cast({x} as double))"


def _pct(num: str, den: str) -> str:
    return _r1(f"(cast({num} as double) / nullif(cast({den} as double), 0)) * 100")


def ctes(names: str = "unique") -> str:
    """Source adapters + conformed tables as a WITH list (no leading WITH)."""
    pname = _name("p", names)
    return f"""
src_products AS (
  select p.p_partkey product_id, {pname} name, cast(p.p_retailprice as decimal(10,2)) price,
         case when p.p_size > 45 then 'off' else 'on' end status, p.p_size quantity
  from part p),
src_product_categories AS (
  select distinct p_type category_id, p_type name from part
  union all select distinct p_brand, p_brand from part),
src_pcr AS (
  select p_partkey product_id, p_type category_id from part where p_partkey % 10 <> 0
  union all select p_partkey, p_brand from part where p_partkey % 7 = 0),
src_inventory AS (
  select l_orderkey*10 + l_linenumber inventory_id, l_partkey product_id, cast(l_quantity as int) - 10 quantity,
         case when l_suppkey % 20 = 0 or l_partkey % 11 = 0 then null
              else cast(cast(p_retailprice as decimal(10,2)) * cast(0.3 + l_discount as decimal(3,2)) as decimal(14,4)) end purchase_price,
         s_name supplier_info, l_shipdate created_at
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey),
src_users AS (
  select c_custkey user_id, c_name username,
         case when c_mktsegment = 'MACHINERY' then 'inactive' else 'active' end status
  from customer),
src_shop_orders AS (
  select o_orderkey order_id, o_custkey user_id, o_orderdate created_at,
         case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'cancelled' end status
  from orders),
src_order_items AS (
  select l_orderkey*10 + l_linenumber order_item_id, l_orderkey order_id, l_partkey product_id,
         cast(l_quantity as int) quantity
  from lineitem),
src_payments AS (
  select o_orderkey payment_id, case when o_orderkey % 50 = 0 then -1 - o_orderkey else o_orderkey end order_id,
         case when o_orderkey % 97 = 0 then null else cast(o_totalprice as decimal(12,2)) end amount,
         case when o_orderkey % 31 = 0 then null when o_orderstatus = 'F' then 'completed' else 'pending' end status,
         o_orderdate payment_time
  from orders),
src_dealer AS (
  select 'D' || cast(e.event_id as varchar) order_id,
         case when e.event_id % 23 = 0 then null when e.event_id % 41 = 0 then '待定'
              else cast(year(e.ts) as varchar) || '年' || cast(month(e.ts) as varchar) || '月'
                   || cast(day(e.ts) as varchar) || '日' end date_str,
         case when e.event_id % 29 = 0 then null else 'Dealer' || cast(e.user_id as varchar) end customer_name,
         {pname} product_name,
         cast(1 + e.event_id % 9 as varchar) quantity,
         cast(e.value as varchar) unit_price,
         case when e.event_id % 17 = 0 then '待确认'
              else cast(round((1 + e.event_id % 9) * e.value, 2) as varchar) end amount
  from events e join part p on p.p_partkey = e.user_id),
named AS (
  select distinct r.product_id, k.name category from src_pcr r left join src_product_categories k using (category_id)),
lowest AS (
  select product_id, min(purchase_price) paid from src_inventory group by product_id),
c_products AS (
  select product_id, product_name, category, unit_price, cost_price, status, stock,
         {_pct('unit_price - cost_price', 'unit_price')} gross_margin_pct
  from (
    select s.product_id, s.name product_name, ifnull(named.category, '未分类') category,
           cast(cast(s.price as decimal(28,2)) as double) unit_price,
           cast(cast(case when lowest.paid is null then s.price * 0.4 else lowest.paid end as decimal(28,2)) as double)
             cost_price,
           s.status, s.quantity stock
    from src_products s left join named using (product_id) left join lowest using (product_id)) margins),
c_customers AS (
  select user_id customer_id, username customer_name from src_users where status = 'active'),
headers AS (
  select order_id, created_at, h.status, username from src_shop_orders h join src_users using (user_id)),
c_orders AS (
  select lines.order_item_id, order_id, cast(created_at as timestamp) order_date, username customer_name,
         goods.name product_name, lines.quantity, cast(cast(goods.price as decimal(28,2)) as double) unit_price,
         cast(cast(lines.quantity * goods.price as decimal(28,2)) as double) amount, headers.status,
         ifnull(strftime(created_at, '%Y-%m'), 'NaT') order_month
  from src_order_items lines join headers using (order_id) join src_products goods using (product_id)),
c_inventory AS (
  select i.inventory_id, i.product_id, p.name product_name,
         case when i.quantity < 0 then 0 else i.quantity end current_stock, 50 safety_stock,
         cast(cast(i.purchase_price as decimal(28,2)) as double) purchase_price,
         i.supplier_info, cast(i.created_at as timestamp) check_date
  from src_inventory i join src_products p on i.product_id = p.product_id),
dealer_cells AS (
  select {_na('order_id')} order_id, {_na('date_str')} date_str, {_na('customer_name')} customer_name,
         {_na('product_name')} product_name, {_na('quantity')} quantity, {_na('unit_price')} unit_price,
         {_na('amount')} amount
  from src_dealer),
dealer_dated AS (
  select *, {_date('date_str')} order_date from dealer_cells),
dealer_clean AS (
  select order_id, order_date, customer_name, product_name, quantity, unit_price, amount from (
    select order_id, order_date, customer_name, product_name,
           {_num('quantity')} quantity, {_num('unit_price')} unit_price, {_num('amount')} amount
    from dealer_dated where order_date is not null) t
  where amount is not null and unit_price is not null and quantity is not null and customer_name is not null),
dealer_ranked AS (
  select unit_price v, row_number() over (order by unit_price) - 1 rk from dealer_clean),
dealer_n AS (
  select count(*) n, cast(count(*) - 1 as double) * cast(0.99 as double) pos from dealer_clean),
dealer_cap AS (
  select case when t >= 0.5 then hi - (hi - lo) * (1 - t) else lo + (hi - lo) * t end cap from (
    select (select v from dealer_ranked where rk = floor(pos)) lo,
           (select v from dealer_ranked where rk = least(floor(pos) + 1, n - 1)) hi,
           pos - floor(pos) t
    from dealer_n) q),
c_dealer AS (
  select order_id, order_date, coalesce(strftime(order_date, '%Y-%m'), 'NaT') order_month, customer_name,
         product_name, quantity, unit_price, amount, '经销商' channel, 'completed' status
  from dealer_clean where unit_price <= (select cap from dealer_cap)),
buyers AS (
  select order_id, username from src_shop_orders left join src_users using (user_id)),
amounts AS (
  select *, cast(amount as decimal(28,2)) due,
         case when status = 'completed' and amount is not null then cast(amount as decimal(28,2)) else 0 end paid
  from src_payments),
c_collections AS (
  select payment_id, amounts.order_id, username customer_name, cast(due as double) receivable, cast(paid as double) collected,
         cast(due - paid as double) outstanding, status, cast(payment_time as timestamp) last_payment_date
  from amounts left join buyers using (order_id)),
c_all_orders AS (
  select order_item_id, cast(order_id as varchar) order_id, order_date, customer_name, product_name,
         cast(quantity as double) quantity, unit_price, amount, status, order_month, '电商' channel
  from c_orders
  union all
  select cast(null as bigint), order_id, order_date, customer_name, product_name, quantity, unit_price, amount,
         status, order_month, channel
  from c_dealer),
m_monthly AS (
  select order_month, count(order_id) order_lines,
         {_r0(_msum('amount'))} sales,
         {_r0('cast(sum(cast(amount as decimal(38,6))) as double) / nullif(count(amount), 0)')} avg_amount
  from c_all_orders where order_month is not null group by order_month),
m_top_products AS (
  select product_name, {_r0('coalesce(sum(quantity), 0)')} quantity, {_r0(_msum('amount'))} sales
  from c_all_orders where product_name is not null group by product_name
  order by coalesce(sum(quantity), 0) desc, product_name limit 10),
m_ranked_products AS (
  select product_name, {_r0('coalesce(sum(quantity), 0)')} quantity, {_r0(_msum('amount'))} sales,
         row_number() over (order by coalesce(sum(quantity), 0) desc, product_name) rk
  from c_all_orders where product_name is not null group by product_name),
m_customer_value AS (
  select customer_name, count(order_id) order_lines, {_r0(_msum('amount'))} spend
  from c_all_orders where customer_name is not null group by customer_name
  order by count(order_id) desc, customer_name limit 15),
m_receivable_totals AS (
  select receivable, collected, outstanding,
         case when receivable > 0 then {_pct('collected', 'receivable')} end recovery_pct
  from (select {_msum('receivable')} receivable, {_msum('collected')} collected, {_msum('outstanding')} outstanding
        from c_collections) t),
m_debt AS (
  select customer_name, outstanding, receivable, collected, {_pct('collected', 'receivable')} recovery_pct
  from (select customer_name, {_msum('outstanding')} outstanding, {_msum('receivable')} receivable,
               {_msum('collected')} collected
        from c_collections where customer_name is not null group by customer_name) t
  where (select {_msum('receivable')} from c_collections) > 0),
m_debt_top AS (
  select * from m_debt where outstanding > 0 order by outstanding desc, customer_name limit 10)
"""


def _q(body: str, names: str = "unique") -> str:
    return "WITH " + ctes(names).strip() + "\n" + body.strip()


INVENTORY_VALUE = """
select inventory_id, product_name, current_stock, purchase_price,
       cast(current_stock * cast(purchase_price as decimal(28,2)) as double) stock_value
from c_inventory"""

CATEGORY_SALES = f"""
select p.category, count(o.order_id) order_lines, {_r0(_msum('o.amount'))} sales
from c_all_orders o join c_products p on o.product_name is not distinct from p.product_name
where p.category is not null group by p.category"""


def _dq_rows(table: str, cte: str, schema_rules: list[str], data_rules: list[str]) -> str:
    parts = [f"select '{table}' table_name, 'nonempty' rule, "
             f"cast(case when total = 0 then 1 else 0 end as bigint) violations, total, total > 0 passed from {cte}"]
    parts += [f"select '{table}', '{r}', cast(0 as bigint), total, true from {cte}" for r in schema_rules]
    parts += [f"select '{table}', '{r}', cast({r} as bigint), total, {r} = 0 from {cte}" for r in data_rules]
    return "\nunion all ".join(parts)


def _fails(cond: str) -> str:
    return f"count_if(not coalesce({cond}, false))"


DQ_REPORT = f"""
, dq_products AS (select count(*) total, {_fails('gross_margin_pct >= 0')} margin_nonneg from c_products),
dq_customers AS (select count(*) total, {_fails('customer_name is not null')} name_notnull from c_customers),
dq_orders AS (select count(*) total, {_fails('amount >= 0')} amount_nonneg from c_orders),
dq_inventory AS (select count(*) total, {_fails('current_stock >= 0')} stock_nonneg from c_inventory),
dq_dealer AS (select count(*) total, {_fails("channel = '经销商'")} channel_const,
                     {_fails('amount is not null')} amount_notnull, {_fails('amount > 0')} amount_pos from c_dealer),
dq_collections AS (select count(*) total, {_fails('receivable is not null')} receivable_notnull from c_collections)
{_dq_rows('products', 'dq_products', ['columns'], ['margin_nonneg'])}
union all {_dq_rows('customers', 'dq_customers', ['columns'], ['name_notnull'])}
union all {_dq_rows('orders', 'dq_orders', ['columns', 'date_type'], ['amount_nonneg'])}
union all {_dq_rows('inventory', 'dq_inventory', ['columns'], ['stock_nonneg'])}
union all {_dq_rows('dealer_orders', 'dq_dealer', ['columns'], ['channel_const', 'amount_notnull', 'amount_pos'])}
union all {_dq_rows('collections', 'dq_collections', ['columns'], ['receivable_notnull'])}
union all select 'all_orders', 'contract', cast(0 as bigint), total, true from dq_orders"""


# Prices that differ in their last digits beside far outliers, from the events.
CROWDED_PRICES = """select case when event_id % 5000 = 7 then 1e15 when event_id % 5000 = 11 then -1e300
  else 1000 + event_id * 1e-9 end v from events"""


def oracle_sql(snapshot_month: str = "202608") -> dict[str, str]:
    def snap(cte: str) -> str:
        return _q(f"select *, '{snapshot_month}' report_month from {cte}")

    return {
        "dq_report": "WITH " + ctes().strip() + DQ_REPORT,
        "snapshot_products": snap("c_products"),
        "snapshot_orders": snap("c_all_orders"),
        "snapshot_inventory": _q(f"select *, cast(current_stock * cast(purchase_price as decimal(28,2)) as double) "
                                 f"stock_value, '{snapshot_month}' report_month from c_inventory"),
        "snapshot_append_twice": _q(f"select *, '{snapshot_month}' report_month from c_collections "
                                    f"union all select *, '{snapshot_month}' from c_collections"),
        "snapshot_collections": snap("c_collections"),
        "snapshot_replace_after_append": _q(f"select c_collections.*, m report_month from c_collections "
                                            f"cross join (values ('202607'), ('{snapshot_month}')) v(m)"),
        "snapshot_latest": _q(f"""
select m report_month, status, count(*) payments, {_msum('receivable')} receivable from c_collections
cross join (values ('202606'), ('202607'), ('{snapshot_month}')) v(m) group by m, status"""),
        "snapshot_drifting_types": _q(f"""
select payment_id, order_id, customer_name, receivable, collected, outstanding,
       case when m <> '202607' then status end status, last_payment_date, m report_month
from c_collections cross join (values ('202607'), ('{snapshot_month}')) v(m)"""),
        "snapshot_date_range": _q(f"""
select *, '{snapshot_month}' report_month from c_all_orders
where order_date >= timestamp '1996-04-01' and order_date < timestamp '1996-07-01'"""),
        "products": _q("select * from c_products"),
        "customers": _q("select * from c_customers"),
        "orders_fact": _q("select * from c_orders"),
        "inventory": _q("select * from c_inventory"),
        "dealer_price_cap": _q("select cap from dealer_cap"),
        "price_cap_crowded": f"with crowded as ({CROWDED_PRICES})," + """
ranked as (select v, row_number() over (order by v) - 1 rk from crowded),
place as (select count(*) n, cast(count(*) - 1 as double) * cast(0.99 as double) pos from crowded)
select n, lo lo_value, hi hi_value, case when t = 0 then lo when t >= 0.5 then hi - (hi - lo) * (1 - t) else lo + (hi - lo) * t end as value
from (select n, pos - floor(pos) t, (select v from ranked where rk = floor(pos)) lo,
             (select v from ranked where rk = least(floor(pos) + 1, n - 1)) hi from place) p""",
        "dealer_orders": _q("select * from c_dealer"),
        "dealer_rejects": _q(f"""
select order_id, date_str, customer_name, product_name, quantity, unit_price, amount, reason from (
  select *, case when order_date is null then 'no_order_date' when {_num('amount')} is null then 'no_amount'
                 when {_num('unit_price')} is null then 'no_unit_price' when {_num('quantity')} is null then 'no_quantity'
                 when customer_name is null then 'no_customer_name'
                 when {_num('unit_price')} > (select cap from dealer_cap) then 'price_above_cap' end reason
  from dealer_dated) r where reason is not null"""),
        "orders_fact_bucketed": _q("select * from c_orders"),
        "collections_bucketed": _q("select * from c_collections"),
        "sales_incremental": _q("\nunion all ".join(f"""
select '{level}' as level, {key} as key, count(order_id) order_lines, {_r0(_msum('amount'))} sales,
       {_r0('coalesce(sum(quantity), 0)')} quantity from c_all_orders where {key} is not null group by {key}"""
            for level, key in (("month", "order_month"), ("product", "product_name"), ("customer", "customer_name"),
                               ("status", "status")))),
        "category_sales_incremental": _q(CATEGORY_SALES),
        "monthly_trend_incremental": _q("select * from m_monthly"),
        "collections": _q("select * from c_collections"),
        "all_orders": _q("select * from c_all_orders"),
        "channel_filter": _q("select * from c_all_orders where channel = '经销商'"),
        "channel_shop": _q("select * from c_all_orders where channel = '电商'"),
        "channel_unassigned": _q("select * from c_all_orders where channel = '金蝶'"),
        "monthly_trend": _q("select * from m_monthly"),
        "month_over_month": _q(f"""
select order_month, sales, mom_pct,
       case when mom_pct < 0 then 'down' else 'up' end direction,
       case when mom_pct is null then '' else printf('%+.1f%%', mom_pct) end label
from (select order_month, sales,
             {_r1('(sales / nullif(lag(sales) over (order by order_month), 0) - 1) * 100')} mom_pct
      from m_monthly) t"""),
        "best_month": _q("select order_month, order_lines, sales from m_monthly "
                         "order by sales desc, order_month asc limit 1"),
        "latest_month": _q("select order_month, order_lines, sales from m_monthly "
                           "order by order_month desc limit 1"),
        "top_products": _q("select * from m_top_products"),
        "category_sales": _q(CATEGORY_SALES),
        "category_sales_dupnames": _q(CATEGORY_SALES, names="raw"),
        "customer_value": _q("select * from m_customer_value"),
        "customer_value_series": _q("""
select customer_name, order_lines, spend, order_lines * 40 bubble_size,
       row_number() over (order by order_lines desc, customer_name) <= 8 labelled
from m_customer_value"""),
        "order_status": _q(f"""
select status, order_lines,
       {_r1('100.0::double * (cast(order_lines as double) / cast(sum(order_lines) over () as double))')} share_pct
from (select status, count(*) order_lines from c_all_orders where status is not null group by status) t"""),
        "inventory_value": _q(INVENTORY_VALUE),
        "inventory_top10": _q(f"select * from ({INVENTORY_VALUE}) v "
                              "order by stock_value desc nulls last, inventory_id, product_name, current_stock, purchase_price limit 10"),
        "low_stock": _q("select inventory_id, product_id, product_name, current_stock, safety_stock "
                        "from c_inventory where current_stock < safety_stock"),
        "receivables_by_customer": _q("select * from m_debt"),
        "debt_top": _q("select * from m_debt_top"),
        "receivable_totals": _q("select * from m_receivable_totals"),
        "report_headline": _q(f"""
select *, '总销售额: ' || {_k('total_sales')} || ' 元 | 总订单: ' || {_k('order_lines')} || ' 条 | 产品: '
          || cast(products as varchar) || ' 种 | 客户: ' || cast(customers as varchar) || ' 个' line
from (select {_r0(_msum('amount'))} total_sales, count(*) order_lines,
             (select count(*) from c_products) products, (select count(*) from c_customers) customers
      from c_all_orders) h"""),
        "load_counts": _q("""
select 'products' table_name, count(*) row_count from c_products
union all select 'customers', count(*) from c_customers
union all select 'shop_orders', count(*) from c_orders
union all select 'dealer_orders', count(*) from c_dealer
union all select 'all_orders', count(*) from c_all_orders
union all select 'inventory', count(*) from c_inventory
union all select 'collections', count(*) from c_collections"""),
        "digest": _q(f"""
select 'latest_month' section, 1 rank, order_month label, cast(order_lines as double) value1, sales value2,
       cast(null as double) value3,
       '本月订单: ' || cast(order_lines as varchar) || ' 单 | 销售额: ' || {_k('sales')} || ' 元' line
from (select * from m_monthly order by order_month desc limit 1) a
union all
select 'best_month', 1, order_month, cast(order_lines as double), sales, null,
       '年度最高: ' || order_month || ' | ' || {_k('sales')} || ' 元'
from (select * from m_monthly order by sales desc, order_month asc limit 1) b
union all
select 'top_product', rk, product_name, quantity, sales, null,
       '  ' || cast(rk as varchar) || '. ' || product_name || ' — ' || cast(cast(quantity as bigint) as varchar)
       || ' 件 / ' || {_k('sales')} || ' 元'
from m_ranked_products where rk <= 5
union all
select 'recovery', 1, null, recovery_pct, collected, receivable - collected,
       '回款率: ' || format('{{:.1f}}', recovery_pct) || '% | 已回: ' || {_k('collected')} || ' | 未回: '
       || {_k('receivable - collected')}
from m_receivable_totals where receivable > 0
union all
select 'debtor', rk, customer_name, outstanding, null, null,
       '  ' || customer_name || ' — 未回款 ' || {_k('outstanding')} || ' 元'
from (select *, row_number() over (order by outstanding desc, customer_name) rk
      from (select * from m_debt_top order by outstanding desc, customer_name limit 3) d0) d"""),
    }

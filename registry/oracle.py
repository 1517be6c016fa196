"""SQL counterparts of the registered queries, run by DuckDB on the driver tables.

``CTES`` holds named steps; ``build`` collects those a query needs. They are
written from the definitions, not from the DataFrame plans.
"""

from __future__ import annotations

import re

from shelfledger.config import (DROPPED_EXPENSES, FUEL_EXPENSE, MAINTENANCE_EXPENSES, NAME_CLEANING,
                                NON_DIRECT_EXPENSES, RENT_EXPENSE, SUPERMARKET_B2B, SUPERMARKET_B2C,
                                UTILITY_EXPENSES)
from shelfledger.plans import rules, views

from .driver_tables import CFG, EXPENSE_NAMES, POSITIONS, SUBDIV_NAMES

S3, S12, FIN = "TIMESTAMP '2001-01-01'", "TIMESTAMP '2000-04-01'", "TIMESTAMP '2001-04-01'"
MOTION = "TIMESTAMP '1995-04-01'"


def br(x: str, n: int = 0) -> str:
    """Halves to even; what is a half but for the last bits of a sum is one."""
    return (f"(list_transform([CAST(({x}) AS DOUBLE) * 1e{n}], lambda s: CASE WHEN abs(s - floor(s) - 0.5) <= 1e-12 * greatest(abs(s), 1) "
            f"THEN floor(s) + abs(floor(s) % 2) ELSE round(s) END)[1] / 1e{n} + 0)")


def code(x: str) -> str:
    return f"printf('%09d', {x})"


def ym(x: str) -> str:
    return f"(year({x}) * 12 + month({x}))"


def rsum(x: str) -> str:
    return f"CASE WHEN count({x}) < count(*) THEN NULL ELSE sum({x}) END"


def strict(fn: str, x: str) -> str:
    return f"CASE WHEN count({x}) = count(*) THEN {fn}({x}) END"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif(({b}), 0))"


def remap(x: str, m: dict) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{a}' THEN '{b}'" for a, b in m.items()) + f" ELSE {x} END"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def first_match(x: str) -> str:
    for p, r in NAME_CLEANING:
        x = f"regexp_replace({x}, '{p.replace(chr(39), chr(39) * 2)}', '{r}')"
    return x


def num_text(x: str, n: int = 6) -> str:
    t = f"printf('%.{n}f', {x})"
    return t if n == 0 else f"regexp_replace(regexp_replace({t}, '0+$', ''), '\\.$', '')"


CTES: dict[str, str] = {}
C = CTES

# ---- logical tables -------------------------------------------------------------------------------
C["subdiv"] = f"""SELECT n_nationkey AS ref, {code('n_nationkey')} AS subdiv_id, n_name AS subdiv_name,
  n_regionkey AS parent_ref, store_ref, n_nationkey = 24 AS marked
  FROM nation LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS store_ref FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey"""
C["store"] = f"""SELECT s_suppkey AS ref, {code('s_suppkey')} AS store_id, s_name AS store_name, 'loc ' || s_nationkey AS store_location,
  s_nationkey AS subdiv_ref, {code('s_nationkey')} AS subdiv_id, s_suppkey % 5 AS distribution_ref,
  CASE WHEN s_suppkey % 11 <> 0 THEN s_suppkey % 7 END AS parent_ref, s_suppkey % 13 = 12 AS marked FROM supplier"""
C["item"] = f"""SELECT p_partkey AS ref, {code('p_partkey')} AS item_id, p_name AS item_name, p_size AS pack_qty, p_size % 10 AS pg,
  p_brand || '/' || p_type AS group_id, nullif(p_partkey // 10, 0) AS parent_ref, p_size, p_retailprice,
  CASE WHEN p_brand <> 'Brand#13' THEN p_type END AS category_id FROM part"""
C["address"] = f"""SELECT s_suppkey AS ref, {code('s_suppkey')} AS deliv_address_id, s_suppkey % 17 = 16 AS marked, s_suppkey % 6 <> 5 AS is_main,
  s_suppkey AS owner_ref, {code('s_nationkey')} AS locality_id, {code('s_nationkey % 5')} AS region_id,
  45.0 + s_suppkey % 10 AS lat, 22.0 + s_suppkey % 15 AS long FROM supplier"""
C["months_all"] = """SELECT CAST(unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS TIMESTAMP) AS date FROM orders"""
C["check_report"] = f"""SELECT -(n_nationkey * 100000 + {ym('date')}) AS ref, (n_nationkey + {ym('date')}) % 29 <> 0 AS posted,
  (n_nationkey * 3 + {ym('date')}) % 37 <> 0 AS is_managerial, date, {code(f"n_nationkey * 100000 + {ym('date')}")} AS nmbr,
  n_nationkey % 3 AS organization_ref, n_nationkey AS subdiv_ref FROM nation, months_all"""
C["lines"] = "SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey"
C["check_line"] = f"""SELECT -(s_nationkey * 100000 + {ym('o_orderdate')}) AS report_ref, l_orderkey AS check_nmbr, o_orderdate AS check_time,
  l_partkey AS item_ref, l_quantity AS qty, l_extendedprice * (1 - l_discount) AS total FROM lines"""
C["cost_register"] = f"""SELECT o_orderdate AS date, s_nationkey AS subdiv_ref,
  CASE WHEN l_linestatus = 'O' THEN -(s_nationkey * 100000 + {ym('o_orderdate')}) WHEN l_returnflag = 'R' THEN l_orderkey * 4 + 1 ELSE l_orderkey * 4 END AS doc_ref,
  l_partkey AS item_ref, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN -1 ELSE 1 END * p_retailprice * l_quantity AS cost,
  CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN -1 ELSE 1 END * p_retailprice * l_quantity * l_tax AS vat
  FROM lines JOIN part ON l_partkey = p_partkey WHERE l_linenumber <> 7"""

# ---- sales ------------------------------------------------------------------------------------------
C["head12"] = f"SELECT * FROM check_report WHERE posted AND is_managerial AND date >= {S12} AND date < {FIN}"
C["head3"] = f"SELECT * FROM check_report WHERE posted AND is_managerial AND date >= {S3} AND date < {FIN}"
C["rep_sums"] = """SELECT h.date, h.nmbr, h.subdiv_ref, h.organization_ref, sum(total) AS checks_report_sum, sum(qty) AS checks_report_qty,
  count(DISTINCT check_nmbr) AS total_checks_qty, count(*) AS checks_report_sku
  FROM head12 h JOIN check_line ON report_ref = h.ref JOIN part ON p_partkey = item_ref WHERE p_partkey <> 7
  GROUP BY ALL HAVING sum(qty) <> 0"""
C["rep_regular"] = f"""SELECT h.date, h.nmbr, sum(o_totalprice) AS doc_reg_cust_sum, count(*) AS doc_reg_cust_nmbr
  FROM head12 h JOIN (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')
  ON -(c_nationkey * 100000 + {ym('o_orderdate')}) = h.ref GROUP BY ALL HAVING sum(o_totalprice) <> 0"""
C["rep_cost"] = f"""SELECT h.date, h.nmbr, sum(cost) + sum(vat) AS doc_cost_sum FROM head12 h JOIN cost_register c ON c.doc_ref = h.ref
  WHERE c.date >= {S12} AND c.date < {FIN} GROUP BY ALL HAVING sum(cost) + sum(vat) <> 0"""
C["sale_report"] = f"""SELECT s.date, s.nmbr AS nmbr_checks_report, {code('subdiv_ref')} AS subdiv_id, {code('organization_ref')} AS organization_id,
  checks_report_sum, checks_report_qty, total_checks_qty, checks_report_sku, doc_reg_cust_sum, doc_reg_cust_nmbr, doc_cost_sum
  FROM rep_sums s LEFT JOIN rep_regular USING (date, nmbr) LEFT JOIN rep_cost USING (date, nmbr)"""
C["subdiv_cat"] = f"""SELECT {code('n_nationkey')} AS subdiv_id, CASE n_nationkey % 4 WHEN 0 THEN '{SUPERMARKET_B2B}' WHEN 1 THEN '{SUPERMARKET_B2C}' ELSE 'Магазини' END AS subdiv_category
  FROM nation WHERE n_nationkey NOT IN (4, 16, 24)"""
C["sale_month"] = f"""SELECT {remap('subdiv_id', CFG.subdiv_merge)} AS subdiv_id, CAST(date_trunc('month', date) AS DATE) AS date, * EXCLUDE (subdiv_id, date)
  FROM sale_report WHERE subdiv_id IN (SELECT subdiv_id FROM subdiv_cat)"""
C["sale_store_month"] = f"""SELECT date, subdiv_id, {rsum('checks_report_sum')} AS revenue, {rsum('doc_cost_sum')} AS cog, sum(coalesce(doc_cost_sum, 0)) AS cog0,
  sum(total_checks_qty) AS month_checks_qty, sum(checks_report_sku) AS month_sku, sum(checks_report_qty) AS month_units,
  coalesce(sum(doc_reg_cust_nmbr), 0) AS month_cards FROM sale_month GROUP BY ALL"""


def _sale_store(cog: str) -> str:
    return f"""SELECT subdiv_id, sum(revenue) AS total_revenue, {br('avg(revenue)')} AS avr_revenue, {rsum(cog)} AS total_cog,
  {br(strict('avg', cog))} AS avr_cog, sum(month_checks_qty) AS total_checks_qty, {br('avg(month_checks_qty)')} AS avr_checks_qty,
  sum(month_sku) AS total_sku_in_checks, sum(month_units) AS total_units_qty, sum(month_cards) AS total_card_owners_checks_qty
  FROM sale_store_month WHERE date >= {S3} GROUP BY 1"""


C["sale_store"] = _sale_store("cog")
C["sale_store0"] = _sale_store("cog0")
BASKET = f"""{br(div('total_revenue', 'total_checks_qty'), 1)} AS avr_check_sum, {br(div('total_sku_in_checks', 'total_checks_qty'), 2)} AS avr_ckecks_sku_qty,
  {br(div('total_units_qty', 'total_checks_qty'), 2)} AS avr_check_units, {br(div('total_revenue', 'total_units_qty'), 2)} AS avr_unit_price"""
C["sale_store_basket"] = f"SELECT *, {BASKET} FROM sale_store"
C["check_cat"] = f"""SELECT {remap(code('subdiv_ref'), CFG.subdiv_merge)} AS subdiv_id, nmbr AS nmbr_checks_report, check_nmbr, category_id,
  sum(total) AS check_category_sum, sum(qty) AS check_category_qty FROM head3 h JOIN check_line ON report_ref = h.ref
  JOIN item i ON i.ref = item_ref WHERE category_id IS NOT NULL GROUP BY ALL"""
C["category_cost"] = f"""SELECT {remap(code('c.subdiv_ref'), CFG.subdiv_merge)} AS subdiv_id, category_id, sum(cost) + sum(vat) AS category_cost_sum
  FROM cost_register c JOIN check_report r ON r.ref = c.doc_ref JOIN item i ON i.ref = c.item_ref
  WHERE category_id IS NOT NULL AND c.date >= {S3} AND c.date < {FIN} GROUP BY ALL"""
C["refund_to"] = f"""SELECT o_orderkey * 4 + 1 AS doc_ref, l_partkey AS item_ref, o_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_linestatus = 'F' AND l_returnflag = 'R' AND o_orderpriority <> '1-URGENT' AND o_orderdate >= {S3} AND o_orderdate < {FIN}"""
C["serv_cost"] = f"""SELECT coalesce(r.o_orderkey, o.o_orderkey) AS k, sum(cost) + sum(vat) AS doc_cost_sum
  FROM cost_register c LEFT JOIN orders o ON o.o_orderkey * 4 = c.doc_ref
  LEFT JOIN refund_to r ON r.doc_ref = c.doc_ref AND r.item_ref = c.item_ref
  WHERE c.date >= {S3} AND c.date < {FIN} AND (o.o_orderkey IS NOT NULL OR r.o_orderkey IS NOT NULL) GROUP BY 1 HAVING sum(cost) + sum(vat) > 0"""
C["serv_sale"] = f"""SELECT o_orderkey AS k, any_value(o_orderdate) AS d, any_value(o_custkey) AS c,
  sum(l_extendedprice * (1 - l_discount)) + sum(l_extendedprice * l_tax) AS doc_sale_sum
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'F' AND l_linenumber <> 7 AND o_orderdate >= {S3} AND o_orderdate < {FIN} GROUP BY 1"""
C["service"] = f"""SELECT {code('k')} AS sale_doc_nmbr, CAST(d AS DATE) AS sale_doc_date, doc_sale_sum, coalesce(doc_cost_sum, 0) AS doc_cost_sum,
  {code('c')} AS customer_id, {code('c % 25')} AS subdiv_id, {code('c % 3')} AS organization_id, {code('c % 5')} AS project_id,
  doc_sale_sum - coalesce(doc_cost_sum, 0) AS gross_profit FROM serv_sale LEFT JOIN serv_cost USING (k)"""
C["sale_plan"] = f"""SELECT o_orderdate AS date_saleplan_doc, {code('n_nationkey')} AS subdiv_id, n_name AS subdiv_name, r_name AS project,
  o_orderpriority AS script_name, o_totalprice AS saleplan_doc_sum FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 25
  LEFT JOIN region ON r_regionkey = o_custkey % 5 WHERE o_orderstatus <> 'P' AND o_orderdate >= {S3} AND o_orderdate < {FIN}"""
C["sale_structure"] = f"""SELECT subdiv_id, category_id, {br(div('n', 'checks'), 3)} AS category_checks_share, {br(div('s', 'total'), 3)} AS category_revenue_share
  FROM (SELECT subdiv_id, category_id, count(*) AS n, sum(check_category_sum) AS s FROM check_cat GROUP BY ALL)
  JOIN (SELECT subdiv_id, sum(check_category_sum) AS total, count(DISTINCT (nmbr_checks_report, check_nmbr)) AS checks FROM check_cat GROUP BY 1) USING (subdiv_id)
  WHERE category_id <> 'PROMO'"""
C["areas"] = """SELECT CASE WHEN s_suppkey % 2 = 0 THEN DATE '2000-01-01' ELSE DATE '2001-01-01' END AS date, s_nationkey,
  ['total_area', 'trade_area', 'storage', 'b2b_area', 'copycenter_area'][i] AS type_area,
  max(floor((20 + abs(s_acctbal) / 50) * [1.0::DOUBLE, 0.7, 0.2, 0.1, 0.05][i])) AS area_value
  FROM supplier, range(1, 6) t(i) GROUP BY ALL"""
C["ref_area"] = f"SELECT CAST(date AS TIMESTAMP) AS date, {code('s_nationkey')} AS subdiv_id, type_area, area_value FROM areas"
C["area_last"] = "SELECT * FROM ref_area QUALIFY date = max(date) OVER (PARTITION BY subdiv_id)"
C["shop_areas"] = """SELECT subdiv_id, coalesce(max(area_value) FILTER (type_area = 'total_area'), 0) AS total_area,
  coalesce(max(area_value) FILTER (type_area = 'trade_area'), 0) AS trade_area,
  coalesce(max(area_value) FILTER (type_area = 'total_area'), 0) - coalesce(max(area_value) FILTER (type_area = 'b2b_area'), 0) AS effective_area
  FROM area_last GROUP BY 1"""
C["classes"] = f"""SELECT subdiv_id, area_value, subdiv_category, CASE WHEN area_value > 100 AND subdiv_category = '{SUPERMARKET_B2C}' THEN 'Супер'
  WHEN area_value >= 100 THEN 'Максі' WHEN area_value > 60 THEN 'Міді' WHEN area_value <= 60 THEN 'Міні' END AS trade_category
  FROM (SELECT DISTINCT subdiv_id FROM sale_month) LEFT JOIN (SELECT subdiv_id, area_value FROM area_last WHERE type_area = 'trade_area') USING (subdiv_id)
  LEFT JOIN subdiv_cat USING (subdiv_id)"""
C["store_class"] = "SELECT *, nullif(list_position(['Міні', 'Міді', 'Максі', 'Супер'], trade_category), 0) AS category_order FROM classes"
C["quarters"] = f"""SELECT trade_category, q, {br(div('sum(checks_report_sku)', 'sum(total_checks_qty)'), 2)} AS k, {br(div('sum(checks_report_qty)', 'sum(total_checks_qty)'), 2)} AS u
  FROM (SELECT *, CASE WHEN date < DATE '2000-07-01' THEN 1 WHEN date < DATE '2000-10-01' THEN 2 WHEN date < DATE '2001-01-01' THEN 3 ELSE 4 END AS q FROM sale_month)
  LEFT JOIN classes USING (subdiv_id) GROUP BY ALL"""
C["growth"] = f"""SELECT a.trade_category, {br('(CASE WHEN b.k > a.k THEN 1 + (b.k / nullif(a.k, 0) - 1) / 2 ELSE 1 - (1 - b.k / nullif(a.k, 0)) / 2 END)', 2)} AS check_sku_qty_growth,
  {br('(CASE WHEN b.u > a.u THEN 1 + (b.u / nullif(a.u, 0) - 1) / 2 ELSE 1 - (1 - b.u / nullif(a.u, 0)) / 2 END)', 2)} AS check_units_growth
  FROM quarters a JOIN quarters b ON a.trade_category IS NOT DISTINCT FROM b.trade_category WHERE a.q = 1 AND b.q = 2"""

# ---- expenses ---------------------------------------------------------------------------------------
_names = " ".join(f"WHEN {i + 1} THEN '{n}'" for i, n in enumerate(EXPENSE_NAMES))
C["exp_item"] = f"""SELECT DISTINCT p_size AS ref, {code('p_size')} AS id, CASE p_size {_names} ELSE 'expense ' || p_size END AS name,
  CASE WHEN p_size > 30 THEN p_size - 20 WHEN p_size > 10 THEN (p_size - 1) % 10 + 1 END AS parent_ref FROM part"""
C["ref_expense"] = """SELECT a.id AS exp_items_id, a.name AS exp_items_name, b.name AS exp_items_parent, false AS exp_items_marked
  FROM exp_item a LEFT JOIN exp_item b ON a.parent_ref = b.ref"""
C["exp_rows12"] = f"""SELECT l_shipdate AS date, id AS exp_items_id, name AS exp_items_name, {code('s_nationkey')} AS subdiv_id, r_name AS project,
  l_linenumber % 2 AS type_exp, l_extendedprice AS exp_sum, l_extendedprice * l_tax AS exp_vat
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN exp_item e ON e.ref = p_size
  LEFT JOIN region ON r_regionkey = s_nationkey % 5
  WHERE l_linenumber <> 6 AND id <> '{CFG.excluded_expense_id}' AND l_shipdate >= {S12} AND l_shipdate < {FIN}"""
C["exp_rows"] = "SELECT * FROM exp_rows12"


def _clean(src: str) -> str:
    subdiv = remap(remap(remap("subdiv_id", CFG.subdiv_merge), {k: CFG.head_office_target for k in CFG.head_office}), CFG.expense_subdiv_merge)
    return f"""SELECT CAST(date_trunc('month', date) AS DATE) AS date, exp_items_id, exp_items_name, {subdiv} AS subdiv_id, project,
  CASE WHEN type_exp = 0 THEN exp_sum + exp_vat ELSE -(exp_sum + exp_vat) END AS exp_sum, exp_items_parent, parent_2, coalesce(parent_2, exp_items_parent) AS expenses_item
  FROM {src} r LEFT JOIN ref_expense e USING (exp_items_id, exp_items_name)
  LEFT JOIN (SELECT exp_items_name AS p_name, exp_items_parent AS parent_2 FROM ref_expense) ON p_name = exp_items_parent
  WHERE coalesce(coalesce(parent_2, exp_items_parent) NOT IN ({quoted(DROPPED_EXPENSES)}), true)"""


C["expense_clean"] = _clean("exp_rows")
C["expense_clean12"] = _clean("exp_rows12")
C["expense_months"] = "SELECT date, subdiv_id, expenses_item, sum(exp_sum) AS exp_sum, sum(exp_sum) AS exp_sum_known FROM expense_clean12 GROUP BY ALL"
C["exp3"] = "SELECT * FROM expense_clean12 WHERE date >= DATE '2001-01-01'"
C["utilities"] = f"""SELECT subdiv_id, {br('avg(s)')} AS utilities_exp_sum FROM (SELECT date, subdiv_id, sum(exp_sum) AS s FROM exp3
  WHERE expenses_item IN ({quoted(UTILITY_EXPENSES)}) GROUP BY ALL) GROUP BY 1"""
C["rent"] = f"""SELECT subdiv_id, {br('max(s)')} AS avr_rent_sum FROM (SELECT date, {remap('subdiv_id', CFG.rent_subdiv_merge)} AS subdiv_id, sum(exp_sum) AS s FROM exp3
  WHERE expenses_item = '{RENT_EXPENSE}' GROUP BY ALL) GROUP BY 1"""
C["direct_costs"] = f"""SELECT subdiv_id, avr_total_exp_sum, avr_salary_sum, stuff_units, avr_working_hours, avr_rent_sum, utilities_exp_sum FROM
  (SELECT subdiv_id, {br('avg(s)')} AS avr_total_exp_sum FROM (SELECT date, subdiv_id, sum(exp_sum) AS s FROM
    (SELECT date, {remap('subdiv_id', CFG.rent_subdiv_merge)} AS subdiv_id, exp_sum FROM exp3 WHERE coalesce(expenses_item NOT IN ({quoted(NON_DIRECT_EXPENSES)}), true)
     UNION ALL SELECT date, subdiv_id, exp_sum FROM payroll_support) GROUP BY ALL) GROUP BY 1)
  LEFT JOIN payroll_store USING (subdiv_id) LEFT JOIN rent USING (subdiv_id) LEFT JOIN utilities USING (subdiv_id) WHERE avr_salary_sum IS NOT NULL"""

# ---- payroll ----------------------------------------------------------------------------------------
_pos = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in POSITIONS.items())
C["ev"] = f"""SELECT *, day(ts) AS day, ts + to_days(CAST((day(ts) - 1) * 3 - date_diff('day', DATE '2001-01-01', CAST(ts AS DATE)) AS INTEGER)) AS pay_ts,
  {code('user_id')} AS individ_id, CASE event_type {_pos} END AS position_id FROM events"""
C["m3"] = "SELECT * FROM (VALUES (DATE '2001-01-01'), (DATE '2001-02-01'), (DATE '2001-03-01')) t(date)"
C["position_asof"] = """SELECT date, individ_id, position_id FROM m3 JOIN ev ON pay_ts < date + INTERVAL 1 MONTH
  QUALIFY pay_ts = max(pay_ts) OVER (PARTITION BY date, individ_id)"""
C["pay_ev"] = "SELECT *, CAST(date_trunc('month', pay_ts) AS DATE) AS date FROM ev WHERE day <> 30 AND day <> 29"
C["salary_lines"] = f"""SELECT e.date, e.individ_id, CASE WHEN event_id % 10 <> 0 THEN {code('user_id % 25')} END AS subdiv_id, p.position_id,
  sum(value * 100) AS salary, sum(value) AS hours, sum(event_id % 3 * 100) AS norm
  FROM pay_ev e LEFT JOIN position_asof p ON p.date = e.date AND p.individ_id = e.individ_id GROUP BY ALL"""
C["salary_person"] = """SELECT date, individ_id, min(subdiv_id) AS subdiv_id, min(position_id) AS position_id, sum(salary) FILTER (salary <> 0) AS salary,
  sum(hours) FILTER (salary <> 0) AS hours, sum(norm) FILTER (salary <> 0) AS norm FROM salary_lines GROUP BY ALL"""
C["salary_month"] = f"""SELECT date, individ_id, {remap('subdiv_id', CFG.subdiv_merge)} AS subdiv_id, position_id, salary + contr + taxes AS total_salary,
  CASE WHEN norm = 0 THEN 0 WHEN hours >= norm THEN 1 ELSE hours / norm END AS stuff_unit, hours AS working_hours
  FROM salary_person JOIN (SELECT date, individ_id, sum(value * 22) AS contr, sum(value * 18) AS taxes FROM pay_ev GROUP BY ALL) USING (date, individ_id)
  WHERE salary IS NOT NULL"""
C["compensation"] = f"""SELECT e.pay_ts AS date, e.individ_id, {code('user_id % 25')} AS subdiv_id, value AS compensation_sum, p.position_id, tax_rate,
  value * (1 + tax_rate + 0.195) AS total_salary_expenses FROM ev e
  LEFT JOIN (SELECT * FROM position_asof WHERE date = DATE '2001-03-01') p USING (individ_id)
  LEFT JOIN (SELECT DISTINCT individ_id, CASE user_id % 3 WHEN 0 THEN 0.18::DOUBLE WHEN 1 THEN 0.2::DOUBLE END AS tax_rate FROM ev
             WHERE event_type = 'click' AND user_id % 3 < 2) USING (individ_id)
  WHERE event_type = 'purchase' AND event_id % 7 <> 0 AND value <> 0"""
C["salary_all"] = f"""SELECT date, subdiv_id, position_id, individ_id, coalesce(sum(total_salary), 0) AS total_salary, coalesce(sum(stuff_unit), 0) AS stuff_unit,
  coalesce(sum(working_hours), 0) AS working_hours FROM (SELECT * FROM salary_month UNION ALL BY NAME
  SELECT CAST(date_trunc('month', date) AS DATE) AS date, {remap('subdiv_id', CFG.subdiv_merge)} AS subdiv_id, position_id, individ_id, -total_salary_expenses AS total_salary FROM compensation) GROUP BY ALL"""
C["staff"] = f"""SELECT date, subdiv_id, CASE WHEN position_id = '000000031' AND subdiv_id = '000000012' THEN 0 WHEN position_id = '000000031' THEN 0.15::DOUBLE ELSE 1 END AS f,
  total_salary, stuff_unit, working_hours FROM salary_all WHERE subdiv_id IN (SELECT subdiv_id FROM subdiv_cat) AND position_id IN ({quoted(CFG.retail_positions)})"""
C["payroll_store"] = f"""SELECT subdiv_id, {br('avg(pay)')} AS avr_salary_sum, max_by(units, date) AS stuff_units, {br('avg(hours)')} AS avr_working_hours
  FROM (SELECT date, subdiv_id, sum(f * total_salary) AS pay, {br('sum(f * stuff_unit)', 1)} AS units, sum(f * working_hours) AS hours FROM staff GROUP BY ALL) GROUP BY 1
  UNION ALL SELECT subdiv_id, {br('avg(pay)')}, NULL, NULL FROM (SELECT date, subdiv_id, sum(total_salary) AS pay FROM salary_all
  WHERE subdiv_id IN ({quoted(CFG.logistic_subdivs)}) GROUP BY ALL) GROUP BY 1"""
C["payroll_support"] = f"""SELECT date, subdiv_id, sum(total_salary) AS exp_sum FROM salary_all WHERE subdiv_id IN (SELECT subdiv_id FROM subdiv_cat)
  AND position_id IN ({quoted(CFG.support_positions)}) GROUP BY ALL"""
C["driver_pay"] = f"""SELECT {br('avg(s)')} AS driver_pay FROM (SELECT date, sum(total_salary) AS s FROM salary_all WHERE subdiv_id = '{CFG.satellite_subdiv}'
  AND position_id IN ({quoted(CFG.driver_positions)}) GROUP BY 1)"""
C["account_balance"] = """SELECT date, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS debit, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS credit,
  sum(o_totalprice) FILTER (o_orderstatus = 'F') - sum(o_totalprice) FILTER (o_orderstatus = 'O') AS balance
  FROM m3 JOIN orders ON o_orderdate < date + INTERVAL 1 MONTH AND o_custkey % 3 = 1 AND o_orderpriority <> '5-LOW' GROUP BY 1"""
C["gp_rows"] = f"""SELECT date, subdiv_id, {rsum('checks_report_sum - doc_cost_sum')} AS retail, NULL AS serv FROM sale_month WHERE date >= DATE '2001-01-01' AND organization_id = '000000001' GROUP BY ALL
  UNION ALL SELECT CAST(date_trunc('month', sale_doc_date) AS DATE), {remap('subdiv_id', CFG.service_subdiv_merge)}, NULL, sum(gross_profit) FROM service WHERE organization_id = '000000001' GROUP BY 1, 2"""
C["vat_store"] = f"""SELECT subdiv_id, {br('avg(retail / nullif(total, 0) * vat_sum)')} AS avr_vat_sum FROM gp_rows
  JOIN (SELECT date, coalesce(sum(retail), 0) + coalesce(sum(serv), 0) AS total FROM gp_rows GROUP BY 1) USING (date)
  LEFT JOIN (SELECT date, CASE WHEN balance < 0 THEN -{br('balance')} WHEN balance >= 0 THEN 0 END AS vat_sum FROM account_balance) USING (date)
  WHERE retail IS NOT NULL GROUP BY 1"""

# ---- stock motion -----------------------------------------------------------------------------------
C["item_root"] = """SELECT item_id, CASE WHEN root <> ref THEN printf('%09d', root) END AS main_parent FROM (
  SELECT ref, item_id, CASE WHEN ref < 10 THEN ref WHEN ref < 100 THEN ref // 10 WHEN ref < 1000 THEN ref // 100 WHEN ref < 10000 THEN ref // 1000
  WHEN ref < 100000 THEN ref // 10000 ELSE ref // 100000 END AS root FROM item)"""
C["non_trade"] = f"SELECT item_id FROM item_root WHERE main_parent IN ({quoted(CFG.non_trade_roots)})"
C["trade_stores"] = f"""SELECT c.subdiv_id, {code('store_ref')} AS store_id FROM subdiv_cat c JOIN subdiv USING (subdiv_id) WHERE subdiv_category <> '{SUPERMARKET_B2B}'"""
C["motion_all"] = f"""SELECT l_shipdate AS date_movement, {code('l_suppkey')} AS store_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS type_motion,
  CASE WHEN l_linenumber % 3 = 0 THEN {code('o_orderkey')} END AS nmbr_sale_doc, CASE WHEN l_linenumber % 3 = 0 THEN o_orderdate END AS date_sale_doc,
  CASE WHEN l_linenumber % 3 = 0 THEN {code('o_custkey % 25')} END AS subdiv_id,
  CASE WHEN l_linenumber % 3 = 1 THEN 'T' || {code('o_orderkey')} END AS nmbr_moving_out, CASE WHEN l_linenumber % 3 = 1 THEN o_orderdate END AS date_moving_out,
  CASE WHEN l_linenumber % 3 = 1 THEN s.store_id END AS store_receiver, r.nmbr AS nmbr_checks_report, r.date AS date_checks_report,
  {code('l_partkey')} AS item_id, l_quantity AS item_motion_qty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN store s ON s.ref = o_custkey % 100
  LEFT JOIN check_report r ON l_linenumber % 3 = 2 AND r.ref = -((l_suppkey % 25) * 100000 + {ym('l_shipdate')})
  WHERE l_shipdate >= {MOTION} AND l_shipdate < {FIN} AND {code('l_partkey')} NOT IN (SELECT item_id FROM non_trade)"""
C["stock_motion"] = "SELECT * FROM motion_all WHERE store_id IN (SELECT store_id FROM trade_stores)"
C["shipment_share"] = f"""SELECT subdiv_id, type_subdiv, {br(div('u', 'sum(u) OVER (PARTITION BY subdiv_id)'), 3)} AS avr_subdiv_share FROM (
  SELECT st.subdiv_id, CASE WHEN nmbr_sale_doc IS NOT NULL THEN 'service' ELSE 'retail' END AS type_subdiv, sum(item_motion_qty) AS u
  FROM stock_motion m LEFT JOIN (SELECT subdiv_id, {code('store_ref')} AS main FROM subdiv) d ON d.subdiv_id = m.subdiv_id JOIN store st ON st.store_id = m.store_id
  WHERE type_motion = 1 AND (nmbr_sale_doc IS NOT NULL OR nmbr_checks_report IS NOT NULL) AND (m.subdiv_id IS NULL OR m.store_id = main) GROUP BY 1, 2)"""
C["satellites"] = f"""SELECT store_id, subdiv_id FROM store WHERE distribution_ref = 2 AND NOT marked AND store_id <> '{CFG.satellite_store}'"""
C["dist_motion"] = "SELECT * FROM motion_all WHERE type_motion = 1 AND (nmbr_moving_out IS NOT NULL OR nmbr_sale_doc IS NOT NULL)"
C["satellite_share"] = f"""SELECT receiver AS subdiv_id, share AS satellite_subdiv_share FROM (SELECT *, {br(div('u', 'sum(u) OVER ()'), 3)} AS share FROM (
  SELECT coalesce(m.subdiv_id, s.subdiv_id) AS receiver, CASE WHEN m.subdiv_id IS NOT NULL THEN 'service' ELSE 'retail' END AS type, sum(item_motion_qty) AS u
  FROM dist_motion m LEFT JOIN store s ON s.store_id = m.store_receiver WHERE m.store_id = '{CFG.satellite_store}'
  AND (m.subdiv_id IS NULL OR m.subdiv_id IN (SELECT subdiv_id FROM subdiv WHERE NOT marked AND {code('store_ref')} IN (SELECT store_id FROM satellites)))
  AND (m.store_receiver IS NULL OR m.store_receiver IN (SELECT store_id FROM satellites)) GROUP BY 1, 2)) WHERE type = 'retail'"""
C["main_units"] = f"""SELECT receiver, type, {br(div('u', 'sum(u) OVER ()'), 3)} AS share FROM (
  SELECT coalesce(m.subdiv_id, CASE WHEN store_receiver = '000000008' THEN '000000009' ELSE s.subdiv_id END) AS receiver,
  CASE WHEN m.subdiv_id IS NOT NULL THEN 'service' ELSE 'retail' END AS type, sum(item_motion_qty) AS u
  FROM dist_motion m LEFT JOIN store s ON s.store_id = m.store_receiver WHERE m.store_id = '{CFG.main_store}' GROUP BY 1, 2)
  WHERE receiver IN (SELECT subdiv_id FROM subdiv_cat) OR receiver = '{CFG.satellite_subdiv}'"""
C["main_share"] = f"""SELECT receiver AS subdiv_id, (CASE WHEN satellite_subdiv_share IS NOT NULL THEN share + satellite_subdiv_share *
  (SELECT max(share) FROM main_units WHERE type = 'retail' AND receiver = '{CFG.satellite_subdiv}') ELSE share END) * coalesce(avr_subdiv_share, 1) AS avr_share
  FROM main_units m LEFT JOIN satellite_share s ON s.subdiv_id = receiver LEFT JOIN (SELECT subdiv_id, avr_subdiv_share FROM shipment_share JOIN subdiv_cat USING (subdiv_id)
  WHERE subdiv_category = '{SUPERMARKET_B2C}' AND type_subdiv = 'retail') h ON h.subdiv_id = receiver WHERE type = 'retail' AND receiver <> '{CFG.satellite_subdiv}'"""
_whole = " + ".join(f"coalesce({c}, 0)" for c in ("avr_total_exp_sum", "avr_salary_sum", "avr_rent_sum", "utilities_exp_sum"))
C["warehouse_cost"] = f"""SELECT subdiv_id, coalesce(avr_share * (SELECT coalesce(sum({_whole}), 0) FROM direct_costs WHERE subdiv_id = '{CFG.main_store_subdiv}'), 0)
  + coalesce(satellite_subdiv_share * ((SELECT coalesce(sum({_whole}), 0) FROM direct_costs WHERE subdiv_id = '{CFG.satellite_subdiv}') - (SELECT driver_pay FROM driver_pay)), 0) AS distr_stores_cost
  FROM main_share LEFT JOIN satellite_share USING (subdiv_id)"""

# ---- delivery ---------------------------------------------------------------------------------------
C["trip"] = f"""SELECT o_orderkey AS k, {code('o_orderkey')} AS nmbr_delivery, o_orderdate AS date_delivery, o_orderdate + INTERVAL 8 HOUR AS time_depart,
  CASE o_orderkey % 10 WHEN 0 THEN o_orderdate - INTERVAL 10 HOUR WHEN 1 THEN o_orderdate + INTERVAL 8 HOUR - INTERVAL 1 YEAR + INTERVAL 5 HOUR
    WHEN 2 THEN o_orderdate + INTERVAL 5 HOUR WHEN 3 THEN TIMESTAMP '0001-01-02 00:00:00' ELSE o_orderdate + INTERVAL 8 HOUR + to_hours(2 + o_orderkey % 7) END AS time_return,
  o_totalprice AS delivery_weight, CAST(o_orderkey % 1000 + 1 AS DOUBLE) AS speedo_start,
  CASE WHEN o_orderkey % 19 = 0 THEN 0 ELSE o_orderkey % 1000 + 1 + floor(o_totalprice / 1000) END AS speedo_finish,
  s.store_id, s.store_name, CASE WHEN o_orderpriority = '5-LOW' THEN 'САМОВИВІЗ' ELSE o_orderpriority END AS direction,
  {code('o_custkey % 12')} AS route_id, 'route ' || (o_custkey % 12) AS route,
  CASE WHEN o_custkey % 20 <> 19 THEN {code('o_custkey % 20')} END AS vehicle_id, CASE WHEN o_custkey % 20 <> 19 THEN 'auto ' || (o_custkey % 20) END AS vehicle_name,
  f.individ_id AS forwarder, d.individ_id AS driver
  FROM orders LEFT JOIN store s ON s.ref = o_custkey % 5 LEFT JOIN person f ON f.ref = o_custkey % 41 LEFT JOIN person d ON d.ref = o_custkey % 37
  WHERE o_orderkey % 23 <> 0 AND o_orderdate + INTERVAL 8 HOUR >= {S3} AND o_orderdate + INTERVAL 8 HOUR < {FIN}"""
C["person"] = f"SELECT DISTINCT user_id AS ref, {code('user_id')} AS individ_id FROM events"
C["stops"] = f"""SELECT l_orderkey AS k, l_suppkey AS s, sum(l_quantity) AS weight, any_value(o_orderdate) AS od, any_value(o_custkey) AS c
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"""
_TRIP = "nmbr_delivery, date_delivery, time_depart, time_return, delivery_weight, speedo_start, speedo_finish, store_id, store_name, direction, route_id, route, vehicle_id, vehicle_name, forwarder, driver"
_REPAIR = """CASE WHEN year(time_return) > 21 AND year(time_return) < year(time_depart) THEN time_return + to_years(CAST(year(time_depart) - year(time_return) AS INTEGER))
  WHEN day(time_return) < day(time_depart) THEN time_return + to_days(CAST(day(time_depart) - day(time_return) AS INTEGER)) ELSE time_return END"""
C["delivery_rows"] = f"""SELECT {_TRIP}, to_intermediate, is_not_delivered, nmbr_deliv_order, date_deliv_order, nmbr_luggage, date_luggage
  FROM trip LEFT JOIN (SELECT k, s % 9 = 0 AS to_intermediate, s % 8 = 7 AS is_not_delivered,
  CASE WHEN s % 12 <> 0 AND od >= {S3} - INTERVAL 14 DAY AND od < {FIN} THEN k || '-' || s END AS nmbr_deliv_order,
  CASE WHEN s % 12 <> 0 AND od >= {S3} - INTERVAL 14 DAY AND od < {FIN} THEN od END AS date_deliv_order,
  CASE WHEN s % 12 = 0 THEN 'L' || {code('k')} END AS nmbr_luggage, CASE WHEN s % 12 = 0 THEN od END AS date_luggage FROM stops) USING (k)"""


def _fixed(src: str) -> str:
    return f"""SELECT * EXCLUDE (fixed), speedo_finish - speedo_start AS distance, CAST(date_trunc('month', date_delivery) AS DATE) AS date,
  {br("date_diff('second', time_depart, time_return) / 60", 1)} AS duration FROM (SELECT * REPLACE (fixed AS time_return) FROM (SELECT *, {_REPAIR} AS fixed FROM {src}))
  WHERE vehicle_name IS NOT NULL AND speedo_finish > 0"""


C["delivery_clean"] = _fixed("(SELECT * FROM delivery_rows WHERE NOT is_not_delivered)")
C["delivery_crews"] = f"SELECT * EXCLUDE (k) FROM ({_fixed('(SELECT * FROM trip WHERE k IN (SELECT k FROM stops WHERE s % 8 <> 7))')})"
C["delivery_orders"] = f"""SELECT k || '-' || s AS nmbr_deliv_order, od AS date_deliv_order, deliv_address_id, region_id AS address_region,
  a.store_id, a.store_name, CASE WHEN s % 9 = 0 THEN a.store_name END AS intermediate_store, weight,
  CASE WHEN s % 2 = 0 AND od >= lo - INTERVAL 30 DAY AND od < {FIN} THEN {code('k')} END AS nmbr_sale_doc, CASE WHEN s % 2 = 0 AND od >= lo - INTERVAL 30 DAY THEN od END AS date_sale_doc,
  {code('c_custkey')} AS customer_id, CASE WHEN s % 2 = 0 THEN {code('c % 25')} END AS subdiv_id, CASE WHEN s % 2 = 1 THEN 'T' || {code('k')} END AS nmbr_moving_out,
  CASE WHEN s % 2 = 1 THEN od END AS date_moving_out, r.store_id AS recipient_store
  FROM (SELECT *, {S3} AS lo FROM stops) LEFT JOIN store a ON a.ref = c % 5 LEFT JOIN store r ON r.ref = s LEFT JOIN address d ON d.ref = s
  LEFT JOIN customer ON c_custkey = s WHERE s % 12 <> 0 AND od >= {S3} AND od < {FIN}"""
C["crew_trips"] = """SELECT DISTINCT nmbr_delivery, date, forwarder, driver, vehicle_id, vehicle_name, direction, route_id, CASE WHEN duration < 0 THEN 1 ELSE duration END AS duration, distance
  FROM delivery_crews WHERE distance > 0 AND CAST(time_return AS DATE) > DATE '2000-01-01'"""
C["crew_hours"] = """SELECT date, person, vehicle_id, sum(duration) AS hours FROM (SELECT date, driver AS person, vehicle_id, duration FROM crew_trips
  UNION ALL SELECT date, forwarder, vehicle_id, duration FROM crew_trips WHERE forwarder IS NOT NULL AND forwarder NOT IN (SELECT driver FROM crew_trips WHERE driver IS NOT NULL)) GROUP BY ALL"""
C["crew_cost"] = f"""SELECT date, vehicle_id, sum(pay) AS person_exp, any_value(v) % 25 AS vs FROM (SELECT h.date, vehicle_id, CAST(vehicle_id AS INTEGER) AS v,
  {br('hours / nullif(sum(hours) OVER (PARTITION BY h.date, person), 0) * total_salary')} AS pay FROM crew_hours h JOIN salary_all s ON s.date = h.date AND s.individ_id = person
  WHERE position_id IN ({quoted(CFG.driver_positions)})) WHERE v % 4 <> 3 AND v <> 17 GROUP BY ALL"""
C["truck_cost"] = f"""SELECT c.date, c.vehicle_id, {br('(person_exp + fuel + upkeep) / nullif(km, 0)', 3)} AS cost_1km FROM crew_cost c
  LEFT JOIN (SELECT date, vehicle_id, sum(distance) AS km FROM (SELECT DISTINCT nmbr_delivery, date_delivery, date, vehicle_id, distance FROM delivery_crews) GROUP BY ALL) d ON d.date = c.date AND d.vehicle_id = c.vehicle_id
  LEFT JOIN (SELECT date, subdiv_id, sum(exp_sum) AS fuel FROM exp3 WHERE expenses_item = '{FUEL_EXPENSE}' GROUP BY ALL) f ON f.date = c.date AND f.subdiv_id = {code('vs')}
  LEFT JOIN (SELECT subdiv_id, {br('avg(m) / 100')} * 100 AS upkeep FROM (SELECT date, subdiv_id, sum(exp_sum) AS m FROM expense_clean12
    WHERE expenses_item IN ({quoted(MAINTENANCE_EXPENSES)}) GROUP BY ALL) GROUP BY 1) u ON u.subdiv_id = {code('vs')}"""
C["moved"] = f"""SELECT nmbr_delivery, date_delivery, printf('%09d', CAST(c % 12 AS INTEGER) % 3) AS route_parent, t.store_id AS delivery_store, t.vehicle_id, o.recipient_store
  FROM ({_fixed('trip')}) t JOIN (SELECT k, s, c, od, k || '-' || s AS nmbr_deliv_order FROM stops WHERE s % 12 <> 0 AND s % 8 <> 7 AND s % 9 <> 0) x USING (k)
  JOIN (SELECT k || '-' || s AS nmbr_deliv_order, {code('s')} AS recipient_store, n % 5 AS g FROM (SELECT stops.*, s_nationkey AS n FROM stops JOIN supplier ON s_suppkey = s)) o USING (nmbr_deliv_order)
  WHERE direction <> 'САМОВИВІЗ' AND route_id <> '000000010' AND speedo_finish > speedo_start AND od >= {S3} - INTERVAL 14 DAY AND od < {FIN}
  AND t.vehicle_id IN (SELECT vehicle_id FROM crew_cost) AND recipient_store IN (SELECT store_id FROM trade_stores) AND t.store_id IS NOT NULL AND (c % 12 + g) % 2 = 0"""
C["stop_rows"] = f"""SELECT DISTINCT nmbr_delivery, date_delivery, route_parent, delivery_store, vehicle_id,
  CASE WHEN delivery_store = '{CFG.main_store}' AND recipient_store IN (SELECT store_id FROM satellites) THEN '{CFG.satellite_store}' ELSE recipient_store END AS recipient_store FROM moved"""
C["stop_list"] = """SELECT *, string_agg(recipient_store, ', ' ORDER BY recipient_store) OVER (PARTITION BY nmbr_delivery, date_delivery, route_parent, delivery_store, vehicle_id
  ORDER BY recipient_store ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS store_list FROM stop_rows
  WHERE NOT (delivery_store = '000000002' AND recipient_store = '000000005') AND NOT (delivery_store = '000000001' AND recipient_store = '000000009')"""
C["tour_legs"] = """SELECT delivery_store || '|' || store_list AS trip_key, i AS leg_no, path[i + 1] AS "end", (CAST(path[i] AS BIGINT) * 7 + CAST(path[i + 1] AS BIGINT) * 13) % 50 + 1 AS distance FROM (
  SELECT *, unnest(range(1, len(path))) AS i FROM (SELECT DISTINCT delivery_store, store_list, list_concat([delivery_store], string_split(store_list, ', '), [delivery_store]) AS path FROM stop_list))"""


def _alloc(src: str) -> str:
    return f"""SELECT trip_key, pos, {br('w / nullif(sum(w) OVER (PARTITION BY trip_key), 0) * total', 1)} AS distance FROM (SELECT trip_key, "end" AS pos, total, least(c, total - c) AS w FROM (
  SELECT *, sum(distance) OVER (PARTITION BY trip_key) AS total, sum(distance) OVER (PARTITION BY trip_key ORDER BY leg_no) AS c, max(leg_no) OVER (PARTITION BY trip_key) AS last FROM {src})
  WHERE leg_no < last)"""


C["legs"] = f"""SELECT k AS trip_key, row_number() OVER (PARTITION BY k ORDER BY s) AS leg_no, {code('s')} AS "end", weight AS distance FROM stops"""
C["leg_allocate"] = _alloc("legs")
C["tour_alloc"] = _alloc("tour_legs")
C["transport_raw"] = f"""SELECT recipient_store, avg(total) AS cost FROM (SELECT date, recipient_store, {rsum('km * cost_1km')} AS total FROM (
  SELECT CAST(date_trunc('month', date_delivery) AS DATE) AS date, vehicle_id, recipient_store, {rsum("CASE WHEN route_parent = '000000002' THEN distance / 2 ELSE distance END")} AS km
  FROM stop_list LEFT JOIN tour_alloc ON trip_key = delivery_store || '|' || store_list AND pos = recipient_store GROUP BY ALL)
  LEFT JOIN truck_cost USING (date, vehicle_id) GROUP BY ALL) GROUP BY 1"""
C["transport"] = f"""SELECT subdiv_id, CASE WHEN satellite_subdiv_share IS NULL THEN {br('cost')} ELSE {br(f"(SELECT max(cost) FROM transport_raw JOIN store ON store_id = recipient_store WHERE subdiv_id = '{CFG.satellite_subdiv}') * satellite_subdiv_share + cost")} END AS avr_transport_cost
  FROM (SELECT s.subdiv_id, cost FROM transport_raw LEFT JOIN store s ON s.store_id = recipient_store UNION ALL SELECT '{CFG.extra_transport_subdiv}', 0)
  LEFT JOIN satellite_share USING (subdiv_id) WHERE subdiv_id <> '{CFG.satellite_subdiv}'"""
C["schedule"] = f"""SELECT o_orderdate AS date, a.store_id AS recipient_store, b.store_id AS distribution_store, {', '.join(f'(o_orderkey + {i}) % 2 = 0 AS day_{i}' for i in range(1, 8))}
  FROM orders LEFT JOIN store a ON a.ref = o_custkey % 100 LEFT JOIN store b ON b.ref = o_custkey % 5
  QUALIFY o_orderdate = max(o_orderdate) OVER (PARTITION BY a.store_id, b.store_id)"""

# ---- stock ------------------------------------------------------------------------------------------
C["open_stores"] = f"SELECT ref AS store_ref, store_id FROM store WHERE {code('parent_ref')} NOT IN ({quoted(CFG.closed_parent_stores)}) AND parent_ref IN (SELECT ref FROM store s2)"
C["stk"] = f"""SELECT l_shipdate, l_linenumber % 2 AS half, CAST(date_trunc('month', l_shipdate) AS DATE) AS m, store_id, {code('l_partkey')} AS item_id,
  CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS sgn, l_quantity AS q, l_extendedprice AS v,
  l_extendedprice * CASE WHEN l_tax >= 0.05 THEN 0.2::DOUBLE ELSE l_tax END AS vat,
  (l_linestatus = 'F' OR l_suppkey % 3 = 0) AND l_suppkey % 10 <> 9 AS batched FROM lineitem JOIN open_stores ON store_ref = l_suppkey"""
C["inv_current"] = "SELECT store_id, item_id, sum(sgn * q) AS item_store_qty FROM stk GROUP BY ALL HAVING sum(sgn * q) <> 0"
C["inv_current_batch"] = """SELECT store_id, item_id, m AS date_receipt, sum(sgn * q) AS item_store_qty,
  sum(sgn * v + CASE WHEN sgn * vat < floor(sgn * v / 5 * 10) / 10 THEN 0 ELSE sgn * vat END) AS item_store_sum FROM stk WHERE batched GROUP BY ALL"""
C["inv_movement"] = f"""SELECT m AS date_movement, store_id, item_id, sum(sgn * q) AS store_item_moving_qty FROM stk WHERE l_shipdate >= {S3} GROUP BY ALL HAVING sum(sgn * q) <> 0"""
C["inv_movement_receipt"] = f"""SELECT m, half, store_id, item_id, sum(sgn * q) AS q,
  sum(sgn * (v + CASE WHEN vat < floor(v / 5 * 10) / 10 THEN 0 ELSE vat END)) AS v FROM stk WHERE batched AND l_shipdate >= {S3} GROUP BY ALL HAVING sum(sgn * q) <> 0"""
C["inv_movement_batch"] = """SELECT m AS date_movement, m AS date_receipt, store_id, item_id, sum(q) AS item_motion_qty, sum(v) AS item_motion_cost
  FROM inv_movement_receipt GROUP BY ALL"""
C["snaps"] = "SELECT * FROM (VALUES (DATE '2001-01-01'), (DATE '2001-02-01'), (DATE '2001-03-01'), (DATE '2001-04-01')) t(date)"


def _rollback(trade: bool) -> str:
    f = " WHERE item_id NOT IN (SELECT item_id FROM non_trade)" if trade else ""
    return f"""SELECT date, store_id, item_id, coalesce(item_store_qty, 0) - coalesce(mv, 0) AS balance_qty FROM
  (SELECT date, store_id, item_id, item_store_qty FROM snaps, inv_current{f}) FULL JOIN
  (SELECT date, store_id, item_id, sum(store_item_moving_qty) AS mv FROM snaps JOIN inv_movement ON date_movement >= date{f} GROUP BY ALL) USING (date, store_id, item_id)
  WHERE coalesce(item_store_qty, 0) - coalesce(mv, 0) <> 0"""


def _batch_rollback(trade: bool) -> str:
    f = " WHERE item_id NOT IN (SELECT item_id FROM non_trade)" if trade else ""
    return f"""SELECT date, store_id, item_id, date_receipt, sum(q) AS balance_batch_qty, sum(v) AS balance_batch_sum FROM (
  SELECT date, store_id, item_id, date_receipt, item_store_qty AS q, item_store_sum AS v FROM snaps, inv_current_batch UNION ALL
  SELECT date, store_id, item_id, date_receipt, -item_motion_qty, -item_motion_cost FROM snaps JOIN inv_movement_batch ON date_movement >= date){f} GROUP BY ALL
  HAVING abs(sum(q)) >= 1.490116e-8 AND NOT (sum(q) < 0 AND sum(v) > 0)"""


C["price_day"] = f"""SELECT {code('l_partkey')} AS item_id, CAST(l_shipdate AS DATE) AS date_setting, min(l_extendedprice / l_quantity) AS item_price FROM lineitem GROUP BY ALL"""
C["price_history"] = """SELECT * FROM price_day JOIN (SELECT item_id, max(date_setting) AS lo FROM price_day WHERE date_setting < DATE '2001-01-01' GROUP BY 1) USING (item_id) WHERE date_setting >= lo"""
for _name, _trade in (("", False), ("_t", True)):
    C[f"rollback{_name}"] = _rollback(_trade)
    C[f"batch_rollback{_name}"] = _batch_rollback(_trade)
    C[f"joined{_name}"] = f"""SELECT *, max(cq) OVER (PARTITION BY date, store_id, item_id) AS mx FROM (SELECT r.*, date_receipt, balance_batch_qty AS q, balance_batch_sum AS v,
  sum(balance_batch_qty) OVER w AS cq, sum(balance_batch_sum) OVER w AS cv, row_number() OVER w AS rn, count(*) OVER (PARTITION BY r.date, r.store_id, r.item_id) AS n
  FROM rollback{_name} r LEFT JOIN batch_rollback{_name} b ON b.date = r.date AND b.store_id = r.store_id AND b.item_id = r.item_id
  WINDOW w AS (PARTITION BY r.date, r.store_id, r.item_id ORDER BY date_receipt DESC NULLS LAST ROWS UNBOUNDED PRECEDING))"""
    _unit, _b = "v / nullif(q, 0)", "balance_qty"
    C[f"lifo{_name}"] = f"""SELECT date, store_id, item_id, cv AS balance_sum FROM joined{_name} WHERE mx = {_b} AND cq = {_b} QUALIFY row_number() OVER (PARTITION BY date, store_id, item_id ORDER BY rn) = 1
  UNION ALL SELECT date, store_id, item_id, CASE WHEN q = cq THEN {br(f'{_unit} * {_b}', 2)} ELSE {br(f'cv - v + {_unit} * (q - (cq - {_b}))', 2)} END
  FROM joined{_name} WHERE cq > {_b} QUALIFY row_number() OVER (PARTITION BY date, store_id, item_id ORDER BY rn) = 1
  UNION ALL SELECT date, store_id, item_id, CASE WHEN q = cq THEN {br(f'{_unit} * {_b}', 2)} ELSE {br(f'cv + {_unit} * ({_b} - cq)', 2)} END
  FROM joined{_name} WHERE mx < {_b} AND rn = n
  UNION ALL SELECT j.date, store_id, j.item_id, {_b} * item_price FROM (SELECT * FROM joined{_name} WHERE cq IS NULL) j ASOF LEFT JOIN price_history p ON p.item_id = j.item_id AND j.date > p.date_setting"""
    C[f"inv_category{_name}"] = f"""SELECT date, store_id, category_id, coalesce(sum(balance_sum), 0) AS category_inventory_sum,
  CASE WHEN count(balance_sum) = count(*) THEN count(*) FILTER (balance_sum > 0) END AS category_sku FROM lifo{_name} JOIN item USING (item_id) WHERE category_id IS NOT NULL GROUP BY ALL"""
C["inv_store_mean"] = f"""SELECT subdiv_id, {br('avg(m)')} AS avr_inventory, {br('avg(k)')} AS avr_sku_qty FROM (SELECT store_id, date, sum(category_inventory_sum) AS m, coalesce(sum(category_sku), 0) AS k
  FROM inv_category_t WHERE store_id IN (SELECT store_id FROM trade_stores) GROUP BY ALL) JOIN store USING (store_id) GROUP BY 1"""
C["inv_cat_mean"] = """SELECT s.subdiv_id, category_id, avg(category_inventory_sum) AS a FROM inv_category_t JOIN store s USING (store_id) WHERE store_id IN (SELECT store_id FROM trade_stores) GROUP BY store_id, s.subdiv_id, category_id"""
C["category_structure"] = f"""SELECT subdiv_id, CASE WHEN category_id = 'MEDIUM' THEN '16. Лайфстайл' ELSE lower(category_id) END AS category_name, category_checks_share, category_revenue_share, category_inventory_share
  FROM sale_structure LEFT JOIN (SELECT subdiv_id, category_id, {br(div('a', 'sum(a) OVER (PARTITION BY subdiv_id)'), 3)} AS category_inventory_share FROM inv_cat_mean) USING (subdiv_id, category_id)"""
C["generator"] = f"""SELECT subdiv_id, category_name || ' - ' || {num_text('category_revenue_share * 100', 4)} || '%' AS revenue_generator FROM category_structure
  QUALIFY row_number() OVER (PARTITION BY subdiv_id ORDER BY category_revenue_share DESC, category_name) = 1"""

# ---- loyalty ----------------------------------------------------------------------------------------
C["receipts"] = f"""SELECT o_orderkey AS k, o_orderdate AS date, CASE WHEN o_custkey % 10 <> 0 THEN {code('o_custkey')} END AS client, CASE WHEN o_orderstatus = 'P' THEN 4 ELSE 0 END AS type,
  st.store_id AS code_subdivision FROM orders LEFT JOIN store st ON st.ref = o_orderkey % 100 WHERE o_orderpriority <> '5-LOW' AND o_orderkey % 17 <> 0"""
C["discount_lines"] = f"""SELECT date, client, type, k AS global_number, code_subdivision, ['5% на бонусний рахунок', 'Використання бонусів', 'Акція', 'Округление на вид оплаты'][l_linenumber % 4 + 1] AS name,
  {code('l_partkey')} AS item, sg * l_quantity AS total_quantity, l_linenumber AS position, sg * l_extendedprice AS base_total, sg * -l_extendedprice * l_discount + 0 AS increment,
  sg * CASE WHEN l_linenumber % 4 = 0 THEN l_extendedprice * 0.05 ELSE 0 END + 0 AS account_increment
  FROM (SELECT *, CASE WHEN type = 4 THEN -1 ELSE 1 END AS sg FROM receipts WHERE date >= {S3} AND date < {FIN}) JOIN lineitem ON l_orderkey = k"""
C["new_cards"] = f"""SELECT store, count(*) AS count FROM (SELECT client, min(date) AS d, arg_min(coalesce(code_subdivision, ''), (date, coalesce(code_subdivision, ''))) AS st FROM receipts WHERE client IS NOT NULL GROUP BY 1),
  LATERAL (SELECT nullif(st, '') AS store) WHERE d >= {S3} AND d < {FIN} GROUP BY 1"""
C["discount_class"] = """SELECT subdiv_id, code_subdivision, max(s) FILTER (c = 1) AS "Нарахування_бонусів", max(s) FILTER (c = 2) AS "Використання_бонусів", max(s) FILTER (c = 3) AS "Знижка_Маркетинг" FROM (
  SELECT code_subdivision, CASE name WHEN '5% на бонусний рахунок' THEN 1 WHEN 'Використання бонусів' THEN 2 ELSE 3 END AS c, BR AS s
  FROM discount_lines WHERE (increment <> 0 OR account_increment <> 0) AND name <> 'Округление на вид оплаты' GROUP BY 1, 2) LEFT JOIN store ON store_id = code_subdivision GROUP BY 1, 2""".replace("BR", br("-sum(increment) + sum(account_increment)"))
C["card_visits"] = "SELECT code_subdivision, client, count(DISTINCT CAST(date AS DATE)) AS total_purchase FROM discount_lines WHERE client IS NOT NULL GROUP BY ALL"
C["card_stats"] = f"""SELECT subdiv_name, trade_category, card_owners_share, total_purch, {br('1 - p1 / nullif(total_purch, 0)', 2)} AS purch_more_1_share, coalesce(new_cards, 0) AS new_cards
  FROM (SELECT s.subdiv_id, count(*) FILTER (total_purchase = 1) AS p1, count(*) AS total_purch FROM card_visits JOIN store s ON s.store_id = code_subdivision
        WHERE s.store_id IN (SELECT store_id FROM trade_stores) GROUP BY 1)
  LEFT JOIN (SELECT s.subdiv_id, sum(count) AS new_cards FROM new_cards JOIN store s ON s.store_id = store WHERE s.store_id IN (SELECT store_id FROM trade_stores) GROUP BY 1) USING (subdiv_id)
  LEFT JOIN (SELECT subdiv_id, card_owners_share FROM kpi) USING (subdiv_id) LEFT JOIN (SELECT subdiv_id, subdiv_name FROM subdiv) USING (subdiv_id)
  LEFT JOIN (SELECT subdiv_id, trade_category FROM classes) USING (subdiv_id)"""

# ---- KPI --------------------------------------------------------------------------------------------
_zero = ("total_revenue avr_revenue total_cog avr_cog total_checks_qty avr_checks_qty total_sku_in_checks total_units_qty total_card_owners_checks_qty total_area trade_area effective_area "
         "avr_inventory avr_sku_qty avr_total_exp_sum avr_salary_sum stuff_units avr_working_hours avr_rent_sum utilities_exp_sum avr_subdiv_share distr_stores_cost avr_transport_cost avr_vat_sum").split()
_disc = ("Нарахування_бонусів", "Використання_бонусів", "Знижка_Маркетинг")
C["kpi0"] = "SELECT subdiv_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _zero) + ", " + ", ".join(f'coalesce("{c}", 0) AS "{c}"' for c in _disc) + """,
  revenue_generator, subdiv_category FROM sale_store LEFT JOIN shop_areas USING (subdiv_id) LEFT JOIN inv_store_mean USING (subdiv_id) LEFT JOIN direct_costs USING (subdiv_id)
  LEFT JOIN (SELECT subdiv_id, avr_subdiv_share FROM shipment_share WHERE type_subdiv = 'retail') USING (subdiv_id) LEFT JOIN warehouse_cost USING (subdiv_id)
  LEFT JOIN (SELECT subdiv_id, sum(avr_transport_cost) AS avr_transport_cost FROM transport GROUP BY 1) USING (subdiv_id) LEFT JOIN vat_store USING (subdiv_id)
  LEFT JOIN (SELECT subdiv_id, """ + ", ".join(f'sum("{c}") AS "{c}"' for c in _disc) + """ FROM discount_class GROUP BY 1) USING (subdiv_id)
  LEFT JOIN generator USING (subdiv_id) LEFT JOIN subdiv_cat USING (subdiv_id)"""
_up, _log, _sup = "avr_rent_sum + utilities_exp_sum", "distr_stores_cost + avr_transport_cost", f"coalesce(subdiv_category = '{SUPERMARKET_B2C}', false)"
C["kpi1"] = f"""SELECT *, {BASKET}, avr_revenue - avr_cog AS avr_gross_profit, {br(div('total_card_owners_checks_qty', 'total_checks_qty'), 2)} AS card_owners_share,
  {br(div('avr_revenue', 'trade_area') + ' * avr_subdiv_share')} AS revenue_per_1m, {br(div(_up, 'total_area'))} AS content_1m, {br(div('trade_area', 'total_area'), 2)} AS trade_area_share,
  {br(div('avr_checks_qty', 'stuff_units'))} AS employee_workload, {br(div('avr_inventory', 'effective_area'))} AS avr_inventory_1m, {br(div('avr_sku_qty', 'effective_area'))} AS sku_per_1m,
  {br(div('distr_stores_cost + avr_transport_cost * avr_subdiv_share', 'avr_cog'), 2)} AS logistic_share,
  CASE WHEN {_sup} THEN {br(_up)} ELSE {br(f'({_up}) * avr_subdiv_share')} END AS area_maintenance,
  {br(div('"Знижка_Маркетинг"', 'total_revenue'), 3)} AS discounts_share, {br(div('"Використання_бонусів"', 'total_revenue'), 3)} AS paid_bonus_share,
  {br(div('"Знижка_Маркетинг" + "Використання_бонусів"', 'total_revenue'), 3)} AS discounts_bonuses_share FROM kpi0"""
_fixed_cost = "avr_total_exp_sum + avr_salary_sum + avr_vat_sum + area_maintenance"
C["kpi2"] = f"""SELECT *, {br(div('avr_gross_profit', 'trade_area'))} AS gmros, {br(div('avr_gross_profit', 'avr_working_hours'))} AS gmrol,
  {br(div('avr_gross_profit', 'avr_inventory') + ' * avr_subdiv_share', 2)} AS gmroi, {br(div('avr_gross_profit', 'avr_revenue'), 3)} AS margin,
  CASE WHEN {_sup} THEN {br(f'{_fixed_cost} + {_log} + avr_revenue * 0.05')} ELSE {br(f'{_fixed_cost} + ({_log}) * avr_subdiv_share + avr_revenue * 0.05')} END AS total_expenses FROM kpi1"""
C["kpi"] = f"""SELECT *, {br(div('net_profit', 'avr_revenue'), 2)} AS profitibility FROM (SELECT *, avr_gross_profit - total_expenses AS net_profit,
  total_expenses - area_maintenance - avr_salary_sum AS other_expenses FROM kpi2) LEFT JOIN (SELECT subdiv_id, trade_category FROM classes) USING (subdiv_id)
  LEFT JOIN (SELECT subdiv_id, {first_match('subdiv_name')} AS subdiv_name FROM subdiv) USING (subdiv_id)"""
_vals = (("n", "count(*)"), ("area", br("sum(trade_area)")), ("gmros", br(div("sum(avr_gross_profit)", "sum(trade_area)"))), ("gmrol", br(div("sum(avr_gross_profit)", "sum(avr_working_hours)"))),
         ("gmroi", br(div("sum(avr_gross_profit)", "sum(avr_inventory * avr_subdiv_share)"), 2)), ("inventory_1m", br("avg(avr_inventory_1m)")), ("sku_1m", br(div("sum(avr_sku_qty)", "sum(effective_area)"))),
         ("workload", br("avg(employee_workload)")), ("check_sum", br(div("sum(total_revenue)", "sum(total_checks_qty)"), 1)), ("check_units", br(div("sum(total_units_qty)", "sum(total_checks_qty)"), 2)),
         ("unit_price", br(div("sum(total_revenue)", "sum(total_units_qty)"), 2)), ("check_sku", br(div("sum(total_sku_in_checks)", "sum(total_checks_qty)"), 2)), ("profit", br(div("sum(net_profit)", "sum(avr_revenue)"), 2)))
_lab = dict(views.CLASS_INDICATORS)
C["category_kpis"] = " UNION ALL ".join(f"SELECT trade_category, {i} AS index_no, '{_lab[k]}' AS index, CAST({v} AS DOUBLE) AS value FROM kpi GROUP BY 1" for i, (k, v) in enumerate(_vals, 1))
C["category_matrix"] = "SELECT index_no, index, " + ", ".join(f"max(value) FILTER (trade_category = '{c}') AS \"{c}\"" for c in ("Міні", "Міді", "Максі", "Супер")) + " FROM category_kpis GROUP BY ALL"


def _long(src: str, cols) -> str:
    rows = " UNION ALL ".join(f"SELECT trade_category, subdiv_name, {i} AS index_no, '{lab}' AS index, CAST({c} AS DOUBLE) AS value FROM {src} WHERE trade_category IS NOT NULL" for i, (c, lab) in enumerate(cols, 1))
    return f"""SELECT *, quantile_cont(value, 0.75) OVER w AS quantile_75, quantile_cont(value, 0.25) OVER w AS quantile_25 FROM ({rows}) WINDOW w AS (PARTITION BY trade_category, index_no)"""


C["store_indicators"] = _long("kpi", views.STORE_INDICATORS)
C["indicator_status"] = """SELECT *, CASE WHEN index_no IN (4, 5, 8, 11, 15, 16, 17, 18, 19, 20, 22) THEN CASE WHEN value > quantile_75 THEN 'good' ELSE 'bad' END
  WHEN index_no IN (2, 14) THEN CASE WHEN value < quantile_25 THEN 'good' ELSE 'bad' END ELSE 'neutral' END AS status FROM store_indicators"""
C["card_long"] = _long("card_stats", views.CARD_INDICATORS)
C["card_indicators"] = "SELECT * EXCLUDE (quantile_25), CASE WHEN index_no IN (1, 3, 4) THEN CASE WHEN value > quantile_75 THEN 'good' ELSE 'bad' END ELSE 'neutral' END AS status FROM card_long"
C["named_structure"] = "SELECT * FROM category_structure LEFT JOIN (SELECT subdiv_id, trade_category FROM classes) USING (subdiv_id) LEFT JOIN (SELECT subdiv_id, subdiv_name FROM subdiv) USING (subdiv_id)"
C["share_matrix"] = "SELECT trade_category, category_name, " + ", ".join(f"coalesce(max(category_checks_share) FILTER (subdiv_name = '{n}'), 0) AS {n}" for n in SUBDIV_NAMES) + " FROM named_structure GROUP BY 1, 2"
_label = f"""coalesce({num_text(br('category_revenue_share * 100'), 0)}, 'NA') || ' %( ' || coalesce({num_text(br('category_inventory_share * 100'), 0)}, 'NA') || ' )'"""
C["share_labels"] = "SELECT trade_category, category_name, " + ", ".join(f"coalesce(max({_label}) FILTER (subdiv_name = '{n}'), '-') AS {n}" for n in SUBDIV_NAMES) + " FROM named_structure GROUP BY 1, 2"


def _quart(p: float, name: str) -> str:
    return "SELECT trade_category, " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {p}) AS {c}" for c in views.BENCHMARK_COLUMNS) + f", g AS revenue_generator, '{name}' AS subdiv_name FROM kpi LEFT JOIN modal m ON m.tc IS NOT DISTINCT FROM trade_category GROUP BY trade_category, g"


C["modal"] = """SELECT trade_category AS tc, regexp_replace(revenue_generator, '^(.*) - .*', '\\1') AS g, count(*) AS n FROM kpi WHERE revenue_generator IS NOT NULL GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY trade_category ORDER BY count(*) DESC, regexp_replace(revenue_generator, '^(.*) - .*', '\\1')) = 1"""
C["q75"] = _quart(0.75, "quantile_75")
C["q25"] = _quart(0.25, "quantile_25")
C["quartiles"] = "SELECT * FROM q75 UNION ALL SELECT * FROM q25"
_bc = ", ".join(views.BENCHMARK_COLUMNS)
C["store_benchmark"] = f"""SELECT subdiv_name AS store, trade_category, {_bc}, revenue_generator, subdiv_name, 1 AS row_no FROM kpi
  UNION ALL SELECT k.subdiv_name, q.trade_category, {', '.join('q.' + c for c in views.BENCHMARK_COLUMNS)}, q.revenue_generator, q.subdiv_name, 2 FROM kpi k JOIN q75 q USING (trade_category)
  UNION ALL SELECT k.subdiv_name, q.trade_category, {', '.join('q.' + c for c in views.BENCHMARK_COLUMNS)}, q.revenue_generator, q.subdiv_name, 3 FROM kpi k JOIN q25 q USING (trade_category)"""


def _thousands(x: str) -> str:
    return f"replace(format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT)), ',', '`')"


C["benchmark_flags"] = f"""SELECT k.subdiv_id, k.trade_category, {_thousands('k.net_profit')} AS net_profit_text, {_thousands('k.avr_gross_profit')} AS gross_profit_text,
  {_thousands('k.total_expenses')} AS expenses_text, {_thousands('k.avr_revenue')} AS revenue_text, {num_text(br('k.margin * 100', 1), 1)} || '%' AS margin_text,
  k.avr_salary_sum, k.stuff_units, k.total_area, k.content_1m, k.other_expenses, k.avr_checks_qty, k.avr_check_sum, k.revenue_generator, k.discounts_share * 100 AS discounts_percent,
  k.paid_bonus_share * 100 AS paid_bonus_percent, k.avr_check_units, k.avr_unit_price, k.avr_ckecks_sku_qty, {num_text(br('k.card_owners_share * 100', 1), 1)} || '%' AS cards_text,
  NOT (k.margin > q.margin) AS margin_below, {', '.join(f'NOT (k.{c} >= q.{c}) AS {c}_below' for c in ('avr_check_sum', 'avr_check_units', 'avr_unit_price', 'avr_ckecks_sku_qty', 'card_owners_share'))}
  FROM kpi k LEFT JOIN q75 q USING (trade_category)"""
_conds = ("k.revenue_per_1m < h.revenue_per_1m AND k.gmros < h.gmros AND k.gmroi < h.gmroi AND k.profitibility < 0", "k.trade_area_share < 0.8", "k.avr_inventory_1m < l.avr_inventory_1m",
          "k.gmroi <= l.gmroi AND k.profitibility > l.profitibility", "k.content_1m > h.content_1m AND k.avr_checks_qty < h.avr_checks_qty AND k.profitibility < l.profitibility",
          "k.logistic_share > h.logistic_share", "k.employee_workload < l.employee_workload AND k.gmrol < l.gmrol", "k.avr_subdiv_share < 0.8", "k.card_owners_share < h.card_owners_share",
          "k.avr_check_sum < h.avr_check_sum AND k.avr_check_units < h.avr_check_units AND k.avr_ckecks_sku_qty < h.avr_ckecks_sku_qty", "k.avr_check_units < h.avr_check_units",
          "k.avr_ckecks_sku_qty < h.avr_ckecks_sku_qty", "k.avr_check_sum < h.avr_check_sum AND k.avr_unit_price < h.avr_unit_price", "k.avr_unit_price < h.avr_unit_price")
_targets = {9: "h.card_owners_share", 11: br("h.avr_check_units * g.check_units_growth", 2), 12: br("h.avr_ckecks_sku_qty * g.check_sku_qty_growth", 2), 14: br("h.avr_unit_price * 1.05", 2)}


def _rule_text(no: int) -> str:
    parts = rules.RULE_TEXTS[no - 1].split("{}")
    if no not in _targets:
        return f"'{parts[0]}'"
    return f"'{parts[0]}' || coalesce({num_text(_targets[no])}, 'NA') || '{parts[1]}'"


C["proposals"] = " UNION ALL ".join(
    f"SELECT k.subdiv_id, k.trade_category, {no} AS rule, {_rule_text(no)} AS proposal FROM kpi k LEFT JOIN q75 h USING (trade_category) LEFT JOIN q25 l USING (trade_category) LEFT JOIN growth g USING (trade_category) WHERE {c}"
    for no, c in enumerate(_conds, 1))

# ---- plain relational -------------------------------------------------------------------------------
C["z_scan_rename"] = "SELECT l_orderkey AS order_ref, l_partkey AS item_ref, l_quantity AS item_qty, l_extendedprice AS item_sum FROM lineitem"
C["z_register_slice"] = f"SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate >= {S3} AND o_orderdate < {FIN}"
C["z_epoch_shift"] = f"SELECT o_orderkey, o_orderdate, o_orderdate + INTERVAL 2000 YEAR AS stored FROM orders WHERE o_orderdate >= {S12} AND o_orderdate < {FIN}"
C["z_period_window"] = """SELECT f AS window_finish, CAST(f - INTERVAL 3 MONTH AS DATE) AS window_start, CAST(f - INTERVAL 12 MONTH AS DATE) AS long_start, count(*) AS n FROM (
  SELECT CAST(CASE WHEN day(o_orderdate) >= 20 THEN date_trunc('month', o_orderdate) ELSE date_trunc('month', o_orderdate) - INTERVAL 1 MONTH END AS DATE) AS f FROM orders) GROUP BY ALL"""
C["z_month_calendar"] = "SELECT CAST(m.date AS DATE) AS date, count(o_orderkey) AS n FROM months_all m LEFT JOIN orders ON date_trunc('month', o_orderdate) = m.date GROUP BY 1"
C["z_filter_in"] = "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1"
C["z_filter_not_in_local"] = "SELECT item_id, store_id, item_store_qty FROM inv_current LEFT JOIN item_root USING (item_id) WHERE coalesce(main_parent NOT IN ('000000003'), true)"
C["z_filter_null"] = "SELECT store_id, parent_ref, distribution_ref FROM store WHERE parent_ref IS NULL OR parent_ref = distribution_ref"
C["z_global_min"] = f"SELECT CAST(od AS DATE) AS first_day, count(*) AS n FROM stops WHERE s % 12 <> 0 AND od = (SELECT min(od) FROM stops WHERE s % 12 <> 0 AND od >= {S3}) GROUP BY 1"
C["z_array_member"] = f"""SELECT {code('c % 12')} AS route_id, CASE WHEN s % 12 <> 0 THEN {code('s_nationkey % 5')} END AS address_region, count(*) AS n FROM stops JOIN supplier ON s_suppkey = s
  WHERE (s % 12 <> 0 AND (c % 12 + s_nationkey % 5) % 2 = 0) OR (s % 12 = 0 AND c % 12 = 11) GROUP BY ALL"""
C["z_sort_multi"] = "SELECT c_mktsegment, c_acctbal, c_custkey FROM customer"
C["z_join_left"] = "SELECT n_name, sum(q) AS qty, count(*) AS suppliers FROM (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey GROUP BY 1"
C["z_join_left_any"] = "SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) = 1"
C["z_join_inner"] = "SELECT c_mktsegment, o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"
C["z_join_full"] = "SELECT k, coalesce(acctbal, 0) AS acctbal, coalesce(supplier_bal, 0) AS supplier_bal FROM (SELECT c_custkey AS k, c_acctbal AS acctbal FROM customer) FULL JOIN (SELECT s_suppkey * 20 AS k, s_acctbal AS supplier_bal FROM supplier) USING (k)"
C["z_join_semi"] = "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1"
C["grp"] = "SELECT DISTINCT p_brand || '/' || p_type AS group_id, p_brand, p_type FROM part"
C["z_join_self_parent"] = """SELECT a.p_brand = 'Brand#25' AS group_marked, a.group_id, a.p_brand AS group_name, b.group_id AS parent_group, CASE WHEN a.p_brand <> 'Brand#13' THEN lower(a.p_type) END AS category_name,
  CASE WHEN a.p_brand <> 'Brand#13' THEN a.p_type END AS category_id FROM grp a LEFT JOIN grp b ON b.group_id = 'Brand#1/' || a.p_type"""
C["z_join_dual_role"] = f"SELECT {code('o_orderkey')} AS nmbr_delivery, f.individ_id AS forwarder, d.individ_id AS driver FROM orders LEFT JOIN person f ON f.ref = o_custkey % 41 LEFT JOIN person d ON d.ref = o_custkey % 37"
C["z_join_polymorphic"] = f"""SELECT CASE l_linenumber % 3 WHEN 0 THEN 'sale' WHEN 1 THEN 'transfer' ELSE CASE WHEN r.ref IS NOT NULL THEN 'check' END END AS document, count(*) AS n, sum(l_quantity) AS qty
  FROM lineitem LEFT JOIN check_report r ON l_linenumber % 3 = 2 AND r.ref = -((l_suppkey % 25) * 100000 + {ym('l_shipdate')}) GROUP BY 1"""
C["z_asof_price"] = """SELECT item_ref, count(*) AS n, count(item_price) AS priced, sum(qty * item_price) AS value FROM (SELECT l_partkey AS item_ref, printf('%09d', l_partkey) AS item_id, CAST(l_shipdate AS DATE) AS d, l_quantity AS qty FROM lineitem) c
  ASOF LEFT JOIN price_day p ON p.item_id = c.item_id AND c.d > p.date_setting GROUP BY 1"""
C["z_agg_sum"] = "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS sum_net, sum(l_quantity) AS strict_qty FROM lineitem GROUP BY 1, 2"
C["z_agg_sum_pair"] = "SELECT s_nationkey AS subdiv_ref, sum(l_extendedprice) + sum(l_extendedprice * l_tax) AS with_vat FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1"
C["z_agg_two_level"] = f"SELECT o_custkey, {br('avg(s)')} AS avr_month, count(*) AS months FROM (SELECT o_custkey, date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2) GROUP BY 1"
C["z_agg_count"] = "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1"
C["z_agg_distinct"] = "SELECT l_suppkey, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1"
C["z_agg_distinct_pair"] = "SELECT l_suppkey, count(DISTINCT (l_partkey, l_linenumber)) AS pairs FROM lineitem GROUP BY 1"
C["z_agg_conditional"] = "SELECT l_suppkey, count(*) FILTER (l_discount > 0.05) AS discounted, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1"
C["z_agg_minmax"] = "SELECT l_partkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, min(l_quantity) AS min_qty, max(l_quantity) AS max_qty FROM lineitem GROUP BY 1"
C["z_set_distinct"] = "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem"
C["z_first_non_null"] = """SELECT employee_ref, first_position, count(*) AS n, count(p) AS known FROM (SELECT user_id AS employee_ref, p,
  first_value(p) OVER (PARTITION BY user_id ORDER BY p IS NULL, s NULLS LAST, p) AS first_position
  FROM (SELECT user_id, CASE WHEN value * 100 > 5000 THEN event_type END AS p, CASE WHEN event_id % 10 <> 0 THEN user_id % 25 END AS s FROM events)) GROUP BY 1, 2"""
C["z_mode_generator"] = "SELECT p_brand, p_type AS generator FROM part GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) = 1"
C["z_win_share"] = f"SELECT l_suppkey, l_returnflag, qty, {br('qty / sum(qty) OVER (PARTITION BY l_suppkey)', 3)} AS share FROM (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2)"
C["z_win_share_global"] = f"SELECT l_suppkey, qty, {br('qty / sum(qty) OVER ()', 4)} AS share FROM (SELECT l_suppkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1)"
C["z_win_cumsum"] = "SELECT l_suppkey, month, qty, sum(qty) OVER (PARTITION BY l_suppkey ORDER BY month DESC) AS running FROM (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2)"
C["z_latest_per_key"] = "SELECT pay_ts AS date_rec, user_id AS individ_ref, user_id % 25 AS subdiv_ref, event_type AS position_ref FROM ev QUALIFY pay_ts = max(pay_ts) OVER (PARTITION BY user_id)"
C["z_union_by_name"] = "SELECT o_custkey AS k, sum(o_totalprice) AS sales, CAST(NULL AS DOUBLE) AS balance FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer"
C["z_pivot_wide"] = "SELECT l_suppkey, " + ", ".join(f"sum(l_quantity) FILTER (l_returnflag = '{c}') AS {c}" for c in "ANR") + " FROM lineitem GROUP BY 1"
C["z_unpivot_long"] = "SELECT l_suppkey, 1 AS index_no, 'quantity' AS index, sum(l_quantity) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, 2, 'sum', sum(l_extendedprice) FROM lineitem GROUP BY 1"
C["z_stop_explode"] = f"SELECT pos, stop, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY k ORDER BY s) - 1 AS pos, {code('s')} AS stop FROM stops) GROUP BY 1, 2"
_raw_name = "CASE c_custkey % 3 WHEN 0 THEN 'ТоргівельнийЦентр Роздріб ' WHEN 1 THEN 'роздріб роздріб ' ELSE 'Кам''янець-Подільський |оздріб ' END || c_name"
C["z_clean_name"] = f"SELECT c_custkey, {first_match(_raw_name)} AS name FROM customer"
C["z_ref_items"] = f"""SELECT i.item_id, i.item_name, 'PG ' || i.pg AS price_group, i.group_id, i.pack_qty, i.p_size % 2 = 0 AS is_tva, i.p_size = 50 AS item_marked, p.item_id AS parent_item_id,
  i.p_size AS width, i.p_size * 2 AS height, i.p_size + 1 AS depth, i.p_retailprice / 100 AS weight, i.p_size / 10.0::DOUBLE AS volume FROM item i LEFT JOIN item p ON p.ref = i.parent_ref"""
C["z_ref_category"] = "SELECT DISTINCT p_type AS category_id, CASE WHEN p_type = 'MEDIUM' THEN '16. Лайфстайл' ELSE lower(p_type) END AS category_name, p_type = 'PROMO' AS is_marked FROM part"
C["z_ref_store"] = """SELECT s.store_id, p.store_id AS parent_id, s.marked, d.store_id AS distribution_store, s.subdiv_id, a.locality_id, a.region_id, a.lat, a.long, s.store_name, s.store_location
  FROM store s LEFT JOIN store p ON p.ref = s.parent_ref LEFT JOIN store d ON d.ref = s.distribution_ref LEFT JOIN (SELECT * FROM address WHERE NOT marked AND is_main) a ON a.owner_ref = s.ref"""
C["z_ref_subdiv"] = f"SELECT a.subdiv_id, a.subdiv_name, b.subdiv_id AS parent, {code('a.store_ref')} AS store_id, a.marked FROM subdiv a LEFT JOIN subdiv b ON b.ref = a.parent_ref"
C["z_nest_regions"] = f"""SELECT {code('r')} AS route_id, 'route ' || r AS route, {code('r % 3')} AS route_parent, {code('r')} AS subdiv_id, len(g) AS n_regions, array_to_string(g, ',') AS regions FROM (
  SELECT r, list_concat(CASE WHEN r = 11 THEN ['-'] ELSE [] END, list_transform(list_filter([0, 1, 2, 3, 4], lambda x: (r + x) % 2 = 0), lambda x: printf('%09d', x))) AS g FROM (SELECT DISTINCT c_custkey % 12 AS r FROM customer))"""
C["z_ref_vehicle"] = f"""SELECT {code('v')} AS auto_id, 'auto ' || v AS auto_name, v = 18 AS marked, {code('v % 25')} AS subdiv_id, s.store_id, v % 4 <> 3 AS is_cargo, v * 100.0 AS load_capacity, v * 2.0 AS volume, v + 40.0 AS tank
  FROM (SELECT DISTINCT c_custkey % 20 AS v FROM customer WHERE c_custkey % 20 <> 19) LEFT JOIN store s ON s.ref = v % 5"""

# query -> step, where the names differ
STEP = {
    "sale_check_category": "check_cat", "service_profit": "service", "sale_store": "sale_store_basket", "sale_store_zero_cost": "sale_store0",
    "quarter_growth": "growth", "topk_category": "generator", "expense_rows": "exp_rows", "utilities_mean": "utilities", "rent_max": "rent",
    "salary_union": "salary_all", "vat_allocate": "vat_store", "truck_cost_km": "truck_cost", "transport_store": "transport", "schedule_latest": "schedule",
    "inv_rollback": "rollback", "inv_batch_rollback": "batch_rollback", "inv_lifo_value": "lifo", "inv_snapshots": "inv_category_t",
    "sale_report_laid_out": "sale_report", "sale_structure_laid_out": "sale_structure", "new_cards_kept": "new_cards",
    "inv_rollback_kept": "rollback", "inv_batch_rollback_kept": "batch_rollback",
    "store_kpis": "kpi", "eav_lookup": "subdiv_cat", "filter_not_in_sql": "open_stores",
}
# the SELECT list of a query, where it is not every column of the step
COLUMNS = {"price_history": "item_id, date_setting, item_price", "stores_of_class": "trade_category, subdiv_name"}
STEP["stores_of_class"] = "kpi"
# the driver tables without rows, to learn the column types of a statement
SCHEMA = """
CREATE TABLE region(r_regionkey INTEGER, r_name VARCHAR);
CREATE TABLE nation(n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER);
CREATE TABLE customer(c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR);
CREATE TABLE supplier(s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE);
CREATE TABLE part(p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER, p_retailprice DOUBLE);
CREATE TABLE orders(o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR);
CREATE TABLE lineitem(l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE,
  l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP);
CREATE TABLE events(event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR);
"""
_NEEDED = re.compile(r"(?:FROM|JOIN|,)\s+\(*([a-z_][a-z0-9_]*)\b")


def _collect(sql: str, seen: dict[str, None]) -> None:
    for name in _NEEDED.findall(sql):
        if name in CTES and name not in seen:
            _collect(CTES[name], seen)
            seen[name] = None


def statement(query: str) -> str | None:
    """Statement of a query with its values as computed."""
    step = STEP.get(query) or (query if query in CTES else f"z_{query}")
    if step not in CTES:
        return None
    seen: dict[str, None] = {}
    _collect(f"SELECT * FROM {step}", seen)
    ctes = ",\n".join(f"{n} AS ({CTES[n]})" for n in seen)
    return f"WITH {ctes}\nSELECT {COLUMNS.get(query, '*')} FROM {step}"


def _comparable(name: str, kind: str) -> str:
    c = f'"{name}"'
    if kind.startswith(("DOUBLE", "FLOAT", "DECIMAL")):
        return f"CAST(round(CAST({c} AS DECIMAL(38, 7)), 4) AS DOUBLE) + 0 AS {c}"
    if kind == "DATE":
        return f"strftime({c}, '%Y-%m-%d') AS {c}"
    if kind.startswith("TIMESTAMP"):
        return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"
    if kind in ("TINYINT", "SMALLINT", "INTEGER", "HUGEINT", "UBIGINT"):
        return f"CAST({c} AS BIGINT) AS {c}"
    return c


def oracles(names) -> dict[str, str]:
    """Statement per query in comparable form: doubles to four digits, times as text."""
    import duckdb

    con = duckdb.connect()
    con.execute(SCHEMA)
    out = {}
    for name in names:
        sql = statement(name)
        if sql is None:
            continue
        types = con.execute(f"DESCRIBE {sql}").fetchall()
        cols = ", ".join(_comparable(r[0], r[1]) for r in types)
        out[name] = f"SELECT {cols} FROM ({sql})"
    return out

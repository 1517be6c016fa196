"""The store KPI table: one row per subdivision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DISCOUNT_MARKETING, DISCOUNT_SPENT, NAME_CLEANING, Settings
from ..functions.semantics import bankers_round, clean_name, safe_div
from ..operators.loyalty import discount_subdiv
from ..operators.sales import basket_figures


def _zero_fill(df: DataFrame) -> DataFrame:
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.fillna(0, subset=numeric)


def kpi_inputs(sales: DataFrame, areas: DataFrame, inventory: DataFrame, costs: DataFrame,
               shipment: DataFrame, warehouse: DataFrame, transport: DataFrame, vat: DataFrame,
               discounts: DataFrame, generator: DataFrame, categories: DataFrame) -> DataFrame:
    """The input columns side by side; every right side has one row per subdivision."""
    retail = shipment.filter(F.col("type_subdiv") == "retail").select("subdiv_id", "avr_subdiv_share")
    carried = transport.groupBy("subdiv_id").agg(F.sum("avr_transport_cost").alias("avr_transport_cost"))
    df = sales
    for right in (areas, inventory, costs, retail, warehouse, carried, vat,
                  discount_subdiv(discounts), generator, categories):
        df = df.join(right, "subdiv_id", "left")
    return _zero_fill(df)


def kpi_formulas(df: DataFrame, cfg: Settings) -> DataFrame:
    """Derived columns in dependency order, one projection per level."""
    c = F.col
    r = lambda x, n=0: bankers_round(x, n)
    ratio = lambda a, b, n=0: r(safe_div(a, b), n)
    is_super = F.coalesce(c("subdiv_category") == cfg.supermarket_b2c, F.lit(False))
    share = c("avr_subdiv_share")
    upkeep = c("avr_rent_sum") + c("utilities_exp_sum")
    logistics = c("distr_stores_cost") + c("avr_transport_cost")

    df = basket_figures(df).withColumns({
        "avr_gross_profit": c("avr_revenue") - c("avr_cog"),
        "card_owners_share": ratio(c("total_card_owners_checks_qty"), c("total_checks_qty"), 2),
        "revenue_per_1m": r(safe_div(c("avr_revenue"), c("trade_area")) * share),
        "content_1m": ratio(upkeep, c("total_area")),
        "trade_area_share": ratio(c("trade_area"), c("total_area"), 2),
        "employee_workload": ratio(c("avr_checks_qty"), c("stuff_units")),
        "avr_inventory_1m": ratio(c("avr_inventory"), c("effective_area")),
        "sku_per_1m": ratio(c("avr_sku_qty"), c("effective_area")),
        "logistic_share": ratio(c("distr_stores_cost") + c("avr_transport_cost") * share, c("avr_cog"), 2),
        "area_maintenance": F.when(is_super, r(upkeep)).otherwise(r(upkeep * share)),
        "discounts_share": ratio(c(DISCOUNT_MARKETING), c("total_revenue"), 3),
        "paid_bonus_share": ratio(c(DISCOUNT_SPENT), c("total_revenue"), 3),
        "discounts_bonuses_share": ratio(c(DISCOUNT_MARKETING) + c(DISCOUNT_SPENT), c("total_revenue"), 3)})
    fixed = c("avr_total_exp_sum") + c("avr_salary_sum") + c("avr_vat_sum") + c("area_maintenance")
    overhead = c("avr_revenue") * cfg.overhead_rate
    df = df.withColumns({
        "gmros": ratio(c("avr_gross_profit"), c("trade_area")),
        "gmrol": ratio(c("avr_gross_profit"), c("avr_working_hours")),
        "gmroi": r(safe_div(c("avr_gross_profit"), c("avr_inventory")) * share, 2),
        "margin": ratio(c("avr_gross_profit"), c("avr_revenue"), 3),
        "total_expenses": r(fixed + F.when(is_super, logistics).otherwise(logistics * share) + overhead)})
    df = df.withColumns({
        "net_profit": c("avr_gross_profit") - c("total_expenses"),
        "other_expenses": c("total_expenses") - c("area_maintenance") - c("avr_salary_sum")})
    return df.withColumn("profitibility", ratio(c("net_profit"), c("avr_revenue"), 2))


def store_kpis(inputs: DataFrame, classes: DataFrame, subdivs: DataFrame, cfg: Settings) -> DataFrame:
    """KPI table with class and cleaned name."""
    name = clean_name(F.col("subdiv_name"), NAME_CLEANING)
    return (kpi_formulas(inputs, cfg)
            .join(classes.select("subdiv_id", "trade_category"), "subdiv_id", "left")
            .join(subdivs.select("subdiv_id", "subdiv_name"), "subdiv_id", "left")
            .withColumn("subdiv_name", name))

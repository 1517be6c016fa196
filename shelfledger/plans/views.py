"""Class and store views on the result tables.

They work on one row per store, so groups and quantiles are bounded by the number
of stores. Long form is the main output; wide forms take an explicit column list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import NAME_CLEANING, TRADE_CATEGORIES
from ..functions.semantics import (bankers_round, clean_name, most_common, number_text, percent_text,
                                   safe_div, thousands_text)
from ..operators.relational import transpose_long

# Shown labels and their order.
CLASS_INDICATORS = (
    ("n", "Кількість магазинів"), ("area", "Загальна торгова площа"), ("gmros", "GMROS"),
    ("gmrol", "GMROL"), ("gmroi", "GMROI"), ("inventory_1m", "Залишки на 1м"),
    ("sku_1m", "SKU на 1м"), ("workload", "Навантаження на працівника"),
    ("check_sum", "Середня сума чеку"), ("check_units", "Од-ць у чеку"),
    ("unit_price", "Ціна од-ці"), ("check_sku", "Кіл-ть SKU у чеку"),
    ("profit", "Рентабельність прибутку"),
)
STORE_INDICATORS = (
    ("total_area", "Загальна площа"), ("content_1m", "Утримання 1м2"),
    ("trade_area_share", "Частка торг.площі"), ("revenue_per_1m", "Виручка з 1м2"),
    ("gmros", "GMROS"), ("stuff_units", "Кіл-ть персоналу"),
    ("employee_workload", "Завант.персоналу"), ("gmrol", "GMROL"),
    ("avr_inventory", "Сума залишків"), ("avr_inventory_1m", "Залишки на 1м2"),
    ("gmroi", "CMROI"), ("avr_sku_qty", "Кіл-ть SKU"), ("sku_per_1m", "SKU на 1м"),
    ("logistic_share", "Частка логіст.витрат"), ("avr_checks_qty", "Кіл-ть чеків"),
    ("card_owners_share", "Частка власн.карт."), ("avr_check_sum", "Сума чеку"),
    ("avr_check_units", "Од-ць у чеку"), ("avr_unit_price", "Ціна од-ці"),
    ("avr_ckecks_sku_qty", "Кіл-ть SKU у чеку"),
    ("discounts_bonuses_share", "Частка знижок та бонусів"),
    ("profitibility", "Рентабельність прибутку"),
)
HIGH_IS_GOOD = (4, 5, 8, 11, 15, 16, 17, 18, 19, 20, 22)
LOW_IS_GOOD = (2, 14)
CARD_INDICATORS = (
    ("card_owners_share", "Частка власн.карток"), ("total_purch", "Загальна кіль-ть"),
    ("purch_more_1_share", "Частка >1 покупки"), ("new_cards", "Кіл-ть нових"),
)
CARD_HIGH_IS_GOOD = (1, 3, 4)
BENCHMARK_COLUMNS = (
    "profitibility", "net_profit", "avr_gross_profit", "avr_salary_sum", "stuff_units",
    "employee_workload", "gmrol", "area_maintenance", "total_area", "content_1m",
    "avr_subdiv_share", "total_expenses", "other_expenses", "logistic_share", "margin",
    "discounts_share", "paid_bonus_share", "avr_revenue", "revenue_per_1m", "gmros",
    "trade_area_share", "avr_checks_qty", "avr_check_sum", "avr_check_units", "avr_unit_price",
    "avr_ckecks_sku_qty", "card_owners_share", "avr_inventory_1m", "gmroi",
)


def stores_of_class(kpis: DataFrame, trade_category: str | None = None) -> DataFrame:
    df = kpis if trade_category is None else kpis.filter(F.col("trade_category") == trade_category)
    return df.select("trade_category", "subdiv_name")


def category_kpis(kpis: DataFrame) -> DataFrame:
    """Thirteen indicators per class, long form."""
    s = lambda name: F.sum(name)
    ratio = lambda a, b, n=0: bankers_round(safe_div(a, b), n)
    df = kpis.groupBy("trade_category").agg(
        F.count(F.lit(1)).alias("n"), bankers_round(s("trade_area")).alias("area"),
        ratio(s("avr_gross_profit"), s("trade_area")).alias("gmros"),
        ratio(s("avr_gross_profit"), s("avr_working_hours")).alias("gmrol"),
        ratio(s("avr_gross_profit"), F.sum(F.col("avr_inventory") * F.col("avr_subdiv_share")), 2).alias("gmroi"),
        bankers_round(F.avg("avr_inventory_1m")).alias("inventory_1m"),
        ratio(s("avr_sku_qty"), s("effective_area")).alias("sku_1m"),
        bankers_round(F.avg("employee_workload")).alias("workload"),
        ratio(s("total_revenue"), s("total_checks_qty"), 1).alias("check_sum"),
        ratio(s("total_units_qty"), s("total_checks_qty"), 2).alias("check_units"),
        ratio(s("total_revenue"), s("total_units_qty"), 2).alias("unit_price"),
        ratio(s("total_sku_in_checks"), s("total_checks_qty"), 2).alias("check_sku"),
        ratio(s("net_profit"), s("avr_revenue"), 2).alias("profit"))
    return transpose_long(df, ["trade_category"], CLASS_INDICATORS)


def category_matrix(long: DataFrame, classes: Sequence[str] = TRADE_CATEGORIES) -> DataFrame:
    """Indicators as rows, classes as columns."""
    return long.groupBy("index_no", "index").pivot("trade_category", list(classes)).agg(F.max("value"))


def _with_quartiles(long: DataFrame) -> DataFrame:
    key = ["trade_category", "index_no"]
    q = long.groupBy(*key).agg(F.percentile("value", F.lit(0.75)).alias("quantile_75"),
                               F.percentile("value", F.lit(0.25)).alias("quantile_25"))
    return long.join(q, key)


def store_indicators(kpis: DataFrame) -> DataFrame:
    """Twenty-two indicators per store with their quartiles over the stores of the class."""
    long = transpose_long(kpis.filter(F.col("trade_category").isNotNull()),
                          ["trade_category", "subdiv_name"], STORE_INDICATORS)
    return _with_quartiles(long)


def _status(high: Sequence[int], low: Sequence[int]) -> Column:
    no, v = F.col("index_no"), F.col("value")
    good = lambda cond: F.when(cond, "good").otherwise("bad")
    out = F.when(no.isin(list(high)), good(v > F.col("quantile_75")))
    if low:
        out = out.when(no.isin(list(low)), good(v < F.col("quantile_25")))
    return out.otherwise("neutral")


def indicator_status(indicators: DataFrame) -> DataFrame:
    return indicators.withColumn("status", _status(HIGH_IS_GOOD, LOW_IS_GOOD))


def card_indicators(cards: DataFrame) -> DataFrame:
    long = transpose_long(cards.filter(F.col("trade_category").isNotNull()),
                          ["trade_category", "subdiv_name"], CARD_INDICATORS)
    return _with_quartiles(long).drop("quantile_25").withColumn("status", _status(CARD_HIGH_IS_GOOD, ()))


def _named_structure(structure: DataFrame, classes: DataFrame, subdivs: DataFrame,
                     trade_category: str | None) -> DataFrame:
    df = (structure.join(classes.select("subdiv_id", "trade_category"), "subdiv_id", "left")
          .join(subdivs.select("subdiv_id", "subdiv_name"), "subdiv_id", "left")
          .withColumn("subdiv_name", clean_name(F.col("subdiv_name"), NAME_CLEANING)))
    return df if trade_category is None else df.filter(F.col("trade_category") == trade_category)


def share_matrix(structure: DataFrame, classes: DataFrame, subdivs: DataFrame, names: Sequence[str],
                 trade_category: str | None = None) -> DataFrame:
    """Share of checks: categories as rows, the named stores as columns, absent 0."""
    df = _named_structure(structure, classes, subdivs, trade_category)
    return (df.groupBy("trade_category", "category_name").pivot("subdiv_name", list(names))
            .agg(F.max("category_checks_share")).fillna(0.0, subset=list(names)))


def share_labels(structure: DataFrame, classes: DataFrame, subdivs: DataFrame, names: Sequence[str],
                 trade_category: str | None = None) -> DataFrame:
    """Revenue share with inventory share as text: categories by stores, absent '-'."""
    part = lambda c: F.coalesce(number_text(bankers_round(F.col(c) * 100), 0), F.lit("NA"))
    label = F.concat_ws(" ", part("category_revenue_share"), F.lit("%("),
                        part("category_inventory_share"), F.lit(")"))
    df = _named_structure(structure, classes, subdivs, trade_category).withColumn("label", label)
    return (df.groupBy("trade_category", "category_name").pivot("subdiv_name", list(names))
            .agg(F.max("label")).fillna("-", subset=list(names)))


def generator_name(c: Column) -> Column:
    """Category part of a 'name - share%' label; a text without the mark stays whole."""
    return F.regexp_replace(c, "^(.*) - .*", "$1")


def quartiles(kpis: DataFrame, p: float) -> DataFrame:
    """Class benchmark: the given quantile of each column and the most common generator."""
    return kpis.groupBy("trade_category").agg(
        *[F.percentile(c, F.lit(p)).alias(c) for c in BENCHMARK_COLUMNS],
        most_common(generator_name(F.col("revenue_generator"))).alias("revenue_generator")
    ).withColumn("subdiv_name", F.lit(f"quantile_{round(p * 100)}"))


def store_benchmark(kpis: DataFrame, q75: DataFrame, q25: DataFrame,
                    subdiv_name: str | None = None) -> DataFrame:
    """Each store (or the named one) against its class: rows 1 store, 2 upper, 3 lower quartile."""
    own = kpis if subdiv_name is None else kpis.filter(F.col("subdiv_name") == subdiv_name)
    cols = ["trade_category", *BENCHMARK_COLUMNS, "revenue_generator", "subdiv_name"]
    own = own.select(F.col("subdiv_name").alias("store"), *cols)
    keys = own.select("store", "trade_category")
    rows = own.withColumn("row_no", F.lit(1))
    for i, q in ((2, q75), (3, q25)):
        rows = rows.unionByName(keys.join(q.select(*cols), "trade_category").withColumn("row_no", F.lit(i)))
    return rows


def with_benchmarks(kpis: DataFrame, q75: DataFrame, q25: DataFrame) -> DataFrame:
    """Stores with their class quartiles as columns ``q75_*`` and ``q25_*``."""
    for name, q in (("q75", q75), ("q25", q25)):
        wide = q.select("trade_category", *[F.col(c).alias(f"{name}_{c}") for c in BENCHMARK_COLUMNS])
        kpis = kpis.join(wide, "trade_category", "left")
    return kpis


def benchmark_flags(kpis: DataFrame, q75: DataFrame, q25: DataFrame) -> DataFrame:
    """Values of the profit driver tree and six below-benchmark flags per store."""
    df = with_benchmarks(kpis, q75, q25)
    c = F.col
    below = {"margin_below": ~(c("margin") > c("q75_margin"))}
    for col in ("avr_check_sum", "avr_check_units", "avr_unit_price", "avr_ckecks_sku_qty",
                "card_owners_share"):
        below[f"{col}_below"] = ~(c(col) >= c(f"q75_{col}"))
    return df.select(
        "subdiv_id", "trade_category", thousands_text(c("net_profit")).alias("net_profit_text"),
        thousands_text(c("avr_gross_profit")).alias("gross_profit_text"),
        thousands_text(c("total_expenses")).alias("expenses_text"),
        thousands_text(c("avr_revenue")).alias("revenue_text"),
        percent_text(c("margin")).alias("margin_text"), "avr_salary_sum", "stuff_units", "total_area",
        "content_1m", "other_expenses", "avr_checks_qty", "avr_check_sum", "revenue_generator",
        (c("discounts_share") * 100).alias("discounts_percent"),
        (c("paid_bonus_share") * 100).alias("paid_bonus_percent"), "avr_check_units",
        "avr_unit_price", "avr_ckecks_sku_qty", percent_text(c("card_owners_share")).alias("cards_text"),
        *[v.alias(k) for k, v in below.items()])

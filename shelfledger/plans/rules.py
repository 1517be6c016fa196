"""The fourteen recommendation rules, for all stores at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.semantics import bankers_round, number_text
from .views import with_benchmarks

# The texts shown to the user, in rule order.
RULE_TEXTS = (
    "Низьки показники - розглянути можливість зменшення торгівельної площі",
    "Визначити причину низької частки торгівельної площі",
    "Низькі залишки - переглянути схему розміщення торг.обладнання",
    "Низький GMROI - оптимізувати асортимент магазину",
    "Невідповідність витрат на утримання потоку покупців - залучити більше покупців",
    "Значна частка логістичгих витрат - переглянути логістичну схему підрозділу",
    "Низькі навантаженність та GMROL - розглянути можливість зменшення персоналу",
    "Значна частка В2В відвантажень - розглянути можливість не викладати В2В-асортимент на полиці",
    "Визначити причину низької частки бонусних карток та збільшити її (ціл.зн-ня {})",
    "Покращити роботу персоналу магазину по роботі з покупцями (cross-sell - продаж супутніх товарів)",
    "Збільшити кількість одиниць у чеку до {}",
    "Збільшити кількість SKU у чеку до {}",
    "Покращити роботу персоналу магазину по роботі з покупцями (upsell - продаж якісніших товарів)",
    "Збільшити ціну одиниці у чеку до {}",
)


def proposals(kpis: DataFrame, q75: DataFrame, q25: DataFrame, growth: DataFrame,
              cfg: Settings) -> DataFrame:
    """Rules that fire, one row per store and rule; an unknown condition does not fire."""
    df = with_benchmarks(kpis, q75, q25).join(growth, "trade_category", "left")
    own = F.col
    hi = lambda c: F.col(f"q75_{c}")
    lo = lambda c: F.col(f"q25_{c}")
    below = lambda c: own(c) < hi(c)
    conditions = (
        below("revenue_per_1m") & below("gmros") & below("gmroi") & (own("profitibility") < 0),
        own("trade_area_share") < cfg.share_threshold,
        own("avr_inventory_1m") < lo("avr_inventory_1m"),
        (own("gmroi") <= lo("gmroi")) & (own("profitibility") > lo("profitibility")),
        (own("content_1m") > hi("content_1m")) & below("avr_checks_qty")
        & (own("profitibility") < lo("profitibility")),
        own("logistic_share") > hi("logistic_share"),
        (own("employee_workload") < lo("employee_workload")) & (own("gmrol") < lo("gmrol")),
        own("avr_subdiv_share") < cfg.share_threshold,
        below("card_owners_share"),
        below("avr_check_sum") & below("avr_check_units") & below("avr_ckecks_sku_qty"),
        below("avr_check_units"),
        below("avr_ckecks_sku_qty"),
        below("avr_check_sum") & below("avr_unit_price"),
        below("avr_unit_price"),
    )
    targets = {
        9: hi("card_owners_share"),
        11: bankers_round(hi("avr_check_units") * own("check_units_growth"), 2),
        12: bankers_round(hi("avr_ckecks_sku_qty") * own("check_sku_qty_growth"), 2),
        14: bankers_round(hi("avr_unit_price") * cfg.price_growth, 2),
    }
    rules = []
    for no, (text, cond) in enumerate(zip(RULE_TEXTS, conditions, strict=True), 1):
        name = F.lit(text)
        if no in targets:
            before, after = text.split("{}")
            name = F.concat(F.lit(before), F.coalesce(number_text(targets[no]), F.lit("NA")), F.lit(after))
        rules.append(F.struct(F.lit(no).alias("rule"), name.alias("proposal"), cond.alias("fires")))
    return (df.select("subdiv_id", "trade_category", F.explode(F.array(*rules)).alias("_r"))
            .filter("_r.fires").select("subdiv_id", "trade_category", "_r.rule", "_r.proposal"))

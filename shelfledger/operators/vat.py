"""Ledger balances at month ends and the VAT carried by each store."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.periods import add_months, month_floor
from ..functions.semantics import bankers_round, r_ifelse, r_sum, remap, safe_div
from ..sources.readers import Tables, time_bound
from .relational import union_by_name


def account_balance(t: Tables, months: list[date], cfg: Settings) -> DataFrame:
    """Debit minus credit of the account up to each month's end.

    One pass over the ledger: every month is a conditional sum, so entries are
    neither repeated per month nor shuffled before they are added up.
    """
    org = t["organization_dim"].filter(F.col("organization_id") == cfg.main_organization)
    acc = t["account_dim"].filter(F.col("acc_id") == cfg.vat_account)
    led = (t.register("ledger", "date", None, add_months(months[-1], 1), ["active"])
           .join(org.select(F.col("ref").alias("organization_ref")), "organization_ref", "left_semi")
           .join(acc.select(F.col("ref").alias("account_dt_ref"), F.lit(True).alias("is_dt")),
                 "account_dt_ref", "left")
           .join(acc.select(F.col("ref").alias("account_ct_ref"), F.lit(True).alias("is_ct")),
                 "account_ct_ref", "left"))
    sums = []
    for i, m in enumerate(months):
        before = F.col("date") < time_bound(led, "date", add_months(m, 1))
        sums.append(F.sum(F.when(before & F.col("is_dt"), F.col("moving_sum"))).alias(f"dt{i}"))
        sums.append(F.sum(F.when(before & F.col("is_ct"), F.col("moving_sum"))).alias(f"ct{i}"))
    rows = F.explode(F.array(*[
        F.struct(F.lit(m).alias("date"), F.col(f"dt{i}").alias("debit"), F.col(f"ct{i}").alias("credit"))
        for i, m in enumerate(months)]))
    return led.agg(*sums).select(rows.alias("_r")).select(
        "_r.date", "_r.debit", "_r.credit",
        (F.col("_r.debit") - F.col("_r.credit")).alias("balance"))


def vat_months(balance: DataFrame) -> DataFrame:
    b = F.col("balance")
    return balance.select("date", r_ifelse(b < 0, -bankers_round(b), F.lit(0.0)).alias("vat_sum"))


def vat_allocate(sales: DataFrame, service: DataFrame, balance: DataFrame, finish: date,
                 cfg: Settings) -> DataFrame:
    """Each month's VAT payable split by gross profit; mean per store over the months."""
    retail = (sales.filter((F.col("date") >= F.lit(add_months(finish, -cfg.months_back)))
                           & (F.col("organization_id") == cfg.main_organization))
              .groupBy("date", "subdiv_id")
              .agg(r_sum(F.col("checks_report_sum") - F.col("doc_cost_sum")).alias("retail_gp")))
    serv = (service.filter(F.col("organization_id") == cfg.main_organization)
            .withColumn("date", month_floor(F.col("sale_doc_date")))
            .withColumn("subdiv_id", remap(F.col("subdiv_id"), cfg.service_subdiv_merge))
            .groupBy("date", "subdiv_id").agg(r_sum(F.col("gross_profit")).alias("service_gp")))
    total = union_by_name(retail, serv).groupBy("date").agg(
        (F.coalesce(F.sum("retail_gp"), F.lit(0.0)) + F.coalesce(F.sum("service_gp"), F.lit(0.0))
         ).alias("total_gp"))
    part = safe_div(F.col("retail_gp"), F.col("total_gp")) * F.col("vat_sum")
    return (retail.filter(F.col("retail_gp").isNotNull()).join(total, "date")
            .join(vat_months(balance), "date", "left")
            .groupBy("subdiv_id").agg(bankers_round(F.avg(part)).alias("avr_vat_sum")))

"""Expense rows, their cleaning, and the direct cost table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (FUEL_EXPENSE, MAINTENANCE_EXPENSES, NON_DIRECT_EXPENSES, DROPPED_EXPENSES,
                      RENT_EXPENSE, SUPPORT_EXPENSE, UTILITY_EXPENSES, Settings)
from ..functions.periods import add_months, month_floor
from ..functions.semantics import bankers_round, not_in_local, r_sum, remap, sign_by_kind
from ..sources.readers import Tables
from .refs import decode, ref_expense
from .relational import join_null_safe, union_by_name


def expense_rows(t: Tables, start: date, finish: date, cfg: Settings) -> DataFrame:
    df = t.register("expense_register", "date", start, finish, ["active"])
    df = decode(df, "exp_item_ref", t["expense_item"], exp_items_id="id", exp_items_name="name")
    df = df.filter(F.col("exp_items_id") != cfg.excluded_expense_id)
    df = decode(df, "subdiv_ref", t["subdiv_dim"], "subdiv_id")
    df = decode(df, "project_ref", t["project_dim"], "project")
    return df.select("date", "exp_items_id", "exp_items_name", "subdiv_id", "project",
                     "type_exp", "exp_sum", "exp_vat")


def expense_clean(rows: DataFrame, t: Tables, cfg: Settings) -> DataFrame:
    """Signed sums with VAT, dated to the month, under their top item, ids folded."""
    tree = ref_expense(t)
    df = (rows.withColumn("date", month_floor(F.col("date")))
          .withColumn("subdiv_id", remap(F.col("subdiv_id"), cfg.subdiv_merge))
          .withColumn("exp_sum", sign_by_kind(F.col("type_exp"), F.col("exp_sum") + F.col("exp_vat")))
          .drop("exp_vat", "type_exp"))
    df = join_null_safe(df, tree.select("exp_items_id", "exp_items_name", "exp_items_parent"),
                        ["exp_items_id", "exp_items_name"])
    df = join_null_safe(df, tree.select(F.col("exp_items_name").alias("exp_items_parent"),
                                        F.col("exp_items_parent").alias("parent_2")),
                        ["exp_items_parent"])
    head = {code: cfg.head_office_target for code in cfg.head_office}
    subdiv = remap(remap(F.col("subdiv_id"), head), cfg.expense_subdiv_merge)
    return (df.withColumn("expenses_item", F.coalesce("parent_2", "exp_items_parent"))
            .filter(not_in_local(F.col("expenses_item"), DROPPED_EXPENSES))
            .withColumn("subdiv_id", subdiv))


def expense_months(t: Tables, start: date, finish: date, cfg: Settings) -> DataFrame:
    """Cleaned expenses per month, subdivision and top item.

    The register is summed on its references in the scan's tasks first; the item
    tree and the id folding then touch a handful of rows per month.
    """
    reg = t.register("expense_register", "date", start, finish, ["active"])
    pre = (reg.groupBy(F.date_trunc("month", "date").alias("date"), "type_exp", "subdiv_ref",
                       "exp_item_ref")
           .agg(r_sum(F.col("exp_sum") + F.col("exp_vat")).alias("exp_sum")))
    pre = decode(pre, "exp_item_ref", t["expense_item"], exp_items_id="id", exp_items_name="name")
    pre = pre.filter(F.col("exp_items_id") != cfg.excluded_expense_id)
    pre = decode(pre, "subdiv_ref", t["subdiv_dim"], "subdiv_id")
    clean = expense_clean(pre.withColumn("exp_vat", F.lit(0.0)), t, cfg)
    return clean.groupBy("date", "subdiv_id", "expenses_item").agg(
        r_sum(F.col("exp_sum")).alias("exp_sum"), F.sum("exp_sum").alias("exp_sum_known"))


def _recent(exp: DataFrame, finish: date, cfg: Settings) -> DataFrame:
    return exp.filter(F.col("date") >= F.lit(add_months(finish, -cfg.months_back)))


def _by_month(df: DataFrame) -> DataFrame:
    return df.groupBy("date", "subdiv_id").agg(r_sum(F.col("exp_sum")).alias("exp_sum"))


def avg_strict(name: str):
    """Mean that is unknown as soon as one value is."""
    return F.when(F.count(name) == F.count(F.lit(1)), F.avg(name))


def max_strict(name: str):
    return F.when(F.count(name) == F.count(F.lit(1)), F.max(name))


def utilities_mean(exp: DataFrame, finish: date, cfg: Settings) -> DataFrame:
    m = _by_month(_recent(exp, finish, cfg).filter(F.col("expenses_item").isin(list(UTILITY_EXPENSES))))
    return m.groupBy("subdiv_id").agg(bankers_round(avg_strict("exp_sum")).alias("utilities_exp_sum"))


def rent_max(exp: DataFrame, finish: date, cfg: Settings) -> DataFrame:
    rent = _recent(exp, finish, cfg).filter(F.col("expenses_item") == RENT_EXPENSE).withColumn(
        "subdiv_id", remap(F.col("subdiv_id"), cfg.rent_subdiv_merge))
    return _by_month(rent).groupBy("subdiv_id").agg(
        bankers_round(max_strict("exp_sum")).alias("avr_rent_sum"))


def fuel_months(exp: DataFrame, finish: date, cfg: Settings) -> DataFrame:
    m = _by_month(_recent(exp, finish, cfg).filter(F.col("expenses_item") == FUEL_EXPENSE))
    return m.withColumnRenamed("exp_sum", "fuel_sum")


def maintenance_mean(exp: DataFrame) -> DataFrame:
    """Mean monthly upkeep over the long window, to the nearest hundred."""
    m = (exp.filter(F.col("expenses_item").isin(list(MAINTENANCE_EXPENSES)))
         .groupBy("date", "subdiv_id").agg(F.coalesce(F.sum("exp_sum_known"), F.lit(0.0)).alias("m")))
    return m.groupBy("subdiv_id").agg(
        (bankers_round(F.avg("m") / 100) * 100).alias("avr_maintenance_sum"))


def direct_costs(exp: DataFrame, support: DataFrame, payroll: DataFrame, finish: date,
                 cfg: Settings) -> DataFrame:
    """Mean other expenses, payroll, rent and utilities per subdivision with a payroll."""
    other = (_recent(exp, finish, cfg)
             .filter(not_in_local(F.col("expenses_item"), NON_DIRECT_EXPENSES))
             .withColumn("subdiv_id", remap(F.col("subdiv_id"), cfg.rent_subdiv_merge))
             .select("date", "subdiv_id", "expenses_item", "exp_sum"))
    support = support.withColumn("expenses_item", F.lit(SUPPORT_EXPENSE))
    total = _by_month(union_by_name(other, support)).groupBy("subdiv_id").agg(
        bankers_round(avg_strict("exp_sum")).alias("avr_total_exp_sum"))
    return (join_null_safe(total, payroll, ["subdiv_id"])
            .filter(F.col("avr_salary_sum").isNotNull())
            .join(rent_max(exp, finish, cfg), "subdiv_id", "left")
            .join(utilities_mean(exp, finish, cfg), "subdiv_id", "left"))

"""Positions at a date, monthly pay per person, store payroll."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.periods import add_months, month_floor
from ..functions.semantics import bankers_round, first_by, in_local, r_sum, remap, sum_or_zero
from ..sources.readers import Tables, time_bound
from .expenses import avg_strict
from .refs import decode
from .relational import join_null_safe, union_by_name


def window_months(finish: date, back: int) -> list[date]:
    return [add_months(finish, i - back) for i in range(back)]


def position_asof(t: Tables, months: list[date]) -> DataFrame:
    """Position held at the end of each month: the latest record, ties kept.

    The latest dates of all months come from one aggregate; the history is then
    joined on person and date, so no person's history is sorted or multiplied.
    """
    hist = t.register("position_history", "date_rec", None, add_months(months[-1], 1))
    hist = decode(hist, "position_ref", t["position_dim"], "position_id").filter(
        F.col("position_id").isNotNull())
    tops = hist.groupBy("individ_ref").agg(*[
        F.max(F.when(F.col("date_rec") < time_bound(hist, "date_rec", add_months(m, 1)),
                     F.col("date_rec"))).alias(f"m{i}")
        for i, m in enumerate(months)])
    per = F.explode(F.array(*[
        F.struct(F.lit(m).alias("date"), F.col(f"m{i}").alias("date_rec"))
        for i, m in enumerate(months)]))
    tops = tops.select("individ_ref", per.alias("_m")).select(
        "individ_ref", "_m.date", "_m.date_rec").filter(F.col("date_rec").isNotNull())
    df = tops.join(hist.select("individ_ref", "date_rec", "position_id"), ["individ_ref", "date_rec"])
    return decode(df, "individ_ref", t["individual_dim"], "individ_id").select(
        "date", "individ_id", "position_id")


def _employees(t: Tables) -> DataFrame:
    emp = decode(t["employee_dim"], "individ_ref", t["individual_dim"], "individ_id")
    return decode(emp, "organization_ref", t["organization_dim"], "organization_id").select(
        F.col("ref").alias("employee_ref"), "individ_id", "organization_id")


def salary_month(t: Tables, months: list[date], cfg: Settings) -> DataFrame:
    """Pay, contributions and taxes per person and month, with staff units and hours.

    All months go through in one pass; line tables are summed per month and
    employee before any code is joined.
    """
    docs = t.register("payroll_doc", "date", months[0], add_months(months[-1], 1),
                      ["posted", "is_managerial"]).select(
        F.col("ref").alias("doc_ref"), month_floor(F.col("date")).alias("date"))
    persons = _employees(t).select("employee_ref", "individ_id")

    lines = (t["payroll_line"].join(docs, "doc_ref")
             .groupBy("date", "employee_ref", "subdiv_ref").agg(
                 F.sum("salary").alias("salary"), F.sum("working_hours").alias("hours"),
                 F.sum("norm_hours").alias("norm"))
             .join(persons, "employee_ref", "left"))
    lines = decode(lines, "subdiv_ref", t["subdiv_dim"], "subdiv_id")
    lines = lines.join(position_asof(t, months), ["date", "individ_id"], "left")
    per = lines.groupBy("date", "individ_id", "subdiv_id", "position_id").agg(
        F.sum("salary").alias("salary"), F.sum("hours").alias("hours"), F.sum("norm").alias("norm"))
    paid = F.col("salary") != 0
    salary = (per.groupBy("date", "individ_id").agg(
        *[first_by(c, ["subdiv_id", "position_id"]).alias(c) for c in ("subdiv_id", "position_id")],
        F.sum(F.when(paid, F.col("salary"))).alias("salary_sum"),
        F.sum(F.when(paid, F.col("hours"))).alias("working_hours"),
        F.sum(F.when(paid, F.col("norm"))).alias("norm_hours"))
        .filter(F.col("salary_sum").isNotNull()))

    def person_sum(table: str, name: str) -> DataFrame:
        s = t[table].join(docs, "doc_ref").groupBy("date", "employee_ref").agg(F.sum("sum").alias("s"))
        return s.join(persons, "employee_ref", "left").groupBy("date", "individ_id").agg(
            F.sum("s").alias(name))

    key = ["date", "individ_id"]
    df = join_null_safe(salary, person_sum("contribution_line", "contr_sum"), key)
    df = join_null_safe(df, person_sum("tax_line", "taxes_sum"), key)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    unit = (F.when(F.col("norm_hours") == 0, F.lit(0.0))
            .when(F.col("working_hours") >= F.col("norm_hours"), F.lit(1.0))
            .otherwise(F.try_divide("working_hours", "norm_hours")))
    return df.select(
        "date", "individ_id", remap(F.col("subdiv_id"), cfg.subdiv_merge).alias("subdiv_id"),
        "position_id",
        (zero("salary_sum") + zero("contr_sum") + zero("taxes_sum")).alias("total_salary"),
        zero(unit).alias("stuff_unit"), zero("working_hours").alias("working_hours"))


def compensation(t: Tables, start: date, finish: date, cfg: Settings) -> DataFrame:
    """Leave compensation with tax: sum x (1 + the person's tax rate + the fixed extra rate)."""
    emp = _employees(t)
    kinds = t["charge_kind"].filter(F.col("code") == cfg.compensation_kind).select(
        F.col("ref").alias("kind_ref"))
    df = (t.register("charge", "date", start, finish, ["is_active"])
          .filter(F.col("compensation_sum") != 0).join(kinds, "kind_ref", "left_semi"))
    df = decode(df, "organization_ref", t["organization_dim"], "organization_id")
    df = df.join(emp, ["employee_ref", "organization_id"], "left")
    df = decode(df, "subdiv_ref", t["subdiv_dim"], "subdiv_id")
    df = df.select("date", "individ_id", "subdiv_id", "compensation_sum")
    last = add_months(finish, -1)
    df = df.join(position_asof(t, [last]).drop("date"), "individ_id", "left")

    taxes = t["tax_kind"].filter(F.col("code") == cfg.tax_kind).select(F.col("ref").alias("kind_ref"))
    rates = (t.register("tax_rate", "date", start, finish, ["is_active"])
             .filter(F.col("tax_rate") > 0).join(taxes, "kind_ref", "left_semi")
             .select("employee_ref", "organization_ref", "tax_rate").distinct())
    rates = decode(rates, "organization_ref", t["organization_dim"], "organization_id")
    rates = rates.join(emp, ["employee_ref", "organization_id"], "left").select(
        "individ_id", "tax_rate").distinct()
    rate = F.lit(1.0) + F.col("tax_rate") + F.lit(cfg.compensation_extra_rate)
    return df.join(rates, "individ_id", "left").withColumn(
        "total_salary_expenses", F.col("compensation_sum") * rate)


def salary_union(salary: DataFrame, comp: DataFrame, cfg: Settings) -> DataFrame:
    """Monthly pay less compensation, per month, subdivision, position and person."""
    minus = comp.select(
        month_floor(F.col("date")).alias("date"),
        remap(F.col("subdiv_id"), cfg.subdiv_merge).alias("subdiv_id"), "position_id", "individ_id",
        (-F.col("total_salary_expenses")).alias("total_salary"))
    return union_by_name(salary, minus).groupBy("date", "subdiv_id", "position_id", "individ_id").agg(
        sum_or_zero(F.col("total_salary")).alias("total_salary"),
        sum_or_zero(F.col("stuff_unit")).alias("stuff_unit"),
        sum_or_zero(F.col("working_hours")).alias("working_hours"))


def _manager_part(c: str, cfg: Settings) -> Column:
    manager = in_local(F.col("position_id"), [cfg.manager_position])
    return (F.when(manager & in_local(F.col("subdiv_id"), cfg.no_manager_subdivs), F.lit(0.0))
            .when(manager, F.col(c) * cfg.manager_share).otherwise(F.col(c)))


def payroll_store(salary: DataFrame, trade: DataFrame, cfg: Settings) -> DataFrame:
    """Sales staff per store (managers count in part) with the logistic units appended.

    One row per subdivision: a unit that trades is a store.
    """
    staff = salary.join(trade.select("subdiv_id").distinct(), "subdiv_id", "left_semi").filter(
        F.col("position_id").isin(list(cfg.retail_positions)))
    for c in ("total_salary", "stuff_unit", "working_hours"):
        staff = staff.withColumn(f"_{c}", _manager_part(c, cfg))
    months = staff.groupBy("date", "subdiv_id").agg(
        F.sum("_total_salary").alias("pay"),
        bankers_round(F.sum("_stuff_unit"), 1).alias("units"),
        F.sum("_working_hours").alias("hours"))
    shops = months.groupBy("subdiv_id").agg(
        bankers_round(F.avg("pay")).alias("avr_salary_sum"),
        F.max_by("units", "date").alias("stuff_units"),
        bankers_round(F.avg("hours")).alias("avr_working_hours"))
    logistic = (salary.filter(F.col("subdiv_id").isin(list(cfg.logistic_subdivs)))
                .join(trade.select("subdiv_id").distinct(), "subdiv_id", "left_anti")
                .groupBy("date", "subdiv_id").agg(F.sum("total_salary").alias("pay"))
                .groupBy("subdiv_id").agg(bankers_round(F.avg("pay")).alias("avr_salary_sum")))
    return union_by_name(shops, logistic)


def payroll_support(salary: DataFrame, trade: DataFrame, cfg: Settings) -> DataFrame:
    """Monthly pay of support staff per store, to be counted as an expense."""
    return (salary.join(trade.select("subdiv_id").distinct(), "subdiv_id", "left_semi")
            .filter(F.col("position_id").isin(list(cfg.support_positions)))
            .groupBy("date", "subdiv_id").agg(r_sum(F.col("total_salary")).alias("exp_sum")))


def driver_pay(salary: DataFrame, cfg: Settings) -> DataFrame:
    """One row: mean monthly pay of the satellite unit's drivers and forwarders."""
    return (salary.filter(F.col("position_id").isin(list(cfg.driver_positions))
                          & (F.col("subdiv_id") == cfg.satellite_subdiv))
            .groupBy("date").agg(F.sum("total_salary").alias("pay"))
            .agg(bankers_round(avg_strict("pay")).alias("driver_pay")))

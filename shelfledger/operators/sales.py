"""Retail sales per check report, structure, service documents, growth."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.periods import add_months, month_floor
from ..functions.semantics import (bankers_round, not_in_local, not_in_sql, number_text, r_sum,
                                   remap, safe_div)
from ..sources.readers import Tables
from .refs import decode, ref_category
from .relational import join_null_safe, top1


def _reports(t: Tables, start: date, finish: date) -> DataFrame:
    return t.register("check_report", "date", start, finish, ["posted", "is_managerial"])


def sale_report(t: Tables, start: date, finish: date, cfg: Settings) -> DataFrame:
    """Per check report: sum, quantity, distinct checks, lines, regular customers, cost.

    A line belongs to the period of its report, whatever its own time, so the reports
    of the window meet the lines before anything else does. What is left is summed per
    check on the references; codes are joined to the few report rows afterwards.
    """
    reports = _reports(t, start, finish)
    key = ["date", "nmbr_checks_report"]
    head = reports.select(F.col("ref").alias("report_ref"), *key, "subdiv_ref", "organization_ref")
    kept = t["item_dim"].filter(not_in_sql(F.col("item_id"), cfg.excluded_check_items))
    lines = (t.lines_of("check_line", head, "report_ref", (start, finish))
             .join(kept.select(F.col("ref").alias("item_ref")), "item_ref", "left_semi"))
    checks = lines.groupBy(*key, "subdiv_ref", "organization_ref", "check_nmbr").agg(
        F.sum("item_sum").alias("s"), F.sum("item_qty").alias("q"), F.count(F.lit(1)).alias("n"))
    sums = (checks.groupBy(*key, "subdiv_ref", "organization_ref")
            .agg(F.sum("s").alias("checks_report_sum"), F.sum("q").alias("checks_report_qty"),
                 F.count("check_nmbr").alias("total_checks_qty"), F.sum("n").alias("checks_report_sku"))
            .filter(F.col("checks_report_qty") != 0))

    regular = (t.lines_of("check_regular", head.select("report_ref"), "report_ref", (start, finish))
               .groupBy("report_ref").agg(F.sum("reg_cust_sum").alias("s"), F.count(F.lit(1)).alias("n")))
    regular = (head.select("report_ref", *key).join(regular, "report_ref").groupBy(*key)
               .agg(F.sum("s").alias("doc_reg_cust_sum"), F.sum("n").alias("doc_reg_cust_nmbr"))
               .filter(F.col("doc_reg_cust_sum") != 0))

    cost = (t.register("cost_register", "date", start, finish, ["active"])
            .groupBy(F.col("doc_ref").alias("report_ref"))
            .agg(F.sum("item_cost_sum").alias("c"), F.sum("item_cost_vat").alias("v")))
    cost = (cost.join(head.select("report_ref", *key), "report_ref")
            .filter(F.col("nmbr_checks_report").isNotNull()).groupBy(*key)
            .agg((F.sum("c") + F.sum("v")).alias("doc_cost_sum"))
            .filter(F.col("doc_cost_sum") != 0))

    out = sums.join(regular, key, "left").join(cost, key, "left")
    out = decode(out, "subdiv_ref", t["subdiv_dim"], "subdiv_id")
    out = decode(out, "organization_ref", t["organization_dim"], "organization_id")
    return out.select(*key, "subdiv_id", "organization_id", "checks_report_sum",
                      "checks_report_qty", "total_checks_qty", "checks_report_sku",
                      "doc_reg_cust_sum", "doc_reg_cust_nmbr", "doc_cost_sum")


def sale_month(report: DataFrame, trade: DataFrame, cfg: Settings) -> DataFrame:
    """Reports of trading subdivisions, dated to the month, one subdivision id merged."""
    return (report.join(trade.select("subdiv_id").distinct(), "subdiv_id", "left_semi")
            .withColumn("date", month_floor(F.col("date")))
            .withColumn("subdiv_id", remap(F.col("subdiv_id"), cfg.subdiv_merge)))


def sale_store_month(sales: DataFrame, missing_cost: str = "null") -> DataFrame:
    """Totals per store and month.

    One report without cost makes the month's cost unknown (``missing_cost``
    'null'); 'zero' counts such a report as costless instead.
    """
    cost = F.col("doc_cost_sum")
    if missing_cost == "zero":
        cost = F.coalesce(cost, F.lit(0.0))
    return sales.groupBy("date", "subdiv_id").agg(
        r_sum(F.col("checks_report_sum")).alias("revenue"),
        r_sum(cost).alias("cog"),
        F.sum("total_checks_qty").alias("month_checks_qty"),
        F.sum("checks_report_sku").alias("month_sku_in_checks"),
        r_sum(F.col("checks_report_qty")).alias("month_units_qty"),
        F.coalesce(F.sum("doc_reg_cust_nmbr"), F.lit(0)).alias("month_card_owners_checks_qty"))


def sale_store(months: DataFrame, finish: date, cfg: Settings) -> DataFrame:
    """Totals and means over the months present in the window."""
    return (months.filter(F.col("date") >= F.lit(add_months(finish, -cfg.months_back)))
            .groupBy("subdiv_id").agg(
                r_sum(F.col("revenue")).alias("total_revenue"),
                bankers_round(F.avg("revenue")).alias("avr_revenue"),
                r_sum(F.col("cog")).alias("total_cog"),
                bankers_round(F.when(F.count("cog") == F.count(F.lit(1)), F.avg("cog"))).alias("avr_cog"),
                F.sum("month_checks_qty").alias("total_checks_qty"),
                bankers_round(F.avg("month_checks_qty")).alias("avr_checks_qty"),
                F.sum("month_sku_in_checks").alias("total_sku_in_checks"),
                r_sum(F.col("month_units_qty")).alias("total_units_qty"),
                F.sum("month_card_owners_checks_qty").alias("total_card_owners_checks_qty")))


def basket_figures(df: DataFrame) -> DataFrame:
    """Check sum, lines and units per check, unit price from the totals."""
    div = lambda a, b, n: bankers_round(safe_div(F.col(a), F.col(b)), n)
    return df.withColumns({
        "avr_check_sum": div("total_revenue", "total_checks_qty", 1),
        "avr_ckecks_sku_qty": div("total_sku_in_checks", "total_checks_qty", 2),
        "avr_check_units": div("total_units_qty", "total_checks_qty", 2),
        "avr_unit_price": div("total_revenue", "total_units_qty", 2)})


def _item_categories(t: Tables) -> DataFrame:
    """Item reference and category id, items without category left out."""
    groups = decode(t["group_dim"].select(F.col("ref").alias("group_ref"), "category_ref"),
                    "category_ref", t["category_dim"], "category_id")
    return (t["item_dim"].select(F.col("ref").alias("item_ref"), "group_ref")
            .join(groups.filter(F.col("category_id").isNotNull()), "group_ref")
            .select("item_ref", "category_id"))


def sale_check_category(t: Tables, start: date, finish: date, cfg: Settings) -> DataFrame:
    """Sum and quantity per check and category, of the reports in the window."""
    head = _reports(t, start, finish).select(
        F.col("ref").alias("report_ref"), "nmbr_checks_report", "subdiv_ref")
    df = (t.lines_of("check_line", head, "report_ref", (start, finish)).join(_item_categories(t), "item_ref")
          .groupBy("subdiv_ref", "nmbr_checks_report", "check_nmbr", "category_id")
          .agg(F.sum("item_sum").alias("s"), F.sum("item_qty").alias("q")))
    return (decode(df, "subdiv_ref", t["subdiv_dim"], "subdiv_id")
            .withColumn("subdiv_id", remap(F.col("subdiv_id"), cfg.subdiv_merge))
            .groupBy("subdiv_id", "nmbr_checks_report", "check_nmbr", "category_id")
            .agg(F.sum("s").alias("check_category_sum"), F.sum("q").alias("check_category_qty")))


def category_cost(t: Tables, start: date, finish: date, cfg: Settings) -> DataFrame:
    """Cost with VAT per subdivision and category of what check reports sold."""
    known = t["check_report"].filter(F.col("nmbr_checks_report").isNotNull()).select(
        F.col("ref").alias("doc_ref"))
    df = (t.register("cost_register", "date", start, finish, ["active"])
          .join(known, "doc_ref", "left_semi").join(_item_categories(t), "item_ref")
          .groupBy("subdiv_ref", "category_id")
          .agg(F.sum("item_cost_sum").alias("c"), F.sum("item_cost_vat").alias("v")))
    return (decode(df, "subdiv_ref", t["subdiv_dim"], "subdiv_id")
            .withColumn("subdiv_id", remap(F.col("subdiv_id"), cfg.subdiv_merge))
            .groupBy("subdiv_id", "category_id")
            .agg((F.sum("c") + F.sum("v")).alias("category_cost_sum")))


def service_profit(t: Tables, start: date, finish: date) -> DataFrame:
    """Revenue, cost and gross profit per sale document; refunds go to their document.

    Cost rows and refund lines shrink to one row per document and item before
    they meet, with the number of refund lines as weight, so a much refunded item
    forms no pairs.
    """
    doc = ["sale_doc_nmbr", "sale_doc_date"]
    docs = t.unshift(t["sale_doc"], "sale_doc_date").select(
        F.col("ref").alias("doc_ref"), *doc, "customer_ref")
    refunds = t.register("refund_doc", "date_refund_doc", start, finish,
                         ["posted", "is_managerial"]).select(
        F.col("ref").alias("refund_ref"), "nmbr_refund_doc", "date_refund_doc")
    refund_key = ["nmbr_refund_doc", "date_refund_doc", "item_id"]
    items = t["item_dim"].select(F.col("ref").alias("item_ref"), "item_id")
    targets = (t["refund_line"].join(refunds, "refund_ref").join(items, "item_ref", "left")
               .join(docs.select(F.col("doc_ref").alias("sale_doc_ref"),
                                 F.col("sale_doc_nmbr").alias("to_nmbr"),
                                 F.col("sale_doc_date").alias("to_date")), "sale_doc_ref", "left")
               .groupBy(*refund_key, "to_nmbr", "to_date").agg(F.count(F.lit(1)).alias("n")))

    cost = (t.register("cost_register", "date", start, finish, ["active"])
            .groupBy("doc_ref", "item_ref")
            .agg(F.sum("item_cost_sum").alias("c"), F.sum("item_cost_vat").alias("v")))
    # Sale documents and refunds go separate ways: a left join on the refund's number
    # would send every sale row, NULL in that number, to the same tasks.
    sold = cost.join(docs.select("doc_ref", *doc), "doc_ref").filter(
        F.col("sale_doc_nmbr").isNotNull()).select(*doc, "c", "v", F.lit(1).cast("bigint").alias("n"))
    returned = (cost.join(refunds.withColumnRenamed("refund_ref", "doc_ref"), "doc_ref")
                .join(items, "item_ref").join(targets, refund_key)
                .filter(F.col("to_nmbr").isNotNull())
                .select(F.col("to_nmbr").alias("sale_doc_nmbr"), F.col("to_date").alias("sale_doc_date"),
                        "c", "v", "n"))
    cost = (sold.unionByName(returned).groupBy(*doc)
            .agg((F.sum(F.col("c") * F.col("n")) + F.sum(F.col("v") * F.col("n"))).alias("doc_cost_sum"))
            .filter(F.col("doc_cost_sum") > 0))

    sales = t.register("sale_register", "date", start, finish, ["active"])
    heads = (sales.filter(F.col("item_qty") > 0)
             .select(F.col("sale_doc_ref").alias("doc_ref"), "subdiv_ref", "organization_ref",
                     "project_ref").distinct()
             .join(docs, "doc_ref").filter(F.col("sale_doc_nmbr").isNotNull()))
    heads = decode(heads, "customer_ref", t["partner_dim"], "customer_id")
    heads = decode(heads, "subdiv_ref", t["subdiv_dim"], "subdiv_id")
    heads = decode(heads, "project_ref", t["project_dim"], "project_id")
    heads = decode(heads, "organization_ref", t["organization_dim"], "organization_id")
    heads = heads.select(*doc, "customer_id", "subdiv_id", "organization_id", "project_id").distinct()

    totals = (sales.groupBy(F.col("sale_doc_ref").alias("doc_ref"))
              .agg(F.sum("item_sum").alias("s"), F.sum("item_vat").alias("v"))
              .join(docs.select("doc_ref", *doc), "doc_ref", "left").groupBy(*doc)
              .agg((F.sum("s") + F.sum("v")).alias("doc_sale_sum"))
              .filter(F.col("doc_sale_sum") > 0))
    out = totals.join(cost, doc, "left").join(heads, doc, "left")
    return (out.withColumn("doc_cost_sum", F.coalesce("doc_cost_sum", F.lit(0.0)))
            .withColumn("gross_profit", F.col("doc_sale_sum") - F.col("doc_cost_sum"))
            .withColumn("sale_doc_date", F.to_date("sale_doc_date")))


def sale_plan(t: Tables, start: date, finish: date) -> DataFrame:
    df = t.register("sale_plan", "date", start, finish, ["posted"])
    df = decode(df, "subdiv_ref", t["subdiv_dim"], "subdiv_id", "subdiv_name")
    df = decode(df, "project_ref", t["project_dim"], "project")
    df = decode(df, "script_ref", t["scenario_dim"], "script_name")
    return df.select(F.col("date").alias("date_saleplan_doc"), "subdiv_id", "subdiv_name", "project",
                     "script_name", F.col("sum").alias("saleplan_doc_sum"))


def sale_structure(checks: DataFrame, cfg: Settings) -> DataFrame:
    """Share of checks and of revenue per subdivision and category."""
    total = checks.groupBy("subdiv_id").agg(
        r_sum(F.col("check_category_sum")).alias("_sum"),
        F.countDistinct(F.struct("nmbr_checks_report", "check_nmbr")).alias("_checks"))
    per = checks.groupBy("subdiv_id", "category_id").agg(
        F.count(F.lit(1)).alias("n"), r_sum(F.col("check_category_sum")).alias("s"))
    return (join_null_safe(per, total, ["subdiv_id"])
            .filter(not_in_local(F.col("category_id"), cfg.excluded_structure_categories))
            .select("subdiv_id", "category_id",
                    bankers_round(safe_div(F.col("n"), F.col("_checks")), 3).alias("category_checks_share"),
                    bankers_round(safe_div(F.col("s"), F.col("_sum")), 3).alias("category_revenue_share")))


def category_structure(inventory: DataFrame, structure: DataFrame, t: Tables,
                       cfg: Settings) -> DataFrame:
    """Inventory, check and revenue shares of each category sold by a store."""
    total = inventory.groupBy("subdiv_id").agg(r_sum(F.col("avr_category_inventory")).alias("_total"))
    share = bankers_round(safe_div(F.col("avr_category_inventory"), F.col("_total")), 3)
    inv = (join_null_safe(inventory, total, ["subdiv_id"])
           .filter(not_in_local(F.col("category_id"), cfg.excluded_structure_categories))
           .select("subdiv_id", "category_id", share.alias("category_inventory_share")))
    return (inv.join(structure, ["subdiv_id", "category_id"], "full")
            .filter(F.col("category_revenue_share").isNotNull())
            .join(ref_category(t, cfg).select("category_id", "category_name"), "category_id", "left")
            .select("subdiv_id", "category_name", "category_checks_share",
                    "category_revenue_share", "category_inventory_share"))


def revenue_generator(structure: DataFrame) -> DataFrame:
    """Each store's category with the largest revenue share, labelled 'name - share%'."""
    best = top1(structure.select("subdiv_id", "category_name", "category_revenue_share"),
                ["subdiv_id"], "category_revenue_share", "category_name")
    label = F.concat("category_name", F.lit(" - "),
                     number_text(F.col("category_revenue_share") * 100, 4), F.lit("%"))
    return best.select("subdiv_id", label.alias("revenue_generator"))


def quarter_growth(sales: DataFrame, classes: DataFrame, finish: date) -> DataFrame:
    """Half of the change from quarter 1 to 2 in lines and units per check, by class."""
    d = F.col("date")
    quarter = (F.when(d < F.lit(add_months(finish, -9)), 1).when(d < F.lit(add_months(finish, -6)), 2)
               .when(d < F.lit(add_months(finish, -3)), 3).otherwise(4))
    totals = (sales.withColumn("quarter", quarter).groupBy("subdiv_id", "quarter").agg(
                  F.sum("total_checks_qty").alias("c"), F.sum("checks_report_sku").alias("k"),
                  r_sum(F.col("checks_report_qty")).alias("u"))
              .join(classes.select("subdiv_id", "trade_category"), "subdiv_id", "left")
              .groupBy("trade_category", "quarter")
              .agg(F.sum("c").alias("c"), F.sum("k").alias("k"), r_sum(F.col("u")).alias("u"))
              .withColumn("sku", bankers_round(safe_div(F.col("k"), F.col("c")), 2))
              .withColumn("units", bankers_round(safe_div(F.col("u"), F.col("c")), 2)))
    at = lambda c, q: F.max(F.when(F.col("quarter") == q, F.col(c)))
    both = totals.groupBy("trade_category").agg(
        at("sku", 1).alias("s1"), at("sku", 2).alias("s2"),
        at("units", 1).alias("u1"), at("units", 2).alias("u2"),
        F.max(F.col("quarter") == 1).alias("has1"), F.max(F.col("quarter") == 2).alias("has2"))
    half = lambda a, b: bankers_round((1 + safe_div(F.col(b), F.col(a))) / 2, 2)
    return both.filter("has1 and has2").select(
        "trade_category", half("s1", "s2").alias("check_sku_qty_growth"),
        half("u1", "u2").alias("check_units_growth"))

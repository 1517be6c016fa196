"""Discount lines of the point-of-sale database and loyalty card figures."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (DISCOUNT_CLASSES, DISCOUNT_EARNED, DISCOUNT_EARNED_NAME, DISCOUNT_MARKETING,
                      DISCOUNT_ROUNDING, DISCOUNT_SPENT, DISCOUNT_SPENT_NAME)
from ..functions.semantics import (bankers_round, conditional_count, count_distinct_local,
                                   negate_when, safe_div)
from ..sources.readers import Tables
from .relational import join_null_safe

REFUND_TYPE = 4


def _live(t: Tables, name: str) -> DataFrame:
    return t[name].filter(F.col("deleted") == 0).drop("deleted")


def _valid_receipts(t: Tables, receipt: str = "id") -> DataFrame:
    """Receipts neither deleted nor failed.

    The key gets its name before the join and stands first in it: only so does a window of
    receipts filter the lines that meet it before these are shuffled.
    """
    done = _live(t, "receipt_footer").filter(F.col("result") == 0).select(F.col("id").alias(receipt), "cash_id")
    return _live(t, "receipt_header").withColumnRenamed("id", receipt).join(done, [receipt, "cash_id"])


def cash_store(t: Tables) -> DataFrame:
    return t["pos"].join(t["pos_store"], "store_id", "left").select("cash_id", "code_subdivision")


def discount_lines(t: Tables, start: date, finish: date) -> DataFrame:
    """Discounts on receipt lines in the window, refunds negated.

    Each line meets only its own discounts (receipt, line and discount keys at
    once), never all discounts of its receipt.
    """
    last = finish - timedelta(days=1)
    head = _valid_receipts(t, "receipt_header").filter(F.to_date("date").between(F.lit(start), F.lit(last)))
    items = _live(t, "receipt_item").withColumnRenamed("id", "receipt_item")
    disc = _live(t, "receipt_item_discount")
    names = _live(t, "receipt_discounts").withColumnRenamed("id", "receipt_discount")
    df = (items.join(head, ["receipt_header", "cash_id"]).join(disc, ["receipt_item", "cash_id"])
          .join(names, ["receipt_header", "cash_id", "receipt_discount"])
          .join(cash_store(t), "cash_id", "left"))
    neg = lambda c: negate_when(F.col("type"), REFUND_TYPE, F.col(c)).alias(c)
    return df.select("date", "client", "type", "global_number", "code_subdivision", "name", "item",
                     neg("total_quantity"), "position", neg("base_total"), neg("increment"),
                     neg("account_increment"))


def new_cards(t: Tables, start: date, finish: date) -> DataFrame:
    """Clients by the store of their first receipt, if that falls into the window."""
    last = finish - timedelta(days=1)
    df = (_valid_receipts(t).filter(F.col("client").isNotNull()).join(cash_store(t), "cash_id", "left")
          .groupBy("client").agg(
              F.min("date").alias("fdate"),
              F.min_by("code_subdivision", F.struct("date", "code_subdivision")).alias("store")))
    return (df.filter(F.to_date("fdate").between(F.lit(start), F.lit(last)))
            .groupBy("store").agg(F.count(F.lit(1)).alias("count")))


def discount_days(lines: DataFrame) -> DataFrame:
    """Discount lines per store, client, day and discount name, in one pass for cards and sums.

    The sums are those of the lines that give a discount; their counts say whether one of
    the amounts is unknown. Lines that give none still count as a visit.
    """
    kept = F.coalesce(((F.col("increment") != 0) | (F.col("account_increment") != 0))
                      & (F.col("name") != DISCOUNT_ROUNDING), F.lit(False))
    sums = [f(F.when(kept, F.col(c))).alias(f"{n}_{c}") for c in ("increment", "account_increment")
            for n, f in (("sum", F.sum), ("known", F.count))]
    return lines.groupBy("code_subdivision", "client", F.to_date("date").alias("day"), "name").agg(
        *sums, F.count(F.when(kept, 1)).alias("n"))


def discount_class(days: DataFrame, t: Tables) -> DataFrame:
    """Bonus earned, bonus spent and marketing discount per warehouse, one column each."""
    kind = (F.when(F.col("name") == DISCOUNT_EARNED_NAME, DISCOUNT_EARNED)
            .when(F.col("name") == DISCOUNT_SPENT_NAME, DISCOUNT_SPENT).otherwise(DISCOUNT_MARKETING))
    total = lambda c: F.when(F.sum(f"known_{c}") == F.sum("n"), F.sum(f"sum_{c}"))
    sums = days.filter("n > 0").groupBy("code_subdivision", kind.alias("name_marketing")).agg(
        bankers_round(-total("increment") + total("account_increment")).alias("s"))
    wide = sums.groupBy("code_subdivision").pivot("name_marketing", list(DISCOUNT_CLASSES)).agg(F.max("s"))
    own = t["store_dim"].select(F.col("store_id").alias("code_subdivision"), "subdiv_ref").join(
        t["subdiv_dim"].select(F.col("ref").alias("subdiv_ref"), "subdiv_id"), "subdiv_ref", "left")
    return wide.join(own, "code_subdivision", "left").select("subdiv_id", "code_subdivision", *DISCOUNT_CLASSES)


def discount_subdiv(classes: DataFrame) -> DataFrame:
    """Discount classes summed to the subdivision, so one with two warehouses stays one row."""
    return classes.groupBy("subdiv_id").agg(*[F.sum(c).alias(c) for c in DISCOUNT_CLASSES])


def card_visits(days: DataFrame) -> DataFrame:
    """Days each known card was used at a store."""
    return (days.filter(F.col("client").isNotNull())
            .groupBy("code_subdivision", "client").agg(count_distinct_local(F.col("day")).alias("total_purchase")))


def card_stats(visits: DataFrame, cards: DataFrame, stores: DataFrame, kpis: DataFrame,
               classes: DataFrame, t: Tables) -> DataFrame:
    """Cards used, share used more than once, new cards and owners' share per store."""
    own = t["store_dim"].join(stores.select("store_id").distinct(), "store_id", "left_semi").join(
        t["subdiv_dim"].select(F.col("ref").alias("subdiv_ref"), "subdiv_id"), "subdiv_ref", "left"
    ).select("store_id", "subdiv_id")
    once = conditional_count(F.col("total_purchase") == 1)
    used = (visits.groupBy(F.col("code_subdivision").alias("store_id")).agg(
                once.alias("p1"), F.count(F.lit(1)).alias("n"))
            .join(own, "store_id").groupBy("subdiv_id")
            .agg(F.sum("p1").alias("p1"), F.sum("n").alias("total_purch")))
    fresh = (cards.withColumnRenamed("store", "store_id").join(own, "store_id")
             .groupBy("subdiv_id").agg(F.sum("count").alias("new_cards")))
    df = join_null_safe(used, fresh, ["subdiv_id"])
    df = df.join(kpis.select("subdiv_id", "card_owners_share"), "subdiv_id", "left").join(
        t["subdiv_dim"].select("subdiv_id", "subdiv_name"), "subdiv_id", "left").join(
        classes.select("subdiv_id", "trade_category"), "subdiv_id", "left")
    return df.select(
        "subdiv_name", "trade_category", "card_owners_share", "total_purch",
        bankers_round(F.lit(1) - safe_div(F.col("p1"), F.col("total_purch")), 2).alias("purch_more_1_share"),
        F.coalesce("new_cards", F.lit(0)).alias("new_cards"))

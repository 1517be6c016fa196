"""Stock balances, monthly movement, roll-back to snapshots, LIFO value, prices."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.periods import add_months, month_floor, months_between
from ..functions.semantics import (bankers_round, conditional_count, near_zero, not_in_sql, r_sum,
                                   safe_div, sign_by_kind)
from ..sources.readers import Tables, time_bound
from .refs import decode


def non_trade_items(roots: DataFrame, cfg: Settings) -> DataFrame:
    """Items below the non-trade roots; an item without root is a trade item."""
    return roots.filter(F.col("main_parent").isin(list(cfg.non_trade_roots))).select("item_id")


def drop_non_trade(df: DataFrame, non_trade: DataFrame) -> DataFrame:
    return df.join(non_trade, "item_id", "left_anti")


def open_stores(t: Tables, cfg: Settings) -> DataFrame:
    """Warehouses whose parent is known and not a closed one.

    Children and parents meet in a window instead of a join: Spark takes a join for as large as
    the product of its sides and would shuffle the registers to meet this table.
    """
    of, up = F.col("_of"), F.col("_open")
    stores = t["store_dim"]
    up_open = not_in_sql(F.col("store_id"), cfg.closed_parent_stores)
    child = stores.select(F.col("parent_ref").alias("_of"), F.col("ref").alias("store_ref"), "store_id",
                          F.lit(0).alias("_open"), F.lit(True).alias("_child"))
    parent = stores.filter(up_open).select(F.col("ref").alias("_of"), F.col("ref").alias("store_ref"), "store_id",
                                           F.lit(1).alias("_open"), F.lit(False).alias("_child"))
    df = child.unionByName(parent).filter(of.isNotNull()).withColumn("_open", F.sum(up).over(W.partitionBy(of)))
    # a parent that stands twice gives its children twice, as a join does
    return df.filter(F.col("_child") & (up > 0)).select(
        "store_ref", "store_id", F.explode(F.sequence(F.lit(1), up.cast("int"))).alias("_n")).drop("_n")


def _decoded(df: DataFrame, t: Tables, cfg: Settings) -> DataFrame:
    """Codes for rows on references: open warehouses only, item codes.

    The rows come out dealt by item, which every later step of the stock keeps to: sums per
    warehouse and item, batches by receipt, prices and categories move them no more.
    """
    return decode(df.join(open_stores(t, cfg), "store_ref").drop("store_ref"),
                  "item_ref", t["item_dim"], "item_id").repartition("item_id")


def _cost_with_vat() -> Column:
    """Batch cost; VAT below a fifth of the sum (cut to a tenth) counts as none."""
    total, vat = F.col("item_store_sum"), F.col("item_store_vat")
    low = vat < F.floor(total / 5 * 10) / 10
    return total + F.when(low, F.lit(0.0)).otherwise(vat)


def _with_receipt(rows: DataFrame, t: Tables) -> DataFrame:
    """Time of receipt of aggregated rows, from purchase receipts or assembly documents."""
    a = t.unshift(t["receipt_doc"], "date").select(F.col("ref").alias("receipt_doc_ref"), F.col("date").alias("a"))
    b = t.unshift(t["assembly_doc"], "date").select(F.col("ref").alias("receipt_doc_ref"), F.col("date").alias("b"))
    return (rows.join(a, "receipt_doc_ref", "left").join(b, "receipt_doc_ref", "left")
            .withColumn("received", F.coalesce("a", "b")).drop("a", "b"))


def _stock_rows(t: Tables, as_of: date) -> DataFrame:
    """Current stock on references; no movement month.

    A balance has few rows of one warehouse and item, so they are summed with the movement only.
    """
    bal = t["stock_balance"]
    bal = bal.filter(F.col("date_balance") > time_bound(bal, "date_balance", as_of, t.shift))
    return bal.select("store_ref", "item_ref", F.col("item_store_qty").alias("q"), F.lit(None).cast("date").alias("month"))


def moved_rows(t: Tables, start: date, finish: date | None = None) -> DataFrame:
    """Signed movement per month on references."""
    mv = t.register("stock_movement", "date_movement", start, finish, ["active"])
    signed = sign_by_kind(F.col("type_motion"), F.col("item_motion_qty"))
    return mv.groupBy("store_ref", "item_ref", month_floor(F.col("date_movement")).alias("month")).agg(
        F.sum(signed).alias("q")).select("store_ref", "item_ref", "q", "month")


def _history(rows: DataFrame, t: Tables, cfg: Settings) -> DataFrame:
    return (_decoded(rows, t, cfg).groupBy("month", "store_id", "item_id").agg(F.sum("q").alias("q"))
            .filter(F.col("q") != 0))


def _stock_batches(t: Tables, as_of: date) -> DataFrame:
    bal = t["batch_balance"]
    bal = bal.filter(F.col("date_balance") > time_bound(bal, "date_balance", as_of, t.shift))
    return bal.select("store_ref", "item_ref", "receipt_doc_ref", F.col("item_store_qty").alias("q"),
                      _cost_with_vat().alias("v"), F.lit(None).cast("date").alias("month"))


def moved_batches(t: Tables, start: date, finish: date | None = None) -> DataFrame:
    """Signed batch movement per month on references."""
    mv = t.register("batch_movement", "date_movement", start, finish, ["active"])
    sign = lambda c: sign_by_kind(F.col("type_motion"), c)
    return (mv.withColumn("cost", _cost_with_vat())
            .groupBy("store_ref", "item_ref", "receipt_doc_ref",
                     month_floor(F.col("date_movement")).alias("month"))
            .agg(F.sum(sign(F.col("item_motion_qty"))).alias("q"), F.sum(sign(F.col("cost"))).alias("v"))
            .select("store_ref", "item_ref", "receipt_doc_ref", "q", "v", "month"))


def _batch_history(rows: DataFrame, t: Tables, cfg: Settings) -> DataFrame:
    """Batches by receipt day.

    A month in which the quantity of one receipt, by its time, nets to nothing moved
    nothing of it, whatever the cost; only then are the receipts of a day one batch.
    """
    df = _decoded(_with_receipt(rows, t), t, cfg)
    sums = [F.sum("q").alias("q"), F.sum("v").alias("v")]
    return (df.groupBy("month", "received", "store_id", "item_id").agg(*sums)
            .filter(F.col("month").isNull() | (F.col("q") != 0))
            .groupBy("month", F.to_date("received").alias("date_receipt"), "store_id", "item_id").agg(*sums))


def inv_current(t: Tables, as_of: date, cfg: Settings) -> DataFrame:
    return _history(_stock_rows(t, as_of), t, cfg).select(
        "store_id", "item_id", F.col("q").alias("item_store_qty"))


def inv_movement(t: Tables, start: date, cfg: Settings) -> DataFrame:
    """Signed movement per month, warehouse and item."""
    return _history(moved_rows(t, start), t, cfg).select(
        F.col("month").alias("date_movement"), "store_id", "item_id",
        F.col("q").alias("store_item_moving_qty"))


def inv_current_batch(t: Tables, as_of: date, cfg: Settings) -> DataFrame:
    return _batch_history(_stock_batches(t, as_of), t, cfg).select(
        "store_id", "item_id", "date_receipt", F.col("q").alias("item_store_qty"),
        F.col("v").alias("item_store_sum"))


def inv_movement_batch(t: Tables, start: date, cfg: Settings) -> DataFrame:
    """Signed batch movement, quantity and cost, per month and receipt day."""
    return _batch_history(moved_batches(t, start), t, cfg).select(
        F.col("month").alias("date_movement"), "date_receipt", "store_id", "item_id",
        F.col("q").alias("item_motion_qty"), F.col("v").alias("item_motion_cost"))


def inv_history(t: Tables, start: date, as_of: date, cfg: Settings, moved: DataFrame | None = None) -> DataFrame:
    """Current stock (no month) and monthly movement together, decoded once; ``moved`` may give the movement on references."""
    moved = moved_rows(t, start) if moved is None else moved
    return _history(_stock_rows(t, as_of).unionByName(moved), t, cfg)


def inv_batch_history(t: Tables, start: date, as_of: date, cfg: Settings, moved: DataFrame | None = None) -> DataFrame:
    """Current batches (no month) and monthly batch movement together, decoded once; ``moved`` as for :func:`inv_history`."""
    moved = moved_batches(t, start) if moved is None else moved
    return _batch_history(_stock_batches(t, as_of).unionByName(moved), t, cfg)


def _since(c: str, snapshots: list[date], name: str) -> list[Column]:
    """Per snapshot: what is there now less what has moved since."""
    x, m = F.col(c), F.col("month")
    return [F.sum(F.when(m.isNull(), x).when(m >= F.lit(s), -x).otherwise(0.0)).alias(f"{name}{i}")
            for i, s in enumerate(snapshots)]


def _per_snapshot(snapshots: list[date], *names: str) -> Column:
    """Explode the conditional sums ``name0..n`` into one row per snapshot."""
    return F.explode(F.array(*[
        F.struct(F.lit(d).alias("date"), *[F.col(f"{n}{i}").alias(n) for n in names])
        for i, d in enumerate(snapshots)])).alias("_s")


def _balances_wide(history: DataFrame, snapshots: list[date]) -> DataFrame:
    return history.groupBy("store_id", "item_id").agg(*_since("q", snapshots, "balance_qty"))


def _batches_wide(history: DataFrame, snapshots: list[date]) -> DataFrame:
    """One row per batch; per snapshot its balance, NULL where empty or contradictory."""
    df = history.groupBy("store_id", "item_id", "date_receipt").agg(
        *_since("q", snapshots, "_q"), *_since("v", snapshots, "_v"))
    out = {}
    for i in range(len(snapshots)):
        q, v = F.col(f"_q{i}"), F.col(f"_v{i}")
        kept = ~near_zero(q) & ~((q < 0) & (v > 0))
        out[f"balance_batch_qty{i}"], out[f"balance_batch_sum{i}"] = F.when(kept, q), F.when(kept, v)
    return df.select("store_id", "item_id", "date_receipt", *[c.alias(n) for n, c in out.items()])


def inv_rollback(history: DataFrame, snapshots: list[date]) -> DataFrame:
    """Balance at each snapshot: current stock less the movement since.

    One sum with one conditional term per snapshot. That equals a full outer join
    of stock and movement per snapshot, with a single shuffle and without a copy
    of the inputs for every snapshot.
    """
    return (_balances_wide(history, snapshots)
            .select("store_id", "item_id", _per_snapshot(snapshots, "balance_qty"))
            .select("_s.date", "store_id", "item_id", "_s.balance_qty")
            .filter(F.col("balance_qty") != 0))


def inv_batch_rollback(history: DataFrame, snapshots: list[date]) -> DataFrame:
    """Batch balances at each snapshot; empty and contradictory batches are left out."""
    names = ("balance_batch_qty", "balance_batch_sum")
    return (_batches_wide(history, snapshots)
            .select("store_id", "item_id", "date_receipt", _per_snapshot(snapshots, *names))
            .select("_s.date", "store_id", "item_id", "date_receipt", *[f"_s.{n}" for n in names])
            .filter(F.col("balance_batch_qty").isNotNull()))


def price_history(t: Tables, start: date, cfg: Settings) -> DataFrame:
    """Prices per item and day from the last one before ``start`` on.

    An item first priced after ``start`` has no lower bound and is left out. Of the settings
    before it only the last one counts, so an item's older days are one row before the window.
    """
    kinds = t["price_type_dim"].filter(F.col("price_type_id") == cfg.price_type).select(
        F.col("ref").alias("price_type_ref"))
    df = t.unshift(t["price_history"].filter("active"), "date_setting")
    df = df.join(kinds, "price_type_ref", "left_semi").filter(F.col("date_setting").isNotNull())
    before = F.col("date_setting") < time_bound(df, "date_setting", start)
    # One price per item and day: the latest setting of the day; before ``start``, that of the last day.
    df = df.groupBy("item_ref", F.when(~before, F.to_date("date_setting")).alias("day")).agg(
        F.max("date_setting").alias("at"), F.max_by("item_price", "date_setting").alias("item_price"))
    df = df.withColumn("bounded", F.max(F.col("day").isNull()).over(W.partitionBy("item_ref"))).filter("bounded")
    return decode(df, "item_ref", t["item_dim"], "item_id").select(
        "item_id", F.to_date("at").alias("date_setting"), "item_price")


def prices_at(prices: DataFrame, snapshots: list[date]) -> DataFrame:
    """Each item's last price set strictly before each snapshot, in one aggregate."""
    aggs = [F.max_by("item_price", F.when(F.col("date_setting") < F.lit(s), F.col("date_setting"))).alias(f"item_price{i}")
            for i, s in enumerate(snapshots)]
    return prices.groupBy("item_id").agg(*aggs).select(
        "item_id", _per_snapshot(snapshots, "item_price")).select("_s.date", "item_id", "_s.item_price")


def _lifo_batches(i: int) -> Column:
    """``(mx, amount)`` of snapshot ``i`` from the array ``lots``, newest batch first; the amount is unrounded.

    ``mx`` is the most that the batches hold, newest first, up to any of them. The cases
    exclude each other: stock met by some batch, more in the batches than in stock, less
    in the batches, no batch at all. Quantities closer than ``NEAR`` are equal, so the
    order in which a cluster adds them up decides no case. Most groups have one batch or none; only
    the others are gone through batch by batch.
    """
    b, none = F.col(f"b{i}"), F.lit(None).cast("double")
    found = lambda mx, amount: F.struct(mx.alias("mx"), amount.alias("amount"))

    def add(s: Column, lot: Column) -> Column:
        q, v = lot[f"q{i}"], lot[f"v{i}"]
        cq = F.coalesce(s["cq"], F.lit(0.0)) + q
        cv = F.when(v.isNull(), s["cv"]).otherwise(F.coalesce(s["cv"], F.lit(0.0)) + v)
        unit, only = safe_div(v, q), near_zero(q - cq)
        met = F.coalesce(near_zero(cq - b), F.lit(False))
        over = ~met & F.coalesce(cq > b, F.lit(False))
        more = F.when(only, unit * b).otherwise(cv - v + unit * (q - (cq - b)))
        less = F.when(only, unit * b).otherwise(cv + unit * (b - cq))
        return F.when(q.isNull(), s).otherwise(F.struct(
            cq.alias("cq"), cv.alias("cv"), F.greatest(s["mx"], cq).alias("mx"),
            (s["met"] | met).alias("met"), F.when(~s["met"] & met, cv).otherwise(s["equal"]).alias("equal"),
            (s["over"] | over).alias("over"), F.when(~s["over"] & over, more).otherwise(s["more"]).alias("more"),
            less.alias("less")))

    def end(s: Column) -> Column:
        mx = s["mx"]
        return found(mx, F.when(mx.isNull(), b).when(near_zero(mx - b), s["equal"]).when(mx > b, s["more"]).otherwise(s["less"]))

    off = F.lit(False)
    zero = F.struct(none.alias("cq"), none.alias("cv"), none.alias("mx"), off.alias("met"), none.alias("equal"),
                    off.alias("over"), none.alias("more"), none.alias("less"))
    q, v = F.col("lots")[0][f"q{i}"], F.col("lots")[0][f"v{i}"]
    one = found(q, F.when(q.isNull(), b).when(near_zero(q - b), v).otherwise(safe_div(v, q) * b))
    n = F.size("lots")
    return F.when(n == 0, found(none, b)).when(n == 1, one).otherwise(F.aggregate("lots", zero, add, end))


def _lifo_wide(history: DataFrame, batch_history: DataFrame, prices: DataFrame, snapshots: list[date]) -> DataFrame:
    """One row per warehouse and item; per snapshot its balance ``b`` and its value ``balance_sum``.

    All snapshots are columns of one aggregate: the batches of a warehouse and item
    become an array, newest receipt first, beside its balances. A group holds one
    batch per receipt day, so a busy item is bounded by the calendar, not by its
    sales. ``prices`` holds one price per snapshot and item.
    """
    n = range(len(snapshots))
    key = ["store_id", "item_id"]
    # A balance is one more row beside its batches: a join on both keys would deal out again
    # what lies by item already. An unknown warehouse or item has no batches.
    stock = _balances_wide(history, snapshots).withColumn("stock", F.lit(True))
    qty = [f"balance_batch_qty{i}" for i in n]
    lot = F.struct("date_receipt", *[c for i in n for c in (F.col(qty[i]).alias(f"q{i}"), F.col(f"balance_batch_sum{i}").alias(f"v{i}"))])
    batches = (_batches_wide(batch_history.dropna(subset=key), snapshots).filter(F.coalesce(*qty).isNotNull())
               .select(*key, lot.alias("lot"), F.lit(False).alias("stock")))
    one = (batches.unionByName(stock, allowMissingColumns=True).groupBy(*key)
           .agg(F.max("stock").alias("stock"), *[F.max(f"balance_qty{i}").alias(f"b{i}") for i in n],
                F.sort_array(F.collect_list("lot"), asc=False).alias("lots"))
           .filter("stock").withColumns({f"s{i}": _lifo_batches(i) for i in n}))
    # an item's prices meet its balances as columns, before there is a row for each snapshot
    wide = prices.groupBy("item_id").agg(
        *[F.max(F.when(F.col("date") == F.lit(d), F.col("item_price"))).alias(f"item_price{i}") for i, d in enumerate(snapshots)])
    df, out = one.join(wide, "item_id", "left"), []
    for i in n:
        b, mx, amount = F.col(f"b{i}"), F.col(f"s{i}.mx"), F.col(f"s{i}.amount")
        value = (F.when(mx.isNull(), amount * F.col(f"item_price{i}")).when(near_zero(mx - b), amount)
                 .otherwise(bankers_round(amount, 2)))
        out += [b, value.alias(f"balance_sum{i}")]
    return df.select(*key, *out)


def inv_lifo_value(history: DataFrame, batch_history: DataFrame, prices: DataFrame,
                   snapshots: list[date]) -> DataFrame:
    """Value of each balance out of its newest batches; without batch, by the last price."""
    wide = _lifo_wide(history, batch_history, prices, snapshots)
    rows = wide.select("store_id", "item_id", _per_snapshot(snapshots, "b", "balance_sum"))
    return rows.filter(F.col("_s.b") != 0).select("_s.date", "store_id", "item_id", "_s.balance_sum")


def _item_categories(t: Tables) -> DataFrame:
    groups = decode(t["group_dim"].select(F.col("ref").alias("group_ref"), "category_ref"),
                    "category_ref", t["category_dim"], "category_id")
    return t["item_dim"].select("item_id", "group_ref").join(
        groups.filter(F.col("category_id").isNotNull()), "group_ref").select("item_id", "category_id")


def inv_category(values: DataFrame, t: Tables) -> DataFrame:
    """Stock value and stocked items per snapshot, warehouse and category."""
    return (values.join(_item_categories(t), "item_id").groupBy("date", "store_id", "category_id")
            .agg(F.coalesce(F.sum("balance_sum"), F.lit(0.0)).alias("category_inventory_sum"),
                 conditional_count(F.col("balance_sum") > 0).alias("category_sku")))


def _category_sums(wide: DataFrame, snapshots: list[date], t: Tables) -> DataFrame:
    """:func:`inv_category` of all snapshots as columns: an item is shuffled once, not once for each."""
    sums = []
    for i in range(len(snapshots)):
        there, value = F.col(f"b{i}") != 0, F.col(f"balance_sum{i}")
        sums += [F.sum(F.when(there, value)).alias(f"total{i}"), F.count(F.when(there, value)).alias(f"known{i}"),
                 F.count(F.when(there, 1)).alias(f"rows{i}"),
                 F.sum(F.when(there, (value > 0).cast("bigint"))).alias(f"sku{i}")]
    one = wide.join(_item_categories(t), "item_id").groupBy("store_id", "category_id").agg(*sums)
    sku = F.when(F.col("_s.known") == F.col("_s.rows"), F.col("_s.sku"))
    return (one.select("store_id", "category_id", _per_snapshot(snapshots, "total", "known", "rows", "sku"))
            .filter(F.col("_s.rows") > 0)
            .select("_s.date", "store_id", "category_id", F.coalesce("_s.total", F.lit(0.0)).alias("category_inventory_sum"),
                    sku.alias("category_sku")))


def inv_snapshots(t: Tables, finish: date, as_of: date, non_trade: DataFrame, cfg: Settings,
                  moved: Callable[[str, date], DataFrame] | None = None) -> DataFrame:
    """Monthly stock value by warehouse and category over the inventory window, in one job.

    ``moved`` may give the movement of ``stock`` and ``batches`` from a day on, as kept
    months do; by default it is summed from the registers.
    """
    start = add_months(finish, -cfg.inventory_months)
    snaps = months_between(start, finish)
    of = lambda kind: moved(kind, start) if moved else None
    stock = drop_non_trade(inv_history(t, start, as_of, cfg, of("stock")), non_trade)
    batches = drop_non_trade(inv_batch_history(t, start, as_of, cfg, of("batches")), non_trade)
    prices = prices_at(price_history(t, start, cfg), snaps)
    return _category_sums(_lifo_wide(stock, batches, prices, snaps), snaps, t)


def _with_subdiv(df: DataFrame, stores: DataFrame, t: Tables) -> DataFrame:
    own = decode(t["store_dim"].select("store_id", "subdiv_ref"), "subdiv_ref", t["subdiv_dim"], "subdiv_id")
    return df.join(stores.select("store_id").distinct(), "store_id", "left_semi").join(
        own, "store_id", "left")


def inv_store_mean(snapshots: DataFrame, stores: DataFrame, t: Tables) -> DataFrame:
    """Mean stock value and item count per store over the snapshots."""
    month = snapshots.groupBy("store_id", "date").agg(
        r_sum(F.col("category_inventory_sum")).alias("m"),
        F.coalesce(F.sum("category_sku"), F.lit(0)).alias("k"))
    return _with_subdiv(month, stores, t).groupBy("subdiv_id").agg(
        bankers_round(F.avg("m")).alias("avr_inventory"), bankers_round(F.avg("k")).alias("avr_sku_qty"))


def inv_category_mean(snapshots: DataFrame, stores: DataFrame, t: Tables) -> DataFrame:
    """Mean stock value per store and category over the snapshots."""
    mean = snapshots.groupBy("store_id", "category_id").agg(
        F.avg("category_inventory_sum").alias("avr_category_inventory"))
    return _with_subdiv(mean, stores, t).select("subdiv_id", "category_id", "avr_category_inventory")

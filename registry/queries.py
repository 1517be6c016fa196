"""Every registered query: (session, folder of the driver tables) -> DataFrame."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfledger.config import NAME_CLEANING
from shelfledger.functions import periods, semantics
from shelfledger.operators import (expenses, inventory, logistics, loyalty, payroll, refs, sales,
                                   vat)
from shelfledger.operators import relational as rel
from shelfledger.plans import views
from shelfledger.kept.clients import FirstReceipts
from shelfledger.kept.lines import LaidOut, LineLayout
from shelfledger.kept.stock import StockMonths
from shelfledger.plans.run import Run
from shelfledger.session import filter_early
from shelfledger.sources.readers import register_slice, scan_rename

from .driver_tables import CFG, FINISH, SUBDIV_NAMES, DriverTables, code, tour_legs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def stable(df: DataFrame) -> DataFrame:
    """Comparable form: doubles to four digits, times as text, whole numbers as bigint."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(F.round(c.cast("double"), 7), 4)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """A local session that names no folder for checkpoints gets one, which goes with the process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None and sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return filter_early(spark)


def query(fn):
    """Register under the function's name; the function gets the tables."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: stable(fn(DriverTables(with_checkpoints(spark), sf_dir)))
    return fn


def step(name: str, fn: Callable[[Run], DataFrame]) -> None:
    """Register a step of the whole run."""
    QUERIES[name] = lambda spark, sf_dir: stable(fn(make_run(with_checkpoints(spark), sf_dir)))


def make_run(spark: SparkSession, sf_dir: str) -> Run:
    """A run over these tables; nothing is kept from one query to the next."""
    return Run(DriverTables(spark, sf_dir), FINISH, CFG, legs=tour_legs)


START = periods.add_months(FINISH, -3)
START_LONG = periods.add_months(FINISH, -12)
MONTHS = payroll.window_months(FINISH, 3)
SNAPSHOTS = periods.months_between(START, FINISH)


# ---- sources, projection, filters --------------------------------------------------------------

@query
def scan_rename_(t):
    cols = {"order_ref": "l_orderkey", "item_ref": "l_partkey", "item_qty": "l_quantity", "total": "l_extendedprice"}
    return scan_rename(t.raw("lineitem"), cols).withColumnRenamed("total", "item_sum")


QUERIES["scan_rename"] = QUERIES.pop("scan_rename_")


@query
def register_slice_(t):
    df = t.raw("orders").withColumn("active", F.col("o_orderstatus") != "P")
    return register_slice(df, "o_orderdate", START, FINISH, ["active"]).select("o_orderkey", "o_orderdate", "o_totalprice")


QUERIES["register_slice"] = QUERIES.pop("register_slice_")


@query
def epoch_shift(t):
    stored = t.raw("orders").select("o_orderkey", periods.shift_years(F.col("o_orderdate"), 2000).alias("o_orderdate"))
    return register_slice(stored.withColumn("stored", F.col("o_orderdate")), "o_orderdate", START_LONG, FINISH, shift=2000)


@query
def period_window(t):
    fin = periods.period_finish(F.to_date("o_orderdate"))
    return t.raw("orders").groupBy(fin.alias("window_finish"), F.add_months(fin, -3).alias("window_start"),
                                   F.add_months(fin, -12).alias("long_start")).agg(F.count("*").alias("n"))


@query
def month_calendar(t):
    months = periods.month_span(t.raw("orders"), "o_orderdate")
    n = t.raw("orders").groupBy(periods.month_floor(F.col("o_orderdate")).alias("date")).agg(F.count("*").alias("n"))
    return months.join(n, "date", "left").fillna(0, ["n"])


@query
def filter_in(t):
    return t.raw("lineitem").filter(semantics.in_local(F.col("l_returnflag"), ["A", "R"])).groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query
def filter_not_in_local(t):
    non_trade = inventory.non_trade_items(refs.item_root(t), CFG)
    return inventory.drop_non_trade(inventory.inv_current(t, FINISH, CFG), non_trade)


@query
def filter_not_in_sql(t):
    return inventory.open_stores(t, CFG)


@query
def filter_null(t):
    p, d = F.col("parent_ref"), F.col("distribution_ref")
    return t["store_dim"].filter(p.isNull() | (p == d)).select("store_id", "parent_ref", "distribution_ref")


@query
def global_min(t):
    df = t.register("delivery_order", "date_deliv_order", START)
    first = df.agg(F.min("date_deliv_order").alias("first"))
    return df.crossJoin(F.broadcast(first)).filter(F.col("date_deliv_order") == F.col("first")).groupBy(
        F.to_date("first").alias("first_day")).agg(F.count("*").alias("n"))


@query
def array_member(t):
    trips = t["trip"].select(F.col("ref").alias("trip_ref"), "route_ref")
    orders = refs.decode(t["trip_order"], "order_ref", t["delivery_order"], "address_ref")
    address = refs.decode(t["address_dim"].select("ref", "region_ref"), "region_ref", t["region_dim"], "region_id")
    df = refs.decode(orders.join(trips, "trip_ref"), "address_ref", address, address_region="region_id")
    df = refs.decode(df, "route_ref", t["route_dim"], "route_id").join(
        refs.ref_route(t).select("route_id", "regions"), "route_id", "left")
    inside = F.exists("regions", lambda r: r["region_id"].eqNullSafe(F.col("address_region")))
    return df.filter(inside).groupBy("route_id", "address_region").agg(F.count("*").alias("n"))


@query
def sort_multi(t):
    return t.raw("customer").select("c_mktsegment", "c_acctbal", "c_custkey").orderBy(
        "c_mktsegment", F.col("c_acctbal").desc(), "c_custkey")


# ---- joins -------------------------------------------------------------------------------------

@query
def join_left(t):
    df = rel.join_null_safe(t.raw("lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_quantity")
                            .groupBy("s_suppkey").agg(F.sum("l_quantity").alias("q")),
                            t.raw("supplier").select("s_suppkey", "s_nationkey"), ["s_suppkey"])
    df = df.join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return df.groupBy("n_name").agg(F.sum("q").alias("qty"), F.count("*").alias("suppliers"))


@query
def join_left_any(t):
    o = t.raw("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return rel.join_any(t.raw("customer").select("c_custkey", "c_mktsegment"), o, ["c_custkey"], ["o_orderkey"])


@query
def join_inner(t):
    return (t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")))


@query
def join_full(t):
    c = t.raw("customer").groupBy(F.col("c_custkey").alias("k")).agg(F.max("c_acctbal").alias("acctbal"))
    s = t.raw("supplier").groupBy((F.col("s_suppkey") * 20).alias("k")).agg(F.max("s_acctbal").alias("supplier_bal"))
    return c.join(s, "k", "full").fillna(0.0, ["acctbal", "supplier_bal"])


@query
def join_semi(t):
    f = t.raw("orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.raw("lineitem").join(f, "l_orderkey", "left_semi").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query
def join_self_parent(t):
    return refs.ref_group(t)


@query
def join_dual_role(t):
    df = t["trip"].select(F.col("ref").alias("trip_ref"), "nmbr_delivery")
    return logistics._people(t, df).drop("trip_ref")


@query
def join_polymorphic(t):
    m = t["stock_movement"].select("recorder_ref", "item_motion_qty")
    for name, kind in (("sale_doc", "sale"), ("transfer_out", "transfer"), ("check_report", "check")):
        m = m.join(t[name].select(F.col("ref").alias("recorder_ref"), F.lit(kind).alias(f"is_{kind}")), "recorder_ref", "left")
    kind = F.coalesce("is_sale", "is_transfer", "is_check").alias("document")
    return m.groupBy(kind).agg(F.count("*").alias("n"), F.sum("item_motion_qty").alias("qty"))


@query
def asof_price(t):
    """Each order line against the last price of its item set before the line's day."""
    lines = t.raw("lineitem").select(F.col("l_partkey").alias("item_ref"), F.to_date("l_shipdate").alias("day"),
                                     F.col("l_quantity").alias("item_qty"))
    prices = t["price_history"].select("item_ref", "date_setting", "item_price")
    df = rel.asof_join(lines, prices, "item_ref", "day", "date_setting", "item_price")
    return df.groupBy("item_ref").agg(
        F.count("*").alias("n"), F.count("item_price").alias("priced"),
        F.sum(F.col("item_qty") * F.col("item_price")).alias("value"))


# ---- aggregates and windows ----------------------------------------------------------------------

@query
def agg_sum(t):
    return t.raw("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sum_net"),
        semantics.r_sum(F.col("l_quantity")).alias("strict_qty"))


@query
def agg_sum_pair(t):
    return t["expense_register"].groupBy("subdiv_ref").agg((F.sum("exp_sum") + F.sum("exp_vat")).alias("with_vat"))


@query
def agg_two_level(t):
    m = t.raw("orders").groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("m")).agg(F.sum("o_totalprice").alias("s"))
    return m.groupBy("o_custkey").agg(semantics.bankers_round(F.avg("s")).alias("avr_month"), F.count("*").alias("months"))


@query
def agg_count(t):
    return t.raw("lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query
def agg_distinct(t):
    return t.raw("lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("orders"))


@query
def agg_distinct_pair(t):
    return t.raw("lineitem").groupBy("l_suppkey").agg(
        F.countDistinct(F.struct("l_partkey", "l_linenumber")).alias("pairs"))


@query
def agg_conditional(t):
    return t.raw("lineitem").groupBy("l_suppkey").agg(
        semantics.conditional_count(F.col("l_discount") > 0.05).alias("discounted"),
        semantics.conditional_count(F.col("l_returnflag") == "R").alias("returned"))


@query
def agg_minmax(t):
    return t.raw("lineitem").groupBy("l_partkey").agg(
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
        F.min("l_quantity").alias("min_qty"), F.max("l_quantity").alias("max_qty"))


@query
def set_distinct(t):
    return t.raw("lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query
def first_non_null(t):
    """Each person's position in the first known subdivision, on all their lines."""
    lines = t["payroll_line"].withColumn("position_ref", F.when(F.col("salary") > 5000, F.col("position_ref")))
    df = rel.first_known(lines, ["employee_ref"], "position_ref", ["subdiv_ref", "position_ref"], "first_position")
    return df.groupBy("employee_ref", "first_position").agg(F.count("*").alias("n"), F.count("position_ref").alias("known"))


@query
def mode_generator(t):
    label = F.concat("p_type", F.lit(" - "), F.col("p_size"), F.lit("%"))
    return t.raw("part").groupBy("p_brand").agg(semantics.most_common(views.generator_name(label)).alias("generator"))


@query
def win_share(t):
    g = t.raw("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("qty"))
    return rel.share_of(g, ["l_suppkey"], "qty", "share", 3)


@query
def win_share_global(t):
    g = t.raw("lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("qty"))
    return rel.share_of(g, [], "qty", "share", 4)


@query
def win_cumsum(t):
    g = t.raw("lineitem").groupBy("l_suppkey", F.trunc("l_shipdate", "month").alias("month")).agg(F.sum("l_quantity").alias("qty"))
    w = W.partitionBy("l_suppkey").orderBy(F.desc_nulls_last("month")).rowsBetween(W.unboundedPreceding, 0)
    return g.withColumn("running", F.sum("qty").over(w))


@query
def latest_per_key(t):
    return rel.latest_per_key(t["position_history"], ["individ_ref"], "date_rec")


@query
def union_by_name(t):
    a = t.raw("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("sales"))
    b = t.raw("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))
    return rel.union_by_name(a, b)


@query
def pivot_wide(t):
    return t.raw("lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))


@query
def unpivot_long(t):
    g = t.raw("lineitem").groupBy("l_suppkey").agg(
        F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("total"))
    return rel.transpose_long(g, ["l_suppkey"], [("qty", "quantity"), ("total", "sum")])


@query
def stop_explode(t):
    g = t.raw("lineitem").groupBy("l_orderkey").agg(
        F.array_join(F.array_sort(F.collect_set(code(F.col("l_suppkey")))), ", ").alias("store_list"))
    return logistics.stop_explode(g).groupBy("pos", "stop").agg(F.count("*").alias("n"))


@query
def clean_name(t):
    """Customer names behind the words the clean-up removes, each once or twice."""
    word = F.when(F.col("c_custkey") % 3 == 0, "ТоргівельнийЦентр Роздріб ").when(
        F.col("c_custkey") % 3 == 1, "роздріб роздріб ").otherwise("Кам'янець-Подільський |оздріб ")
    raw = F.concat(word, F.col("c_name"))
    return t.raw("customer").select("c_custkey", semantics.clean_name(raw, NAME_CLEANING).alias("name"))


# ---- dimensions ----------------------------------------------------------------------------------

@query
def ref_items(t):
    return refs.ref_items(t)


@query
def item_root(t):
    return refs.item_root(t)


@query
def ref_category(t):
    return refs.ref_category(t, CFG)


@query
def ref_store(t):
    return refs.ref_store(t)


@query
def ref_subdiv(t):
    return refs.ref_subdiv(t)


@query
def ref_area(t):
    return refs.ref_area(t, CFG)


@query
def ref_expense(t):
    return refs.ref_expense(t)


@query
def nest_regions(t):
    return refs.ref_route(t).select("route_id", "route", "route_parent", "subdiv_id", F.size("regions").alias("n_regions"),
                                    F.array_join(F.transform("regions", lambda r: F.coalesce(r["region_id"], F.lit("-"))), ",").alias("regions"))


@query
def ref_vehicle(t):
    return refs.ref_vehicle(t)


@query
def eav_lookup(t):
    return refs.subdiv_category(t, CFG)


@query
def shop_areas(t):
    return refs.shop_areas(refs.ref_area(t, CFG))


# ---- sales ---------------------------------------------------------------------------------------

@query
def sale_report(t):
    return sales.sale_report(t, START_LONG, FINISH, CFG)


@query
def sale_check_category(t):
    return sales.sale_check_category(t, START, FINISH, CFG)


@query
def category_cost(t):
    return sales.category_cost(t, START, FINISH, CFG)


@query
def service_profit(t):
    return sales.service_profit(t, START, FINISH)


@query
def sale_plan(t):
    return sales.sale_plan(t, START, FINISH)


@query
def sale_structure(t):
    return sales.sale_structure(sales.sale_check_category(t, START, FINISH, CFG), CFG)


step("sale_month", lambda r: r.sale_month)
step("sale_store", lambda r: sales.basket_figures(sales.sale_store(r.sale_store_month, FINISH, CFG)))
step("sale_store_zero_cost", lambda r: sales.sale_store(
    sales.sale_store_month(r.sale_month, missing_cost="zero"), FINISH, CFG))
step("store_class", lambda r: r.classes)
step("quarter_growth", lambda r: r.growth)
step("topk_category", lambda r: sales.revenue_generator(r.structure))
step("category_structure", lambda r: r.structure)


# ---- expenses, payroll, VAT ----------------------------------------------------------------------

@query
def expense_rows(t):
    return expenses.expense_rows(t, START_LONG, FINISH, CFG)


@query
def expense_clean(t):
    return expenses.expense_clean(expenses.expense_rows(t, START_LONG, FINISH, CFG), t, CFG)


@query
def expense_months(t):
    return expenses.expense_months(t, START_LONG, FINISH, CFG)


step("utilities_mean", lambda r: expenses.utilities_mean(r.expenses, FINISH, CFG))
step("rent_max", lambda r: expenses.rent_max(r.expenses, FINISH, CFG))
step("direct_costs", lambda r: r.direct_costs)


@query
def position_asof(t):
    return payroll.position_asof(t, MONTHS)


@query
def compensation(t):
    return payroll.compensation(t, START, FINISH, CFG)


@query
def salary_month(t):
    return payroll.salary_month(t, MONTHS, CFG)


step("salary_union", lambda r: r.salary)
step("payroll_store", lambda r: payroll.payroll_store(r.salary, r.categories, CFG))
step("payroll_support", lambda r: payroll.payroll_support(r.salary, r.categories, CFG))


@query
def account_balance(t):
    return vat.account_balance(t, MONTHS, CFG)


step("vat_allocate", lambda r: r.vat)

# ---- logistics -----------------------------------------------------------------------------------

step("stock_motion", lambda r: logistics.stock_motion(r.t, r.trade_stores, r.motion_start, FINISH, r.non_trade))
step("shipment_share", lambda r: r.shipment_share)
step("satellite_share", lambda r: r.satellite_share)
step("main_share", lambda r: r.main_share)
step("warehouse_cost", lambda r: r.warehouse_cost)
step("delivery_crews", lambda r: r.crews)
step("truck_cost_km", lambda r: r.truck_cost)
step("stop_list", lambda r: r.stop_list)
step("transport_store", lambda r: r.transport)


@query
def delivery_rows(t):
    return logistics.delivery_rows(t, START, FINISH)


@query
def delivery_clean(t):
    return logistics.delivery_clean(logistics.delivery_rows(t, START, FINISH), CFG)


@query
def delivery_orders(t):
    return logistics.delivery_orders(t, START, FINISH)


@query
def leg_allocate(t):
    return logistics.leg_allocate(t["legs"])


@query
def schedule_latest(t):
    return logistics.schedule_latest(t)


# ---- stock ---------------------------------------------------------------------------------------

@query
def inv_current(t):
    return inventory.inv_current(t, FINISH, CFG)


@query
def inv_current_batch(t):
    return inventory.inv_current_batch(t, FINISH, CFG)


@query
def inv_movement(t):
    return inventory.inv_movement(t, START, CFG)


@query
def inv_movement_batch(t):
    return inventory.inv_movement_batch(t, START, CFG)


@query
def inv_rollback(t):
    return inventory.inv_rollback(inventory.inv_history(t, START, FINISH, CFG), SNAPSHOTS)


@query
def inv_batch_rollback(t):
    return inventory.inv_batch_rollback(inventory.inv_batch_history(t, START, FINISH, CFG), SNAPSHOTS)


@query
def price_history(t):
    return inventory.price_history(t, START, CFG)


def _lifo(t):
    prices = inventory.prices_at(inventory.price_history(t, START, CFG), SNAPSHOTS)
    return inventory.inv_lifo_value(inventory.inv_history(t, START, FINISH, CFG),
                                    inventory.inv_batch_history(t, START, FINISH, CFG), prices, SNAPSHOTS)


@query
def inv_lifo_value(t):
    return _lifo(t)


@query
def inv_category(t):
    return inventory.inv_category(_lifo(t), t)


step("inv_snapshots", lambda r: r.snapshots)
step("inv_store_mean", lambda r: inventory.inv_store_mean(r.snapshots, r.trade_stores, r.t))


# ---- loyalty -------------------------------------------------------------------------------------

@query
def discount_lines(t):
    return loyalty.discount_lines(t, START, FINISH)


@query
def new_cards(t):
    return loyalty.new_cards(t, START, FINISH)


@query
def discount_class(t):
    return loyalty.discount_class(loyalty.discount_days(loyalty.discount_lines(t, START, FINISH)), t)


@query
def card_visits(t):
    return loyalty.card_visits(loyalty.discount_days(loyalty.discount_lines(t, START, FINISH)))


# ---- kept data -----------------------------------------------------------------------------------

def fresh_folder(t: DriverTables) -> str:
    """A new folder below the session's shared one."""
    return f"{t.spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"


def laid_out(t: DriverTables) -> LaidOut:
    """Check lines filed by the month of their report, the late ones as a batch of their own."""
    layout = LineLayout(t.spark, fresh_folder(t))
    heads = t["check_report"].select(F.col("ref").alias("report_ref"), "date")
    late = F.col("check_nmbr") % 9 == 0
    layout.add(t["check_line"].filter(~late), heads, "on-time", F.col("check_time"))
    layout.add(t["check_line"].filter(late), heads, "late", F.col("check_time"))
    return LaidOut(t, {"check_line": layout})


@query
def sale_report_laid_out(t):
    return sales.sale_report(laid_out(t), START_LONG, FINISH, CFG)


@query
def sale_structure_laid_out(t):
    return sales.sale_structure(sales.sale_check_category(laid_out(t), START, FINISH, CFG), CFG)


@query
def new_cards_kept(t):
    """First receipts taken in by batches, the newest first; some footers come a batch later or earlier."""
    kept = FirstReceipts(t.spark, fresh_folder(t))
    k = F.col("id")
    for batch in (2, 0, 1):
        kept.merge(t["receipt_header"].filter(k % 3 == batch), t["receipt_footer"].filter((k + F.when(k % 5 == 0, 1).otherwise(0)) % 3 == batch), t)
    return kept.new_cards(START, FINISH)


def closed_months(t: DriverTables) -> StockMonths:
    """The months of the window closed, one of them twice."""
    kept = StockMonths(t.spark, fresh_folder(t))
    kept.close(t, [*SNAPSHOTS[:-1], SNAPSHOTS[0]])
    return kept


@query
def inv_rollback_kept(t):
    moved = closed_months(t).moved(t, "stock", START)
    return inventory.inv_rollback(inventory.inv_history(t, START, FINISH, CFG, moved), SNAPSHOTS)


@query
def inv_batch_rollback_kept(t):
    moved = closed_months(t).moved(t, "batches", START)
    return inventory.inv_batch_rollback(inventory.inv_batch_history(t, START, FINISH, CFG, moved), SNAPSHOTS)


# ---- KPI table, views, rules ---------------------------------------------------------------------

step("store_kpis", lambda r: r.store_kpis)
step("card_stats", lambda r: r.cards)
step("category_kpis", lambda r: views.category_kpis(r.store_kpis))
step("category_matrix", lambda r: views.category_matrix(views.category_kpis(r.store_kpis)))
step("store_indicators", lambda r: views.store_indicators(r.store_kpis))
step("indicator_status", lambda r: views.indicator_status(views.store_indicators(r.store_kpis)))
step("share_matrix", lambda r: views.share_matrix(r.structure, r.classes, r.subdivs, SUBDIV_NAMES))
step("share_labels", lambda r: views.share_labels(r.structure, r.classes, r.subdivs, SUBDIV_NAMES))
step("quartiles", lambda r: r.q75.unionByName(r.q25))
step("store_benchmark", lambda r: views.store_benchmark(r.store_kpis, r.q75, r.q25))
step("benchmark_flags", lambda r: views.benchmark_flags(r.store_kpis, r.q75, r.q25))
step("card_indicators", lambda r: views.card_indicators(r.cards))
step("proposals", lambda r: r.proposals)
step("stores_of_class", lambda r: views.stores_of_class(r.store_kpis))

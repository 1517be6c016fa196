"""The driver's parquet tables seen as the logical tables of the library.

References are the native keys, so facts join and aggregate on integers; codes are
nine-digit texts that only dimension tables carry. Documents share one reference
space: sale 4k, refund 4k+1, transfer 4k+2 of order k, check reports negative.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfledger.config import (DISCOUNT_EARNED_NAME, DISCOUNT_ROUNDING, DISCOUNT_SPENT_NAME,
                                DROPPED_EXPENSES, FUEL_EXPENSE, MAINTENANCE_EXPENSES,
                                NON_DIRECT_EXPENSES, RENT_EXPENSE, SUPERMARKET_B2B, SUPERMARKET_B2C,
                                UTILITY_EXPENSES, Settings)
from shelfledger.functions.periods import add_months, month_span
from shelfledger.operators.logistics import tour_key
from shelfledger.sources.readers import Tables, register_slice

FINISH = date(2001, 4, 1)
CFG = Settings(
    subdiv_merge={"000000023": "000000007"},
    expense_subdiv_merge={"000000023": "000000007", "000000022": "000000019"},
    head_office=("000000020", "000000021"),
    rent_subdiv_merge={"000000018": "000000017"},
    service_subdiv_merge={"000000015": "000000014"},
    logistic_subdivs=("000000004", "000000016"),
    excluded_check_items=("000000007",),
    excluded_structure_categories=("PROMO",),
    excluded_expense_id="000000050",
    no_manager_subdivs=("000000012",),
    satellite_store="000000002",
    satellite_subdiv="000000016",
    accumulator_subdivs={"000000008": "000000009"},
    closed_parent_stores=("000000006",),
    non_trade_roots=("000000003",),
    excluded_routes=("000000010",),
    excluded_vehicles=("000000017",),
    extra_delivery=(("000000003", "000000011"),),
    excluded_delivery=(("000000002", "000000005"), ("000000001", "000000009")),
    extra_transport_subdiv="000000024",
    min_return_date=date(2000, 1, 1),
    motion_months=72,
    category_names={"MEDIUM": "16. Лайфстайл"},
)
EXPENSE_NAMES = (
    RENT_EXPENSE, UTILITY_EXPENSES[0], NON_DIRECT_EXPENSES[0], MAINTENANCE_EXPENSES[0], FUEL_EXPENSE,
    DROPPED_EXPENSES[0], "expense of another kind", MAINTENANCE_EXPENSES[2], UTILITY_EXPENSES[1], "expense of one more kind",
)
POSITIONS = {"purchase": "000000031", "click": "000000033", "view": "000000043",
             "error": "000000036", "signup": "000000041"}
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
SUBDIV_NAMES = tuple(f"NATION_{i}" for i in range(25))


def code(c: Column) -> Column:
    return F.when(c < 10**9, F.lpad(c.cast("string"), 9, "0")).otherwise(c.cast("string"))


def ym(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c)


def pick(c: Column, values: dict) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


class DriverTables(Tables):
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__()
        self.spark, self.dir, self._raw = spark, sf_dir, {}

    def raw(self, name: str) -> DataFrame:
        """A driver table, opened once; the known schema spares a footer job per table."""
        if name not in self._raw:
            self._raw[name] = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.dir}/{name}.parquet")
        return self._raw[name]

    def _load(self, name: str) -> DataFrame:
        return getattr(self, f"_{name}")()

    # ---- dimensions
    def _subdiv_dim(self):
        first = self.raw("supplier").groupBy(F.col("s_nationkey").alias("n")).agg(
            F.min("s_suppkey").alias("store_ref"))
        n = self.raw("nation").join(first, F.col("n_nationkey") == F.col("n"), "left")
        k = F.col("n_nationkey").cast("bigint")
        return n.select(k.alias("ref"), code(k).alias("subdiv_id"), F.col("n_name").alias("subdiv_name"),
                        F.col("n_regionkey").cast("bigint").alias("parent_ref"), "store_ref",
                        (k == 24).alias("marked"))

    def _store_dim(self):
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            k.alias("ref"), code(k).alias("store_id"), F.col("s_name").alias("store_name"),
            F.concat(F.lit("loc "), F.col("s_nationkey")).alias("store_location"),
            F.col("s_nationkey").cast("bigint").alias("subdiv_ref"), (k % 5).alias("distribution_ref"),
            F.when(k % 11 != 0, k % 7).alias("parent_ref"), (k % 13 == 12).alias("marked"))

    def _item_dim(self):
        k = F.col("p_partkey")
        up = F.floor(k / 10)
        return self.raw("part").select(
            k.alias("ref"), code(k).alias("item_id"), F.col("p_name").alias("item_name"),
            F.col("p_size").alias("pack_qty"), (F.col("p_size") % 10).alias("price_group_ref"),
            F.concat_ws("/", "p_brand", "p_type").alias("group_ref"),
            F.when(up > 0, up).alias("parent_ref"), k.alias("unit_ref"),
            (F.col("p_size") % 2 == 0).alias("is_tva"), (F.col("p_size") == 50).alias("item_marked"))

    def _price_group_dim(self):
        g = F.col("p_size") % 10
        return self.raw("part").select(g.alias("ref"), F.concat(F.lit("PG "), g).alias("price_group")).distinct()

    def _group_dim(self):
        g = F.concat_ws("/", "p_brand", "p_type")
        return self.raw("part").select(
            g.alias("ref"), g.alias("group_id"), F.col("p_brand").alias("group_name"),
            F.when(F.col("p_brand") != "Brand#13", F.col("p_type")).alias("category_ref"),
            F.concat(F.lit("Brand#1/"), F.col("p_type")).alias("parent_ref"),
            (F.col("p_brand") == "Brand#25").alias("group_marked")).distinct()

    def _category_dim(self):
        c = F.col("p_type")
        return self.raw("part").select(c.alias("ref"), c.alias("category_id"),
                                       F.lower(c).alias("category_name"),
                                       (c == "PROMO").alias("is_marked")).distinct()

    def _unit_dim(self):
        s = F.col("p_size")
        return self.raw("part").select(
            F.col("p_partkey").alias("ref"), s.alias("width"), (s * 2).alias("height"),
            (s + 1).alias("depth"), (F.col("p_retailprice") / 100).alias("weight"),
            (s / F.lit(10.0)).alias("volume"))

    def _organization_dim(self):
        k = (F.col("n_nationkey") % 3).cast("bigint")
        return self.raw("nation").select(k.alias("ref"), code(k).alias("organization_id")).distinct()

    def _project_dim(self):
        k = F.col("r_regionkey").cast("bigint")
        return self.raw("region").select(k.alias("ref"), code(k).alias("project_id"), F.col("r_name").alias("project"))

    def _region_dim(self):
        k = F.col("r_regionkey").cast("bigint")
        return self.raw("region").select(k.alias("ref"), code(k).alias("region_id"))

    def _locality_dim(self):
        k = F.col("n_nationkey").cast("bigint")
        return self.raw("nation").select(k.alias("ref"), code(k).alias("locality_id"))

    def _partner_dim(self):
        return self.raw("customer").select(F.col("c_custkey").alias("ref"),
                                           code(F.col("c_custkey")).alias("customer_id"))

    def _address_dim(self):
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            k.alias("ref"), code(k).alias("deliv_address_id"), (k % 17 == 16).alias("marked"),
            (k % 6 != 5).alias("is_main"), k.alias("owner_ref"),
            F.col("s_nationkey").cast("bigint").alias("locality_ref"),
            (F.col("s_nationkey") % 5).cast("bigint").alias("region_ref"),
            (45.0 + k % 10).alias("lat"), (22.0 + k % 15).alias("long"))

    def _area_register(self):
        day = F.when(F.col("s_suppkey") % 2 == 0, F.lit("2000-01-01")).otherwise(F.lit("2001-01-01"))
        parts = F.array(*[F.struct(F.lit(i).alias("type_ref"), F.lit(f).alias("f"))
                          for i, f in enumerate((1.0, 0.7, 0.2, 0.1, 0.05))])
        size = 20 + F.abs("s_acctbal") / 50
        return (self.raw("supplier")
                .select(day.cast("timestamp").alias("date"), F.col("s_nationkey").cast("bigint").alias("subdiv_ref"),
                        size.alias("size"), F.explode(parts).alias("p"))
                .groupBy("date", "subdiv_ref", F.col("p.type_ref").alias("type_ref"))
                .agg(F.max(F.floor(F.col("size") * F.col("p.f")).cast("double")).alias("area_value"))
                .withColumn("active", F.lit(True)))

    def _area_type(self):
        k = F.col("n_nationkey") % 5
        return self.raw("nation").select(k.alias("ref"), k.alias("enum_order")).distinct()

    def _expense_item(self):
        k = F.col("p_size")
        name = pick(k, {i + 1: n for i, n in enumerate(EXPENSE_NAMES)}).otherwise(F.concat(F.lit("expense "), k))
        up = F.when(k > 30, k - 20).when(k > 10, (k - 1) % 10 + 1)
        return self.raw("part").select(k.alias("ref"), code(k).alias("id"), name.alias("name"),
                                       up.alias("parent_ref"), F.lit(False).alias("marked")).distinct()

    def _route_dim(self):
        k = F.col("c_custkey") % 12
        return self.raw("customer").select(k.alias("r")).distinct().select(
            F.col("r").alias("ref"), code(F.col("r")).alias("route_id"),
            F.concat(F.lit("route "), F.col("r")).alias("route"), (F.col("r") % 3).alias("parent_ref"),
            F.col("r").alias("subdiv_ref"), F.lit(False).alias("route_marked"))

    def _route_region(self):
        r = F.col("ref")
        regions = F.array(*[F.when((r + i) % 2 == 0, F.lit(i)) for i in range(5)])
        return self["route_dim"].select(
            r.alias("route_ref"),
            F.explode(F.filter(F.concat(regions, F.when(r == 11, F.array(F.lit(-1))).otherwise(
                F.array().cast("array<int>"))), lambda x: x.isNotNull())).alias("g")).select(
            "route_ref", F.when(F.col("g") >= 0, F.col("g")).cast("bigint").alias("region_ref"))

    def _vehicle_dim(self):
        k = F.col("v")
        return self.raw("customer").select((F.col("c_custkey") % 20).alias("v")).distinct().filter(k != 19).select(
            k.alias("ref"), code(k).alias("auto_id"), F.concat(F.lit("auto "), k).alias("auto_name"),
            (k == 18).alias("marked"), (k % 25).alias("subdiv_ref"), (k % 5).alias("store_ref"),
            (k % 4 != 3).alias("is_cargo"), (k * 100.0).alias("load_capacity"),
            (k * 2.0).alias("volume"), (k + 40.0).alias("tank"))

    def _property_value(self):
        """Class of every subdivision but the two logistic ones, which do not trade."""
        k = F.col("n_nationkey").cast("bigint")
        return self.raw("nation").filter(~k.isin(4, 16)).select(
            k.alias("object_ref"), F.explode(F.array(F.lit(0), F.lit(1))).alias("property_ref"),
            (k % 4).alias("value_ref"))

    def _property_kind(self):
        k = F.col("n_nationkey") % 2
        return self.raw("nation").select(k.alias("ref"), F.when(k == 1, "000000191").otherwise("000000192").alias("code")).distinct()

    def _property_name(self):
        k = F.col("n_nationkey").cast("bigint") % 4
        return self.raw("nation").select(k.alias("ref"), pick(k, {0: SUPERMARKET_B2B, 1: SUPERMARKET_B2C}).otherwise("Магазини").alias("name")).distinct()

    def _direction_dim(self):
        p = F.col("o_orderpriority")
        return self.raw("orders").select(p.alias("ref"), F.when(p == "5-LOW", "САМОВИВІЗ").otherwise(p).alias("direction")).distinct()

    def _scenario_dim(self):
        p = F.col("o_orderpriority")
        return self.raw("orders").select(p.alias("ref"), p.alias("script_name")).distinct()

    def _account_dim(self):
        k = F.col("o_orderkey") % 2
        return self.raw("orders").select(k.alias("ref"), F.when(k == 1, "6412").otherwise("631").alias("acc_id")).distinct()

    def _price_type_dim(self):
        k = F.col("r_regionkey").cast("bigint")
        return self.raw("region").select(k.alias("ref"), code(k + 4).alias("price_type_id"))

    # ---- sales
    def _check_report(self):
        months = month_span(self.raw("orders"), "o_orderdate")
        n, m = F.col("n_nationkey").cast("bigint"), F.col("m")
        # 25 nations by the months of the data: both sides are bounded.
        df = self.raw("nation").crossJoin(F.broadcast(months)).withColumn("m", ym(F.col("date")))
        return df.select((-(n * 100000 + m)).alias("ref"), ((n + m) % 29 != 0).alias("posted"),
                         ((n * 3 + m) % 37 != 0).alias("is_managerial"),
                         F.col("date").cast("timestamp").alias("date"),
                         code(n * 100000 + m).alias("nmbr_checks_report"),
                         (n % 3).alias("organization_ref"), n.alias("subdiv_ref"))

    def lines_of(self, name, heads, key, window=None):
        """Lines stand under the report of their order's month, so a window of reports is one of orders."""
        if window is None or name not in ("check_line", "check_regular"):
            return super().lines_of(name, heads, key)
        first, last = window[0].replace(day=1), add_months((window[1] - timedelta(days=1)).replace(day=1), 1)
        orders = register_slice(self.raw("orders"), "o_orderdate", first, last)
        return getattr(self, f"_{name}")(orders).join(heads, key)

    def _lines(self, orders: DataFrame | None = None):
        orders = self.raw("orders") if orders is None else orders
        line = self.raw("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return line.join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))

    @staticmethod
    def _report_ref(nation: Column, ts: Column) -> Column:
        return -(nation.cast("bigint") * 100000 + ym(ts))

    def _check_line(self, orders: DataFrame | None = None):
        return self._lines(orders).select(
            self._report_ref(F.col("s_nationkey"), F.col("o_orderdate")).alias("report_ref"),
            # some checks were rung outside the month of their report
            F.col("l_orderkey").alias("check_nmbr"),
            F.when(F.col("l_orderkey") % 9 == 0, F.col("o_orderdate") - F.expr("interval 400 days"))
            .otherwise(F.col("o_orderdate")).alias("check_time"),
            F.col("l_partkey").alias("item_ref"), F.col("l_quantity").alias("item_qty"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("item_sum"))

    def _check_regular(self, orders: DataFrame | None = None):
        orders = self.raw("orders") if orders is None else orders
        c = self.raw("customer").filter(F.col("c_mktsegment") == "BUILDING")
        return orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
            self._report_ref(F.col("c_nationkey"), F.col("o_orderdate")).alias("report_ref"),
            F.col("o_totalprice").alias("reg_cust_sum"))

    def _cost_register(self):
        k, back = F.col("l_orderkey"), F.col("l_returnflag") == "R"
        retail = F.col("l_linestatus") == "O"
        cost = F.col("p_retailprice") * F.col("l_quantity")
        signed = F.when(~retail & back, -cost).otherwise(cost)
        df = self._lines().join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
        return df.select(
            F.col("o_orderdate").alias("date"), (F.col("l_linenumber") != 7).alias("active"),
            F.col("s_nationkey").cast("bigint").alias("subdiv_ref"),
            (F.col("s_nationkey") % 5).cast("bigint").alias("project_ref"),
            F.when(retail, self._report_ref(F.col("s_nationkey"), F.col("o_orderdate")))
            .when(back, k * 4 + 1).otherwise(k * 4).alias("doc_ref"),
            F.col("l_partkey").alias("item_ref"), F.col("l_quantity").alias("item_qty"),
            signed.alias("item_cost_sum"), (signed * F.col("l_tax")).alias("item_cost_vat"))

    def _sale_register(self):
        line = self.raw("lineitem").filter(F.col("l_linestatus") == "F").join(
            self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        c = F.col("o_custkey")
        return line.select(
            F.col("o_orderdate").alias("date"), (F.col("l_linenumber") != 7).alias("active"),
            (c % 25).alias("subdiv_ref"), (c % 3).alias("organization_ref"),
            (F.col("l_orderkey") * 4).alias("sale_doc_ref"), F.col("l_partkey").alias("item_ref"),
            (c % 5).alias("project_ref"), F.col("l_quantity").alias("item_qty"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("item_sum"),
            (F.col("l_extendedprice") * F.col("l_tax")).alias("item_vat"))

    def _sale_doc(self):
        k = F.col("o_orderkey")
        return self.raw("orders").select(
            (k * 4).alias("ref"), code(k).alias("sale_doc_nmbr"), F.col("o_orderdate").alias("sale_doc_date"),
            F.col("o_custkey").alias("customer_ref"), (F.col("o_custkey") % 25).alias("subdiv_ref"))

    def _refund_doc(self):
        k = F.col("o_orderkey")
        return self.raw("orders").select(
            (k * 4 + 1).alias("ref"), F.lit(True).alias("posted"),
            (F.col("o_orderpriority") != "1-URGENT").alias("is_managerial"),
            F.concat(F.lit("R"), code(k)).alias("nmbr_refund_doc"), F.col("o_orderdate").alias("date_refund_doc"))

    def _refund_line(self):
        k = F.col("l_orderkey")
        return self.raw("lineitem").filter((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")).select(
            (k * 4 + 1).alias("refund_ref"), F.col("l_partkey").alias("item_ref"),
            F.col("l_quantity").alias("item_qty"), (k * 4).alias("sale_doc_ref"))

    def _sale_plan(self):
        c = F.col("o_custkey")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("ref"), (F.col("o_orderstatus") != "P").alias("posted"),
            F.col("o_orderdate").alias("date"), (c % 25).alias("subdiv_ref"), (c % 5).alias("project_ref"),
            F.col("o_orderpriority").alias("script_ref"), F.col("o_totalprice").alias("sum"))

    # ---- point of sale
    def _receipt_header(self):
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        return self.raw("orders").select(
            (k % 100).alias("cash_id"), k.alias("id"), F.col("o_orderdate").alias("date"),
            F.when(c % 10 != 0, code(c)).alias("client"),
            F.when(F.col("o_orderstatus") == "P", 4).otherwise(0).alias("type"), k.alias("global_number"),
            F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0).alias("deleted"))

    def _receipt_footer(self):
        k = F.col("o_orderkey")
        return self.raw("orders").select((k % 100).alias("cash_id"), k.alias("id"),
                                         F.when(k % 17 == 0, 1).otherwise(0).alias("result"),
                                         F.lit(0).alias("deleted"))

    def _receipt_discounts(self):
        k = F.col("o_orderkey")
        names = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name")) for i, n in enumerate(
            (DISCOUNT_EARNED_NAME, DISCOUNT_SPENT_NAME, "Акція", DISCOUNT_ROUNDING))])
        return self.raw("orders").select((k % 100).alias("cash_id"), k.alias("receipt_header"),
                                         F.explode(names).alias("d")).select(
            "cash_id", "receipt_header", "d.id", "d.name", F.lit(0).alias("deleted"))

    _LINE_ID = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

    def _receipt_item(self):
        k = F.col("l_orderkey")
        return self.raw("lineitem").select(
            (k % 100).alias("cash_id"), F.concat_ws("-", *self._LINE_ID).alias("id"), k.alias("receipt_header"),
            code(F.col("l_partkey")).alias("item"), F.col("l_quantity").alias("total_quantity"),
            F.col("l_linenumber").alias("position"), F.lit(0).alias("deleted"))

    def _receipt_item_discount(self):
        n = F.col("l_linenumber") % 4
        price = F.col("l_extendedprice")
        return self.raw("lineitem").select(
            (F.col("l_orderkey") % 100).alias("cash_id"), F.concat_ws("-", *self._LINE_ID).alias("receipt_item"),
            n.alias("receipt_discount"), price.alias("base_total"),
            (-price * F.col("l_discount")).alias("increment"),
            F.when(n == 0, price * 0.05).otherwise(0.0).alias("account_increment"), F.lit(0).alias("deleted"))

    def _pos(self):
        k = F.col("s_suppkey")
        return self.raw("supplier").select(k.alias("cash_id"), (k + 1000).alias("store_id"))

    def _pos_store(self):
        k = F.col("s_suppkey")
        return self.raw("supplier").select((k + 1000).alias("store_id"), code(k).alias("code_subdivision"))

    # ---- expenses, payroll, ledger
    def _expense_register(self):
        df = (self.raw("lineitem").join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
              .join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey")))
        return df.select(
            F.col("l_shipdate").alias("date"), (F.col("l_linenumber") != 6).alias("active"),
            (F.col("l_linenumber") % 2).alias("type_exp"), F.col("s_nationkey").cast("bigint").alias("subdiv_ref"),
            F.col("p_size").alias("exp_item_ref"), (F.col("s_nationkey") % 5).cast("bigint").alias("project_ref"),
            F.col("l_extendedprice").alias("exp_sum"), (F.col("l_extendedprice") * F.col("l_tax")).alias("exp_vat"))

    @staticmethod
    def _pay_ts(ts: Column) -> Column:
        """Event time spread over the reporting quarter: three days per event day."""
        days = (F.dayofmonth(ts) - 1) * 3 - F.datediff(ts, F.lit("2001-01-01").cast("date"))
        return ts + F.make_dt_interval(days)

    def _events(self):
        return self.raw("events").withColumn("day", F.dayofmonth("ts")).withColumn("at", self._pay_ts(F.col("ts")))

    def _payroll_doc(self):
        d = F.col("day")
        return self._events().select("day", F.date_trunc("day", "at").alias("date")).distinct().select(
            d.alias("ref"), "date", (d != 30).alias("posted"), d.alias("period_reg"), (d != 29).alias("is_managerial"))

    def _payroll_line(self):
        return self._events().select(
            F.col("day").alias("doc_ref"), F.col("user_id").alias("employee_ref"),
            F.col("event_type").alias("position_ref"),
            F.when(F.col("event_id") % 10 != 0, F.col("user_id") % 25).alias("subdiv_ref"),
            (F.col("value") * 100).alias("salary"), F.col("value").alias("working_hours"),
            (F.col("event_id") % 3 * 100).cast("double").alias("norm_hours"))

    def _contribution_line(self):
        return self._events().select(F.col("day").alias("doc_ref"), F.col("user_id").alias("employee_ref"),
                                     (F.col("value") * 22).alias("sum"))

    def _tax_line(self):
        return self._events().select(F.col("day").alias("doc_ref"), F.col("user_id").alias("employee_ref"),
                                     (F.col("value") * 18).alias("sum"))

    def _employee_dim(self):
        u = F.col("user_id")
        return self.raw("events").select(u.alias("ref"), (u % 3).alias("organization_ref"), u.alias("individ_ref")).distinct()

    def _individual_dim(self):
        u = F.col("user_id")
        return self.raw("events").select(u.alias("ref"), code(u).alias("individ_id")).distinct()

    def _position_dim(self):
        e = F.col("event_type")
        return self.raw("events").select(e.alias("ref"), pick(e, POSITIONS).alias("position_id")).distinct()

    def _position_history(self):
        return self._events().select(F.col("at").alias("date_rec"), F.col("user_id").alias("individ_ref"),
                                     (F.col("user_id") % 25).alias("subdiv_ref"), F.col("event_type").alias("position_ref"))

    def _charge(self):
        u = F.col("user_id")
        return self._events().select(
            F.col("at").alias("date"), (F.col("event_id") % 7 != 0).alias("is_active"), u.alias("employee_ref"),
            F.col("event_type").alias("kind_ref"), (u % 3).alias("organization_ref"),
            F.col("value").alias("compensation_sum"), (u % 25).alias("subdiv_ref"))

    def _charge_kind(self):
        e = F.col("event_type")
        return self.raw("events").select(e.alias("ref"), F.when(e == "purchase", "00019").otherwise("00001").alias("code")).distinct()

    def _tax_rate(self):
        u = F.col("user_id")
        return self._events().select(
            F.col("at").alias("date"), F.lit(True).alias("is_active"), u.alias("employee_ref"),
            (u % 3).alias("organization_ref"), F.col("event_type").alias("kind_ref"),
            pick(u % 3, {0: 0.18, 1: 0.2, 2: 0.0}).alias("tax_rate"))

    def _tax_kind(self):
        e = F.col("event_type")
        return self.raw("events").select(e.alias("ref"), F.when(e == "click", "00014").otherwise("00002").alias("code")).distinct()

    def _ledger(self):
        s = F.col("o_orderstatus")
        return self.raw("orders").select(
            F.col("o_orderdate").alias("date"), (F.col("o_orderpriority") != "5-LOW").alias("active"),
            F.when(s == "F", F.lit(1)).otherwise(0).cast("bigint").alias("account_dt_ref"),
            F.when(s == "O", F.lit(1)).otherwise(0).cast("bigint").alias("account_ct_ref"),
            (F.col("o_custkey") % 3).alias("organization_ref"), F.col("o_totalprice").alias("moving_sum"))

    # ---- stock
    def _stock(self):
        q = F.col("l_quantity")
        return self.raw("lineitem").select(
            "*", F.col("l_suppkey").alias("store_ref"), F.col("l_partkey").alias("item_ref"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("type_motion"),
            F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("sgn"), q.alias("item_motion_qty"))

    def _stock_movement(self):
        k, n = F.col("l_orderkey"), F.col("l_linenumber") % 3
        recorder = (F.when(n == 0, k * 4).when(n == 1, k * 4 + 2)
                    .otherwise(self._report_ref(F.col("l_suppkey") % 25, F.col("l_shipdate"))))
        return self._stock().select(
            F.col("l_shipdate").alias("date_movement"), F.lit(True).alias("active"),
            recorder.alias("recorder_ref"), "store_ref", "item_ref", "type_motion", "item_motion_qty")

    def _batches(self):
        s = F.col("l_suppkey")
        vat = F.col("l_extendedprice") * F.when(F.col("l_tax") >= 0.05, 0.2).otherwise(F.col("l_tax"))
        return (self._stock().filter(((F.col("l_linestatus") == "F") | (s % 3 == 0)) & (s % 10 != 9))
                .withColumn("item_store_sum", F.col("l_extendedprice")).withColumn("item_store_vat", vat)
                # two receipts a month, on the same day
                .withColumn("receipt_doc_ref", ym(F.col("l_shipdate")) * 2 + F.col("l_linenumber") % 2))

    def _batch_movement(self):
        return self._batches().select(
            F.col("l_shipdate").alias("date_movement"), F.lit(True).alias("active"), "store_ref", "item_ref",
            "type_motion", "item_motion_qty", "item_store_sum", "item_store_vat", "receipt_doc_ref")

    def _stock_balance(self):
        return self._stock().select(
            F.lit("3999-11-01").cast("timestamp").alias("date_balance"), "store_ref", "item_ref",
            (F.col("sgn") * F.col("item_motion_qty")).alias("item_store_qty"))

    def _batch_balance(self):
        s = F.col("sgn")
        return self._batches().select(
            F.lit("3999-11-01").cast("timestamp").alias("date_balance"), "store_ref", "item_ref",
            (s * F.col("item_motion_qty")).alias("item_store_qty"),
            (s * F.col("item_store_sum")).alias("item_store_sum"),
            (s * F.col("item_store_vat")).alias("item_store_vat"), "receipt_doc_ref")

    def _months(self, odd: int):
        half = F.explode(F.array(F.lit(0), F.lit(1))).alias("half")
        return month_span(self.raw("lineitem"), "l_shipdate").filter(ym(F.col("date")) % 2 == odd).select("date", half).select(
            (ym(F.col("date")) * 2 + F.col("half")).alias("ref"),
            (F.col("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("half") * 9 + 8)).alias("date"))

    def _receipt_doc(self):
        return self._months(0)

    def _assembly_doc(self):
        return self._months(1)

    def _price_history(self):
        """Two settings a day: the dearest price in the morning, the cheapest in the evening."""
        price = F.col("p")
        # an item has few lines a day, so lines are dealt by item: its days need not move again
        lines = self.raw("lineitem").select(
            F.col("l_partkey").alias("item_ref"), F.date_trunc("day", "l_shipdate").alias("day"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("p")).repartition("item_ref")
        day = lines.groupBy("item_ref", "day").agg(
            F.array(F.struct(F.lit(8).alias("h"), F.max(price).alias("p")), F.struct(F.lit(18).alias("h"), F.min(price).alias("p"))).alias("s"))
        return day.select("item_ref", "day", F.explode("s").alias("s")).select(
            "item_ref", (F.col("day") + F.make_dt_interval(F.lit(0), F.col("s.h"))).alias("date_setting"),
            F.col("s.p").alias("item_price"), F.lit(1).cast("bigint").alias("price_type_ref"), F.lit(True).alias("active"))

    # ---- delivery
    def _transfer_out(self):
        k = F.col("o_orderkey")
        return self.raw("orders").select((k * 4 + 2).alias("ref"), F.concat(F.lit("T"), code(k)).alias("nmbr"),
                                         F.col("o_orderdate").alias("date"),
                                         (F.col("o_custkey") % 100).alias("receiver_store_ref"))

    def _trip(self):
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        dep = F.col("o_orderdate") + F.expr("interval 8 hours")
        ret = (F.when(k % 10 == 0, dep - F.expr("interval 18 hours")).when(k % 10 == 1, dep - F.expr("interval 1 year") + F.expr("interval 5 hours"))
               .when(k % 10 == 2, dep - F.expr("interval 3 hours"))
               .when(k % 10 == 3, F.lit("0001-01-02").cast("timestamp_ntz"))  # never set
               .otherwise(dep + F.make_dt_interval(F.lit(0), (2 + k % 7).cast("int"))))
        start = (k % 1000 + 1).cast("double")
        return self.raw("orders").select(
            k.alias("ref"), (k % 23 != 0).alias("posted"), code(k).alias("nmbr_delivery"),
            F.col("o_orderdate").alias("date_delivery"), (c % 5).alias("store_ref"), dep.alias("time_depart"),
            ret.alias("time_return"), F.col("o_orderpriority").alias("direction_ref"), (c % 12).alias("route_ref"),
            (c % 20).alias("vehicle_ref"), F.col("o_totalprice").alias("delivery_weight"), start.alias("speedo_start"),
            F.when(k % 19 == 0, F.lit(0.0)).otherwise(start + F.floor(F.col("o_totalprice") / 1000)).alias("speedo_finish"))

    def _trip_forwarder(self):
        return self.raw("orders").select(F.col("o_orderkey").alias("trip_ref"), (F.col("o_custkey") % 41).alias("individ_ref"))

    def _trip_driver(self):
        return self.raw("orders").select(F.col("o_orderkey").alias("trip_ref"), (F.col("o_custkey") % 37).alias("individ_ref"))

    def _stops(self):
        g = self.raw("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("weight"))
        return g.withColumn("order_ref", F.concat_ws("-", "l_orderkey", "l_suppkey"))

    def _trip_order(self):
        s = F.col("l_suppkey")
        return self._stops().select(F.col("l_orderkey").alias("trip_ref"), "order_ref",
                                    (s % 9 == 0).alias("to_intermediate"), (s % 8 == 7).alias("is_not_delivered"))

    def _delivery_order(self):
        s, k, c = F.col("l_suppkey"), F.col("l_orderkey"), F.col("o_custkey")
        df = self._stops().filter(s % 12 != 0).join(self.raw("orders"), k == F.col("o_orderkey"))
        return df.select(
            F.col("order_ref").alias("ref"), F.lit(True).alias("posted"), F.col("order_ref").alias("nmbr_deliv_order"),
            F.col("o_orderdate").alias("date_deliv_order"), "weight", (c % 5).alias("store_ref"), s.alias("address_ref"),
            s.alias("recipient_ref"), F.when(s % 9 == 0, c % 5).alias("intermediate_ref"),
            F.when(s % 2 == 0, k * 4).otherwise(k * 4 + 2).alias("base_doc_ref"))

    def _luggage_note(self):
        s, k = F.col("l_suppkey"), F.col("l_orderkey")
        return self._stops().filter(s % 12 == 0).join(self.raw("orders"), k == F.col("o_orderkey")).select(
            F.col("order_ref").alias("ref"), F.concat(F.lit("L"), code(k)).alias("nmbr"), F.col("o_orderdate").alias("date"))

    def _delivery_schedule(self):
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        return self.raw("orders").select(
            F.col("o_orderdate").alias("date"), (c % 100).alias("recipient_ref"), (c % 5).alias("distribution_ref"),
            *[((k + i) % 2 == 0).alias(f"day_{i}") for i in range(1, 8)])

    def _legs(self):
        """One tour per order: its distinct suppliers in key order, the quantity as distance."""
        stops = self._stops().select(F.col("l_orderkey").alias("trip_key"), "l_suppkey",
                                     F.col("weight").alias("distance"))
        place = F.row_number().over(W.partitionBy("trip_key").orderBy("l_suppkey"))
        return stops.select("trip_key", place.alias("leg_no"), code(F.col("l_suppkey")).alias("end"), "distance")


def tour_legs(tours: DataFrame) -> DataFrame:
    """Stand-in for the route service: stops in list order, back to the start at the end."""
    stops = F.split("store_list", ", ")
    path = F.concat(F.array("delivery_store"), stops, F.array("delivery_store"))
    leg = F.col("l")
    a, b = leg["a"].cast("bigint"), leg["b"].cast("bigint")
    legs = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.struct(
        i.alias("leg_no"), F.element_at(path, i).alias("a"), F.element_at(path, i + 1).alias("b")))
    return tours.select(tour_key().alias("trip_key"), F.explode(legs).alias("l")).select(
        "trip_key", leg["leg_no"].alias("leg_no"), leg["b"].alias("end"),
        ((a * 7 + b * 13) % 50 + 1).cast("double").alias("distance"))

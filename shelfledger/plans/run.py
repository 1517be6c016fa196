"""The whole calculation as one object of named, lazily built steps."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.periods import add_months, period_finish_of
from ..kept.steps import Checkpointed
from ..operators import expenses, inventory, logistics, loyalty, payroll, refs, sales, vat
from ..sources.readers import Tables, cut_lineage
from . import kpi, rules, views


class Run:
    """Steps of one reporting period; each is planned once, on first use.

    The eight aggregates of facts that several results read (report months, expense months,
    pay, units moved, crews, stops, stock values, discount days) go through ``keep``: the
    facts are then scanned and shuffled once, and a lost executor does not bring the scan
    back. With a :class:`StepStore` they also outlive the run, so one that died goes on
    where it stopped. All other steps are lazy plans over these; what goes into the KPI table
    and the table itself are checkpoints of a few rows per store, as a plan over all of them at
    once, several times over in the views, is more than a driver of 1 GB holds.
    ``legs`` maps the stop lists to the tours of an outside route service
    (``trip_key, leg_no, end, distance``).
    """

    def __init__(self, tables: Tables, finish: date, cfg: Settings | None = None,
                 legs: Callable[[DataFrame], DataFrame] | None = None, as_of: date | None = None,
                 keep: Callable[..., DataFrame] | None = None) -> None:
        self.t, self.finish, self.cfg = tables, finish, cfg or Settings()
        self.as_of = as_of or finish
        self.legs, self.keep = legs, keep or Checkpointed()
        self.start = add_months(finish, -self.cfg.months_back)
        self.start_long = add_months(finish, -self.cfg.months_back_long)
        self.motion_start = add_months(finish, -self.cfg.motion_months)
        self.months = payroll.window_months(finish, self.cfg.months_back)

    @classmethod
    def for_day(cls, tables: Tables, as_of: date, **kw) -> Run:
        return cls(tables, period_finish_of(as_of), as_of=as_of, **kw)

    def _kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return self.keep(name, build, self.finish, self.as_of)

    def _cut(self, df: DataFrame) -> DataFrame:
        """``df`` computed now, so that what reads it is not planned with it again.

        A checkpoint; kept in memory where the session names no folder for these.
        """
        spark = df.sparkSession
        named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
        return cut_lineage(df) if named else df.persist()

    def _settle(self, *steps: str) -> None:
        """Cut steps one after another: the driver holds the plan of one, not of all that read it."""
        for s in steps:
            self.__dict__[s] = self._cut(getattr(self, s))

    # dimensions
    @cached_property
    def categories(self) -> DataFrame:
        return refs.subdiv_category(self.t, self.cfg)

    @cached_property
    def trade_stores(self) -> DataFrame:
        return refs.trade_stores(self.t, self.cfg)

    @cached_property
    def satellites(self) -> DataFrame:
        return refs.satellite_stores(self.t, self.cfg)

    @cached_property
    def subdivs(self) -> DataFrame:
        return refs.ref_subdiv(self.t)

    @cached_property
    def areas(self) -> DataFrame:
        return refs.ref_area(self.t, self.cfg)

    @cached_property
    def non_trade(self) -> DataFrame:
        # a plan over rounds kept in memory names all rounds before them, thrice each: thousands of scans
        return self._cut(inventory.non_trade_items(refs.item_root(self.t, self._cut), self.cfg))

    # sales
    @cached_property
    def sale_month(self) -> DataFrame:
        return self._kept("sale_month", lambda: sales.sale_month(
            sales.sale_report(self.t, self.start_long, self.finish, self.cfg), self.categories, self.cfg))

    @cached_property
    def sale_store_month(self) -> DataFrame:
        return sales.sale_store_month(self.sale_month)

    @cached_property
    def classes(self) -> DataFrame:
        return refs.store_class(self.sale_store_month, self.areas, self.categories, self.cfg)

    @cached_property
    def service(self) -> DataFrame:
        return sales.service_profit(self.t, self.start, self.finish)

    @cached_property
    def structure(self) -> DataFrame:
        checks = sales.sale_check_category(self.t, self.start, self.finish, self.cfg)
        return sales.category_structure(
            inventory.inv_category_mean(self.snapshots, self.trade_stores, self.t),
            sales.sale_structure(checks, self.cfg), self.t, self.cfg)

    @cached_property
    def growth(self) -> DataFrame:
        return sales.quarter_growth(self.sale_month, self.classes, self.finish)

    # cost
    @cached_property
    def expenses(self) -> DataFrame:
        return self._kept("expenses", lambda: expenses.expense_months(
            self.t, self.start_long, self.finish, self.cfg))

    @cached_property
    def salary(self) -> DataFrame:
        return self._kept("salary", lambda: payroll.salary_union(
            payroll.salary_month(self.t, self.months, self.cfg),
            payroll.compensation(self.t, self.start, self.finish, self.cfg), self.cfg))

    @cached_property
    def direct_costs(self) -> DataFrame:
        return expenses.direct_costs(
            self.expenses, payroll.payroll_support(self.salary, self.categories, self.cfg),
            payroll.payroll_store(self.salary, self.categories, self.cfg), self.finish, self.cfg)

    @cached_property
    def vat(self) -> DataFrame:
        return vat.vat_allocate(
            self.sale_month, self.service, vat.account_balance(self.t, self.months, self.cfg),
            self.finish, self.cfg)

    # logistics
    @cached_property
    def motion_units(self) -> DataFrame:
        two = self.t["store_dim"].filter(
            F.col("store_id").isin(self.cfg.main_store, self.cfg.satellite_store)).select("store_id")
        stores = self.trade_stores.select("store_id").unionByName(two)
        return self._kept("motion_units", lambda: logistics.motion_units(
            self.t, stores, self.motion_start, self.finish, self.non_trade))

    @cached_property
    def shipment_share(self) -> DataFrame:
        return logistics.shipment_share(self.motion_units, self.trade_stores, self.t)

    @cached_property
    def satellite_share(self) -> DataFrame:
        return logistics.satellite_share(
            self.motion_units, self.t, self.satellites, self.cfg)

    @cached_property
    def main_share(self) -> DataFrame:
        supers = (self.shipment_share.filter(F.col("type_subdiv") == "retail")
                  .join(self.categories.filter(F.col("subdiv_category") == self.cfg.supermarket_b2c),
                        "subdiv_id", "left_semi").select("subdiv_id", "avr_subdiv_share"))
        return logistics.main_share(self.motion_units, self.t, self.satellite_share, supers,
                                    self.categories, self.cfg)

    @cached_property
    def warehouse_cost(self) -> DataFrame:
        return logistics.warehouse_cost(self.direct_costs, payroll.driver_pay(self.salary, self.cfg),
                                        self.main_share, self.satellite_share, self.cfg)

    @cached_property
    def crews(self) -> DataFrame:
        return self._kept("crews", lambda: logistics.delivery_crews(self.t, self.start, self.finish, self.cfg))

    @cached_property
    def crew_cost(self) -> DataFrame:
        return logistics.crew_cost(self.crews, self.salary, self.t, self.cfg)

    @cached_property
    def truck_cost(self) -> DataFrame:
        return logistics.truck_cost_km(
            self.crews, self.crew_cost, self.expenses, self.finish, self.cfg)

    @cached_property
    def stop_list(self) -> DataFrame:
        def build() -> DataFrame:
            orders = logistics.delivery_orders(self.t, self.start - timedelta(weeks=2), self.finish)
            moved = logistics.trade_deliveries(
                logistics.delivery_stops(self.t, self.start, self.finish, self.cfg), orders, self.t, self.crew_cost,
                self.trade_stores, self.cfg)
            return logistics.stop_list(moved, self.satellites, self.cfg)

        return self._kept("stop_list", build)

    @cached_property
    def tours(self) -> DataFrame:
        return self.stop_list.select("delivery_store", "store_list").distinct()

    @cached_property
    def transport(self) -> DataFrame:
        if self.legs is None:
            raise ValueError("transport cost needs the tours of a route service (legs)")
        return logistics.transport_store(
            self.stop_list, self.legs(self.tours), self.truck_cost, self.satellite_share, self.t,
            self.cfg)

    # stock and loyalty
    @cached_property
    def snapshots(self) -> DataFrame:
        return self._kept("snapshots", lambda: inventory.inv_snapshots(
            self.t, self.finish, self.as_of, self.non_trade, self.cfg))

    @cached_property
    def discount_days(self) -> DataFrame:
        return self._kept("discount_days", lambda: loyalty.discount_days(
            loyalty.discount_lines(self.t, self.start, self.finish)))

    @cached_property
    def discount_class(self) -> DataFrame:
        return loyalty.discount_class(self.discount_days, self.t)

    # results
    def _together(self, *steps: str) -> None:
        """Submit independent steps two at a time: small jobs run side by side, and the driver holds two plans, not six."""
        with ThreadPoolExecutor(2) as pool:
            for done in [pool.submit(self._spark_thread(getattr), self, s) for s in steps]:
                done.result()

    def _spark_thread(self, fn):
        return inheritable_thread_target(self.categories.sparkSession)(fn)

    def prepare(self) -> None:
        """Compute the facts that several results read; no step of a group reads another of the same group."""
        self._settle("categories", "trade_stores", "satellites")
        self._together("non_trade", "sale_month", "expenses", "salary", "crews", "discount_days")
        self._together("motion_units", "snapshots", "stop_list")

    @cached_property
    def store_kpis(self) -> DataFrame:
        self.prepare()
        self._settle("direct_costs", "shipment_share", "satellite_share", "warehouse_cost", "transport", "vat",
                     "structure", "classes")
        inputs = kpi.kpi_inputs(
            sales.sale_store(self.sale_store_month, self.finish, self.cfg), refs.shop_areas(self.areas),
            inventory.inv_store_mean(self.snapshots, self.trade_stores, self.t), self.direct_costs,
            self.shipment_share, self.warehouse_cost, self.transport, self.vat,
            self.discount_class, sales.revenue_generator(self.structure),
            self.categories)
        # views read the table up to five times; it is one row per subdivision
        return self._cut(kpi.store_kpis(inputs, self.classes, self.subdivs, self.cfg))

    @cached_property
    def cards(self) -> DataFrame:
        return loyalty.card_stats(loyalty.card_visits(self.discount_days),
                                  loyalty.new_cards(self.t, self.start, self.finish),
                                  self.trade_stores, self.store_kpis, self.classes, self.t)

    @cached_property
    def q75(self) -> DataFrame:
        return views.quartiles(self.store_kpis, 0.75)

    @cached_property
    def q25(self) -> DataFrame:
        return views.quartiles(self.store_kpis, 0.25)

    @cached_property
    def proposals(self) -> DataFrame:
        return rules.proposals(self.store_kpis, self.q75, self.q25, self.growth, self.cfg)

    def results(self) -> dict[str, DataFrame]:
        """The five result tables."""
        return {"store_kpis": self.store_kpis, "category_structure": self.structure,
                "store_class": self.classes, "card_stats": self.cards, "quarter_growth": self.growth}



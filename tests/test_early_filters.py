"""Windows of documents cut the lines before these are shuffled."""

import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from registry.driver_tables import CFG, SCHEMAS, DriverTables
from shelfledger.operators import inventory, logistics, loyalty, sales
from shelfledger.session import RUNTIME_FILTERS, filter_early
from tests.conftest import rows

SIDE = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"


@pytest.fixture
def tables(spark, tmp_path):
    """Orders of five years, the same day each month; every third one twice in the lines."""
    data = {
        "region": [(i, f"R{i}") for i in range(5)],
        "nation": [(i, f"N{i}", i % 5) for i in range(25)],
        "customer": [(i, f"C{i}", i % 25, 1.0, "BUILDING") for i in range(10)],
        "supplier": [(i, f"S{i}", i % 25, 10.0) for i in range(30)],
        "part": [(i, f"P{i}", "Brand#13", "PROMO", i % 50, 2.0) for i in range(20)],
        "orders": [(k, k % 10, "F", 5.0, datetime(1997 + k // 12 % 5, k % 12 + 1, 1 + k % 28, 12), "2-HIGH") for k in range(240)],
        "lineitem": [(k, k % 20, k % 30, n, 2.0, 4.0, 0.0, 0.1, "N", "O", datetime(2001, 1, 5)) for k in range(240) for n in range(1, 3 if k % 3 == 0 else 2)]}
    for name, values in data.items():
        spark.createDataFrame(values, SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    before = {k: spark.conf.get(k) for k in (SIDE, "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("0b", "-1")):
        spark.conf.set(k, v)
    yield DriverTables(spark, str(tmp_path))
    for k, v in before.items():
        spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_window_of_orders_reaches_the_lines(tables):
    df = tables.register("cost_register", "date", date(2001, 1, 1), date(2001, 4, 1), ["active"])
    assert "might_contain" in plan(df)
    assert df.count() == tables["cost_register"].filter("active and date >= '2001-01-01' and date < '2001-04-01'").count() > 0


def test_a_window_of_reports_is_one_of_orders(tables):
    start, finish = date(2001, 1, 1), date(2001, 4, 1)
    head = tables.register("check_report", "date", start, finish).select(F.col("ref").alias("report_ref"))
    for name in ("check_line", "check_regular"):
        got, full = tables.lines_of(name, head, "report_ref", (start, finish)), tables.lines_of(name, head, "report_ref")
        assert rows(got) == rows(full) != []
        assert "GreaterThanOrEqual(o_orderdate,2001-01-01" in plan(got)
    # a window within a month still takes the month whole
    some = tables.register("check_report", "date", date(2001, 2, 1), date(2001, 2, 2)).select(F.col("ref").alias("report_ref"))
    assert rows(tables.lines_of("check_line", some, "report_ref", (date(2001, 2, 1), date(2001, 2, 2)))) == rows(tables.lines_of("check_line", some, "report_ref")) != []


def test_checks_by_category_ask_for_the_window(tables):
    from shelfledger.config import Settings
    assert "GreaterThanOrEqual(o_orderdate,2001-01-01" in plan(sales.sale_check_category(tables, date(2001, 1, 1), date(2001, 4, 1), Settings()))


def test_a_session_keeps_what_it_says():
    class Said:
        def __init__(self):
            self.getAll = {SIDE: "1GB"}

        def set(self, k, v):
            self.getAll[k] = v

    class Session:
        conf = Said()

    filter_early(Session)
    assert Session.conf.getAll == {**RUNTIME_FILTERS, SIDE: "1GB"}


def test_a_window_of_receipts_reaches_items_and_discounts(tables):
    """Both tables of lines are cut by the receipts, not by the few cash desks alone."""
    start, finish = date(2001, 1, 1), date(2001, 4, 1)
    got = loyalty.discount_lines(tables, start, finish)
    text = plan(got)
    # the filter on lines is asked by the receipt's own key
    assert re.search(r"might_contain\([^\n]*xxhash64\(l_orderkey#\d+L, 42\)", text) and "bloom_filter_agg(xxhash64(receipt_item#" in text
    assert rows(got.select("global_number").distinct()) == sorted(
        ((k,) for k in range(240) if k // 12 % 5 == 4 and k % 12 < 3 and k % 17), key=str)


def test_a_plan_of_many_windows_filters_each(tables):
    """Spark by itself stops at ten filters, and later tables of lines would be shuffled whole."""
    slices = [tables.register("cost_register", "date", date(2001, 1, 1 + i), date(2001, 4, 1), ["active"]) for i in range(14)]
    df = slices[0]
    for other in slices[1:]:
        df = df.unionByName(other)
    # the lines and the suppliers of each slice: the filters are told apart by the window they are built of
    asked = re.findall(r"might_contain\([^\n]*xxhash64\(l_orderkey#(\d+)L", plan(df))
    assert len(set(asked)) == 14


def test_a_window_of_trips_reaches_the_lines_of_their_stops(spark, tables):
    """All lines were grouped to stops and dealt by order before the trips were met."""
    start, finish = date(2001, 1, 1), date(2001, 4, 1)
    people = [(i, datetime(2024, 1, 1), i, "view", 1.0, "") for i in range(40)]
    spark.createDataFrame(people, SCHEMAS["events"]).write.parquet(f"{tables.dir}/events.parquet")
    for df in (logistics.delivery_stops(tables, start, finish, CFG).filter("nmbr_deliv_order is not null"), logistics.delivery_rows(tables, start, finish),
               logistics.delivery_crews(tables, start, finish, CFG)):
        # the filter of the trips is built of their own key
        assert re.search(r"bloom_filter_agg\(xxhash64\(trip_ref#\d+L", plan(df)) and df.count() > 0


def test_open_warehouses_are_no_larger_than_the_warehouses(spark):
    """The join of stores to stores was taken for the product of its sides: registers were shuffled to meet it."""
    from shelfledger.config import Settings
    from shelfledger.sources.readers import FrameTables
    data = [(1, "a", None), (2, "b", 1), (3, "c", 2), (4, "d", 9), (5, "e", 1), (5, "f", 2), (6, "g", 7), (7, "x", None), (7, "y", 1), (None, "n", 1), (8, None, 1)]
    stores = spark.createDataFrame(data, "ref bigint, store_id string, parent_ref bigint")
    cfg = Settings(closed_parent_stores=("b",))
    got = inventory.open_stores(FrameTables({"store_dim": stores}), cfg)
    assert "Join" not in plan(got)
    assert rows(got) == sorted([(None, "n"), (2, "b"), (5, "e"), (6, "g"), (6, "g"), (7, "y"), (8, None)], key=lambda r: tuple((x is not None, str(x)) for x in r))

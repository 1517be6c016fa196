"""Registered queries against their SQL on the smallest driver tables, and their plans."""
import re

import duckdb
import pytest

import __spark_entry__ as contract
from registry.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
# cheap queries of every family; the whole list is compared by the driver
COMPARED = [
    "register_slice", "epoch_shift", "period_window", "filter_null", "join_left_any", "join_full", "join_polymorphic", "asof_price",
    "agg_conditional", "mode_generator", "win_share", "win_share_global", "latest_per_key", "item_root", "ref_store", "nest_regions",
    "eav_lookup", "shop_areas", "sale_report", "sale_structure", "service_profit", "expense_clean", "salary_month", "account_balance",
    "delivery_clean", "leg_allocate", "inv_lifo_value", "price_history", "new_cards", "discount_class",
]
BIG_TABLE_QUERIES = ["sale_report", "expense_months", "inv_lifo_value", "discount_lines", "delivery_crews", "asof_price"]


@pytest.fixture(scope="module")
def sql():
    return contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql(sql):
    assert set(QUERIES) <= set(sql) <= set(contract.queries())


@pytest.mark.parametrize("name", COMPARED)
def test_same_rows_as_sql(spark, duck, sql, name):
    df = contract.queries()[name](spark, SF)
    cols = sorted(df.columns)
    res = duck.execute(sql[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    key = lambda r: tuple((v is not None, v) for v in r)
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=key)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == want


@pytest.mark.parametrize("name", BIG_TABLE_QUERIES)
def test_plan_has_no_pairs_and_no_single_task_window(spark, name):
    text = contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text
    for first in re.findall(r"windowspecdefinition\(([^,]+),", text):
        # the first entry is a partition key, not an order or a bare frame
        assert " ASC" not in first and " DESC" not in first and "windowframe" not in first, first
    for line in text.splitlines():
        if "BroadcastNestedLoopJoin" in line:
            # an existence test on one filtered row, or the 25 nations by the months of the data
            assert "LeftSemi" in line or name == "sale_report", line


def test_dates_reach_the_scan(spark):
    df = contract.queries()["expense_rows"](spark, SF)
    text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
        df._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(l_shipdate" in text


def exchanges_below_first_aggregate(plan, table):
    """Exchange lines between the scan of ``table`` and the first aggregate above it."""
    lines = plan.splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-|")) if x.strip() else 0
    at = next(i for i, x in enumerate(lines) if f"/{table}.parquet" in x)
    found, level = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < level:
            level = depth(x)
            if "HashAggregate" in x or "SortAggregate" in x:
                return found
            if "Exchange" in x:
                found.append(x)
    return found


def test_raw_movements_are_shuffled_twice_at_most(spark):
    """Without broadcasts, for the warehouse and for the items left out; never on a document's references."""
    from registry.driver_tables import CFG, FINISH, DriverTables
    from registry.queries import START
    from shelfledger.operators import logistics

    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in keep:
        spark.conf.set(k, "-1")
    try:
        t = DriverTables(spark, SF)
        t._cache["stock_movement"] = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr(
            "l_shipdate AS date_movement", "true AS active", "l_orderkey AS recorder_ref", "l_suppkey AS store_ref", "l_partkey AS item_ref", "1 AS type_motion", "l_quantity AS item_motion_qty")
        stores = spark.createDataFrame([("000000001",)], "store_id string")
        items = spark.createDataFrame([("000000003",)], "item_id string")
        df = logistics.motion_units(t, stores, START, FINISH, items)
        found = exchanges_below_first_aggregate(df._jdf.queryExecution().executedPlan().toString(), "lineitem")
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert 1 <= len(found) <= 2 and not any(c in x for x in found for c in ("subdiv_ref", "receiver_store_ref", "recorder_ref"))

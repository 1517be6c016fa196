import pytest
from pyspark.sql import functions as F

from shelfledger.config import Settings
from shelfledger.plans import kpi, rules, views

from .conftest import rows

CFG = Settings()
# a store exactly on its benchmarks: only the rules with "at most" conditions can fire
EVEN = {c: 10.0 for c in views.BENCHMARK_COLUMNS}
EVEN.update(trade_area_share=0.9, avr_subdiv_share=0.9, profitibility=0.1)
HIGH = dict(EVEN, profitibility=0.2)
LOW = dict(EVEN, gmroi=9.0, profitibility=0.05)


def frame(spark, values, **extra):
    row = {**values, **extra}
    schema = ", ".join(f"`{k}` {'string' if isinstance(v, str) else 'double'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema)


def fired(spark, low=None, **store):
    k = frame(spark, {**EVEN, **store}, subdiv_id="s", trade_category="Міні")
    hi = frame(spark, HIGH, trade_category="Міні", revenue_generator="g", subdiv_name="quantile_75")
    lo = frame(spark, {**LOW, **(low or {})}, trade_category="Міні", revenue_generator="g", subdiv_name="quantile_25")
    growth = spark.createDataFrame([("Міні", 1.1, 1.25)], "trade_category string, check_sku_qty_growth double, check_units_growth double")
    return {r.rule: r.proposal for r in rules.proposals(k, hi, lo, growth, CFG).collect()}


CASES = [
    (1, dict(revenue_per_1m=9.0, gmros=9.0, gmroi=9.5, profitibility=-0.1)),
    (2, dict(trade_area_share=0.79)),
    (3, dict(avr_inventory_1m=9.0)),
    (4, dict(gmroi=9.0, profitibility=0.06)),
    (5, dict(content_1m=11.0, avr_checks_qty=9.0, profitibility=0.04)),
    (6, dict(logistic_share=11.0)),
    (7, dict(employee_workload=9.0, gmrol=9.0)),
    (8, dict(avr_subdiv_share=0.79)),
    (9, dict(card_owners_share=9.0)),
    (10, dict(avr_check_sum=9.0, avr_check_units=9.0, avr_ckecks_sku_qty=9.0)),
    (11, dict(avr_check_units=9.0)),
    (12, dict(avr_ckecks_sku_qty=9.0)),
    (13, dict(avr_check_sum=9.0, avr_unit_price=9.0)),
    (14, dict(avr_unit_price=9.0)),
]


def test_each_rule_fires_on_its_case_only(spark):
    assert fired(spark) == {}
    for no, store in CASES:
        got = fired(spark, **store)
        assert no in got, no
        others = {10: {11, 12}, 13: {14}}.get(no, set())
        assert set(got) == {no} | others, no


def test_rule_targets_and_unknown_conditions(spark):
    got = fired(spark, avr_check_units=9.0, avr_ckecks_sku_qty=9.0, avr_unit_price=9.0, card_owners_share=9.0)
    assert got[9].endswith("(ціл.зн-ня 10)")
    assert got[11].endswith(" 12.5") and got[12].endswith(" 11") and got[14].endswith(" 10.5")
    k = frame(spark, EVEN, subdiv_id="s", trade_category="Міні").withColumn("trade_area_share", F.lit(None).cast("double"))
    q = frame(spark, EVEN, trade_category="інша", revenue_generator="g", subdiv_name="q")
    growth = spark.createDataFrame([], "trade_category string, check_sku_qty_growth double, check_units_growth double")
    assert rules.proposals(k, q, q, growth, CFG).count() == 0


def store_rows(spark, values):
    cols = {c: "double" for c in views.BENCHMARK_COLUMNS}
    data = [tuple([float(v)] * len(cols) + [g, "Міні", f"n{i}", f"s{i}"]) for i, (v, g) in enumerate(values)]
    schema = ", ".join(f"{c} double" for c in cols) + ", revenue_generator string, trade_category string, subdiv_name string, subdiv_id string"
    return spark.createDataFrame(data, schema)


def test_quartiles_and_modal_generator(spark):
    df = store_rows(spark, [(1, "b - 10%"), (2, "a - 5%"), (3, "a - 7%"), (4, "b - 2%"), (10, None)])
    q = views.quartiles(df, 0.75).first()
    assert (q.margin, q.revenue_generator, q.subdiv_name) == (4.0, "a", "quantile_75")
    assert views.quartiles(df, 0.25).first().margin == 2.0
    two = store_rows(spark, [(1, "x"), (2, "x")])
    assert views.quartiles(two, 0.75).first().margin == 1.75


def test_benchmark_rows_and_flags(spark):
    df = store_rows(spark, [(1, "x - 1%"), (2, "x - 2%"), (3, "x - 3%")])
    hi, lo = views.quartiles(df, 0.75), views.quartiles(df, 0.25)
    got = views.store_benchmark(df, hi, lo, "n1").select("store", "row_no", "margin", "subdiv_name")
    assert rows(got) == [("n1", 1, 2.0, "n1"), ("n1", 2, 2.5, "quantile_75"), ("n1", 3, 1.5, "quantile_25")]
    flags = {r.subdiv_id: (r.margin_below, r.avr_check_sum_below) for r in views.benchmark_flags(df, hi, lo).collect()}
    assert flags == {"s0": (True, True), "s1": (True, True), "s2": (False, False)}


def test_status_directions(spark):
    schema = "trade_category string, index_no int, value double, quantile_75 double, quantile_25 double"
    df = spark.createDataFrame([("c", 4, 2.0, 1.0, 0.0), ("c", 4, 1.0, 1.0, 0.0), ("c", 2, 0.5, 3.0, 1.0), ("c", 2, 1.0, 3.0, 1.0), ("c", 1, 9.0, 1.0, 0.0)], schema)
    assert [r.status for r in views.indicator_status(df).collect()] == ["good", "bad", "good", "bad", "neutral"]


def test_label_and_share_matrix(spark):
    st = spark.createDataFrame([("s", "K", 0.5, 0.256, None), ("t", "K", 0.4, 0.1, 0.2)],
                               "subdiv_id string, category_name string, category_checks_share double, category_revenue_share double, category_inventory_share double")
    cl = spark.createDataFrame([("s", "Міні"), ("t", "Міні")], "subdiv_id string, trade_category string")
    sub = spark.createDataFrame([("s", "S"), ("t", "T")], "subdiv_id string, subdiv_name string")
    assert rows(views.share_labels(st, cl, sub, ["S", "T", "U"], "Міні")) == [("Міні", "K", "26 %( NA )", "10 %( 20 )", "-")]
    assert rows(views.share_matrix(st, cl, sub, ["S", "U"])) == [("Міні", "K", 0.5, 0.0)]


@pytest.mark.parametrize(("kind", "area", "expenses"), [(CFG.supermarket_b2c, 30.0, 115.0), ("Магазини", 15.0, 85.0)])
def test_area_and_expense_formulas(spark, kind, area, expenses):
    base = dict(total_revenue=1000.0, avr_revenue=300.0, total_cog=600.0, avr_cog=200.0, total_checks_qty=10.0, avr_checks_qty=3.0,
                total_sku_in_checks=20.0, total_units_qty=40.0, total_card_owners_checks_qty=5.0, total_area=100.0, trade_area=50.0, effective_area=90.0,
                avr_inventory=500.0, avr_sku_qty=30.0, avr_total_exp_sum=10.0, avr_salary_sum=20.0, stuff_units=0.0, avr_working_hours=100.0,
                avr_rent_sum=20.0, utilities_exp_sum=10.0, avr_subdiv_share=0.5, distr_stores_cost=12.0, avr_transport_cost=18.0, avr_vat_sum=10.0)
    base.update({"Знижка_Маркетинг": 30.0, "Використання_бонусів": 20.0, "subdiv_category": kind})
    r = kpi.kpi_formulas(frame(spark, base), CFG).first()
    assert (r.area_maintenance, r.total_expenses, r.net_profit) == (area, expenses, 100.0 - expenses)
    assert (r.avr_check_sum, r.avr_ckecks_sku_qty, r.avr_check_units, r.avr_unit_price) == (100.0, 2.0, 4.0, 25.0)
    assert (r.revenue_per_1m, r.content_1m, r.gmros, r.gmroi, r.logistic_share) == (3.0, 0.0, 2.0, 0.1, 0.1)
    assert r.employee_workload is None and r.margin == 0.333 and r.discounts_bonuses_share == 0.05
    assert r.other_expenses == expenses - area - 20.0

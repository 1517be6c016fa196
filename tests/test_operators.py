from datetime import date

from pyspark.sql import functions as F

from shelfledger.config import SUPERMARKET_B2C, Settings
from shelfledger.operators import expenses, loyalty, payroll, refs, sales
from shelfledger.sources.readers import FrameTables

from .conftest import rows

CFG = Settings()
M = [date(2024, 1, 1), date(2024, 2, 1), date(2024, 3, 1)]
SALES = ("date date, subdiv_id string, checks_report_sum double, checks_report_qty double, total_checks_qty bigint, "
         "checks_report_sku bigint, doc_reg_cust_nmbr bigint, doc_cost_sum double")


def test_missing_cost_makes_month_unknown(spark):
    df = spark.createDataFrame([(M[0], "s", 10.0, 1.0, 1, 1, None, 4.0), (M[0], "s", 20.0, 2.0, 1, 1, 3, None)], SALES)
    a, b = sales.sale_store_month(df).first(), sales.sale_store_month(df, "zero").first()
    assert (a.revenue, a.cog, a.month_card_owners_checks_qty) == (30.0, None, 3)
    assert b.cog == 4.0


def test_mean_over_months_present(spark):
    df = spark.createDataFrame([(M[0], "s", 10.0, 1.0, 1, 1, 1, 4.0), (M[2], "s", 21.0, 2.0, 1, 1, 1, 4.0),
                                (date(2023, 12, 1), "s", 999.0, 1.0, 1, 1, 1, 1.0)], SALES)
    r = sales.sale_store(sales.sale_store_month(df), date(2024, 4, 1), CFG).first()
    assert (r.total_revenue, r.avr_revenue, r.avr_cog) == (31.0, 16.0, 4.0)


def test_growth_needs_quarters_one_and_two(spark):
    q = [date(2023, 4, 1), date(2023, 7, 1), date(2024, 1, 1)]
    df = spark.createDataFrame(
        [(q[0], "a", 1.0, 20.0, 10, 10, 1, 1.0), (q[1], "a", 1.0, 30.0, 10, 5, 1, 1.0), (q[1], "b", 1.0, 30.0, 10, 5, 1, 1.0),
         (q[2], "a", 1.0, 99.0, 1, 1, 1, 1.0)], SALES)
    classes = spark.createDataFrame([("a", "Міні"), ("b", "Міді")], "subdiv_id string, trade_category string")
    assert rows(sales.quarter_growth(df, classes, date(2024, 4, 1))) == [("Міні", 0.75, 1.25)]


def test_generator_label(spark):
    df = spark.createDataFrame([("s", "b", 0.5), ("s", "a", 0.5), ("t", "c", 0.123)],
                               "subdiv_id string, category_name string, category_revenue_share double")
    assert rows(sales.revenue_generator(df)) == [("s", "a - 50%"), ("t", "c - 12.3%")]


def test_structure_counts_check_pairs(spark):
    df = spark.createDataFrame([("s", "r1", 1, "K", 10.0), ("s", "r1", 1, "L", 30.0), ("s", "r2", 1, "K", 60.0)],
                               "subdiv_id string, nmbr_checks_report string, check_nmbr int, category_id string, check_category_sum double")
    got = {r.category_id: (r.category_checks_share, r.category_revenue_share) for r in sales.sale_structure(df, CFG).collect()}
    assert got == {"K": (1.0, 0.7), "L": (0.5, 0.3)}


def test_areas_latest_date_only(spark):
    df = spark.createDataFrame([(M[0], "s", "total_area", 90.0), (M[0], "s", "b2b_area", 9.0), (M[1], "s", "total_area", 100.0),
                                (M[1], "s", "trade_area", 70.0), (M[0], "t", "trade_area", 60.0)],
                               "date date, subdiv_id string, type_area string, area_value double")
    got = {r.subdiv_id: tuple(r)[1:] for r in refs.shop_areas(df).collect()}
    assert got == {"s": (100.0, 70.0, 100.0), "t": (0.0, 60.0, 0.0)}


def test_store_class_bounds(spark):
    areas = {"a": 60.0, "b": 60.5, "c": 100.0, "d": 100.5, "e": 100.5, "f": 100.0}
    df = spark.createDataFrame([(M[0], k, "trade_area", v) for k, v in areas.items()],
                               "date date, subdiv_id string, type_area string, area_value double")
    cats = spark.createDataFrame([("e", SUPERMARKET_B2C), ("f", SUPERMARKET_B2C)], "subdiv_id string, subdiv_category string")
    subs = spark.createDataFrame([(k,) for k in [*areas, "none"]], "subdiv_id string")
    got = {r.subdiv_id: (r.trade_category, r.category_order) for r in refs.store_class(subs, df, cats, CFG).collect()}
    assert got == {"a": ("Міні", 1), "b": ("Міді", 2), "c": ("Максі", 3), "d": ("Максі", 3), "e": ("Супер", 4),
                   "f": ("Максі", 3), "none": (None, None)}


def test_managers_count_in_part(spark):
    data = [(M[0], "s", "000000031", "p1", 100.0, 1.0, 100.0), (M[0], "s", "000000033", "p2", 200.0, 0.5, 50.0),
            (M[1], "s", "000000033", "p2", 300.0, 1.0, 70.0), (M[0], "000000140", "000000031", "p3", 900.0, 1.0, 9.0),
            (M[0], "000000004", "x", "p4", 40.0, 1.0, 1.0), (M[0], "other", "000000033", "p5", 1.0, 1.0, 1.0)]
    sal = spark.createDataFrame(data, "date date, subdiv_id string, position_id string, individ_id string, total_salary double, stuff_unit double, working_hours double")
    trade = spark.createDataFrame([("s",), ("000000140",)], "subdiv_id string")
    got = {r.subdiv_id: (r.avr_salary_sum, r.stuff_units, r.avr_working_hours) for r in payroll.payroll_store(sal, trade, CFG).collect()}
    # (15 + 200, 300) / 2 = 257.5 goes to the even 258; units are the last month's
    assert got == {"s": (258.0, 1.0, 68.0), "000000140": (0.0, 0.0, 0.0), "000000004": (40.0, None, None)}


def payroll_tables(spark):
    line = "doc_ref int, employee_ref int, position_ref int, subdiv_ref int, salary double, working_hours double, norm_hours double"
    return FrameTables({
        "payroll_doc": spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-31', true, true), (2, timestamp'2024-01-31', false, true) AS t(ref, date, posted, is_managerial)"),
        "payroll_line": spark.createDataFrame([(1, 1, 1, None, 100.0, 80.0, 160.0), (1, 1, 1, 7, 50.0, 20.0, 0.0), (1, 2, 1, 7, 10.0, 200.0, 160.0),
                                               (1, 3, 1, 7, 10.0, 5.0, 0.0), (1, 4, 1, 7, 0.0, 5.0, 5.0), (2, 1, 1, 7, 999.0, 1.0, 1.0)], line),
        "contribution_line": spark.createDataFrame([(1, 1, 22.0)], "doc_ref int, employee_ref int, sum double"),
        "tax_line": spark.createDataFrame([(1, 1, 8.0), (2, 1, 500.0)], "doc_ref int, employee_ref int, sum double"),
        "employee_dim": spark.createDataFrame([(i, 1, i) for i in range(1, 5)], "ref int, organization_ref int, individ_ref int"),
        "organization_dim": spark.createDataFrame([(1, "o")], "ref int, organization_id string"),
        "individual_dim": spark.createDataFrame([(i, f"p{i}") for i in range(1, 5)], "ref int, individ_id string"),
        "position_dim": spark.createDataFrame([(1, "old"), (2, "new"), (3, None)], "ref int, position_id string"),
        "subdiv_dim": spark.createDataFrame([(7, "000000189")], "ref int, subdiv_id string"),
        "position_history": spark.sql("""SELECT * FROM VALUES (timestamp'2023-01-01', 1, 1), (timestamp'2024-01-10', 1, 2), (timestamp'2024-01-20', 1, 3),
            (timestamp'2024-02-01', 1, 1), (timestamp'2023-05-05', 2, 1) AS t(date_rec, individ_ref, position_ref)""")})


def test_salary_month(spark):
    got = {r.individ_id: tuple(r)[2:] for r in payroll.salary_month(payroll_tables(spark), [M[0]], CFG).collect()}
    # first known subdivision, its id merged; the latest position that has a code
    assert got["p1"] == ("000000007", "new", 180.0, 0.625, 100.0)
    assert got["p2"] == ("000000007", "old", 10.0, 1.0, 200.0)
    assert got["p3"][1:] == (None, 10.0, 0.0, 5.0)
    assert "p4" not in got


def test_position_by_month(spark):
    got = rows(payroll.position_asof(payroll_tables(spark), M[:2]).filter("individ_id = 'p1'"))
    assert got == [(M[0], "p1", "new"), (M[1], "p1", "old")]


def test_expense_parents_and_signs(spark):
    t = FrameTables({"expense_item": spark.createDataFrame(
        [(1, "1", "02 Орендна плата", None, False), (2, "2", "mid", 1, False), (3, "3", "leaf", 2, False),
         (4, "4", "53 Курсові різниці", None, False), (5, "5", "fx", 4, False)],
        "ref int, id string, name string, parent_ref int, marked boolean")})
    df = spark.createDataFrame([(M[0], "3", "leaf", "000000002", None, 0, 10.0, 2.0), (M[0], "2", "mid", "000000251", None, 1, 10.0, 2.0),
                                (M[0], "5", "fx", "x", None, 0, 1.0, 1.0), (M[0], "1", "02 Орендна плата", "x", None, 0, 1.0, 1.0)],
                               "date date, exp_items_id string, exp_items_name string, subdiv_id string, project string, type_exp int, exp_sum double, exp_vat double")
    got = {r.exp_items_id: (r.subdiv_id, r.exp_sum, r.expenses_item) for r in expenses.expense_clean(df, t, CFG).collect()}
    assert got == {"3": ("000000001", 12.0, "02 Орендна плата"), "2": ("000000190", -12.0, "02 Орендна плата"), "1": ("x", 2.0, None)}


def test_unknown_expense_makes_the_mean_unknown(spark):
    df = spark.createDataFrame([(M[0], "s", "02 Орендна плата", 10.0), (M[1], "s", "02 Орендна плата", None), (M[1], "000000227", "02 Орендна плата", 3.0)],
                               "date date, subdiv_id string, expenses_item string, exp_sum double")
    got = {r.subdiv_id: r.avr_rent_sum for r in expenses.rent_max(df, date(2024, 4, 1), CFG).collect()}
    assert got == {"s": None, "000000225": 3.0}


def test_new_cards_count_once_at_first_store(spark):
    t = FrameTables({
        "receipt_header": spark.sql("""SELECT * FROM VALUES (1, 10, timestamp'2024-01-05 13:00:00', 'c1', 0), (2, 11, timestamp'2024-02-05', 'c1', 0),
            (1, 12, timestamp'2023-12-31', 'c2', 0), (2, 13, timestamp'2024-03-31 23:00:00', 'c3', 0), (2, 14, timestamp'2024-01-01', 'c4', 1), (2, 15, timestamp'2024-01-01', 'c5', 0),
            (2, 16, timestamp'2024-01-01', CAST(NULL AS STRING), 0) AS t(cash_id, id, date, client, deleted)"""),
        "receipt_footer": spark.createDataFrame([(1, 10, 0, 0), (2, 11, 0, 0), (1, 12, 0, 0), (2, 13, 0, 0), (2, 14, 0, 0), (2, 15, 1, 0), (2, 16, 0, 0)],
                                                "cash_id int, id int, result int, deleted int"),
        "pos": spark.createDataFrame([(1, 1), (2, 2)], "cash_id int, store_id int"),
        "pos_store": spark.createDataFrame([(1, "A"), (2, "B")], "store_id int, code_subdivision string")})
    # a receipt late on the window's last day counts
    assert rows(loyalty.new_cards(t, M[0], date(2024, 4, 1))) == [("A", 1), ("B", 1)]


def test_discount_classes(spark):
    t = FrameTables({"store_dim": spark.createDataFrame([("A", 1)], "store_id string, subdiv_ref int"),
                     "subdiv_dim": spark.createDataFrame([(1, "s")], "ref int, subdiv_id string")})
    df = spark.createDataFrame([("A", "5% на бонусний рахунок", 0.0, 5.0), ("A", "Використання бонусів", -3.0, 0.0), ("A", "Акція", -7.0, 0.0),
                                ("A", "Акція", 0.0, 0.0), ("A", "Округление на вид оплаты", -9.0, 0.0)],
                               "code_subdivision string, name string, increment double, account_increment double")
    lines = df.withColumns({"client": F.when(F.col("increment") < -5, "c"), "date": F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")})
    days = loyalty.discount_days(lines)
    assert rows(loyalty.discount_class(days, t)) == [("s", "A", 5.0, 3.0, 7.0)]
    assert loyalty.discount_subdiv(loyalty.discount_class(days, t)).count() == 1
    # a line that gives nothing is a visit all the same; an unknown amount makes the sum unknown
    assert rows(loyalty.card_visits(days)) == [("A", "c", 1)]
    unknown = loyalty.discount_days(lines.withColumn("account_increment", F.when(F.col("increment") != -7, F.col("account_increment"))))
    assert rows(loyalty.discount_class(unknown, t)) == [("s", "A", 5.0, 3.0, None)]


def test_item_chain_through_tables(spark):
    t = FrameTables({"item_dim": spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2)], "ref int, item_id string, parent_ref int")})
    got = {r.item_id: r.main_parent for r in refs.item_root(t).collect()}
    assert got == {"a": None, "b": "a", "c": "a"}
    assert refs.item_root(t).filter(F.col("main_parent").isNull()).count() == 1

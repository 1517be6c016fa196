import random
from datetime import date

from pyspark.sql import functions as F

from shelfledger.config import Settings
from shelfledger.operators import inventory as I
from shelfledger.sources.readers import FrameTables
from tests.conftest import rows

SNAP = [date(2024, 1, 1), date(2024, 2, 1)]
H = "month date, store_id string, item_id string, q double"
B = "month date, date_receipt date, store_id string, item_id string, q double, v double"


def value(spark, history, batches, prices):
    p = I.prices_at(spark.createDataFrame(prices, "item_id string, date_setting date, item_price double"), SNAP)
    df = I.inv_lifo_value(spark.createDataFrame(history, H), spark.createDataFrame(batches, B), p, SNAP)
    return {(r.date, r.item_id): r.balance_sum for r in df.collect()}


def test_lifo_branches(spark):
    d = lambda m, day=1: date(2023, m, day)
    history = [(None, "s", i, q) for i, q in (
        ("exact", 5.0), ("first", 2.0), ("deeper", 4.0), ("less1", 10.0), ("less2", 10.0), ("none", 3.0), ("noprice", 3.0),
        ("negative", 3.0))]
    batches = [
        (None, d(5), "s", "exact", 2.0, 20.0), (None, d(6), "s", "exact", 3.0, 60.0),
        (None, d(5), "s", "first", 9.0, 1.0), (None, d(6), "s", "first", 3.0, 10.0),
        (None, d(5), "s", "deeper", 4.0, 40.0), (None, d(6), "s", "deeper", 3.0, 60.0),
        (None, d(5), "s", "less1", 4.0, 40.0),
        (None, d(5), "s", "less2", 4.0, 40.0), (None, d(6), "s", "less2", 3.0, 60.0),
        # the newest batch is negative: the running quantity first falls below the balance
        (None, d(7), "s", "negative", -1.0, -5.0), (None, d(6), "s", "negative", 5.0, 50.0),
    ]
    prices = [("none", date(2023, 12, 31), 7.0), ("none", date(2024, 1, 1), 9.0), ("noprice", date(2024, 2, 1), 1.0)]
    got = value(spark, history, batches, prices)
    jan, feb = SNAP
    assert got[jan, "exact"] == 80.0
    assert got[jan, "first"] == 6.67          # 10 / 3 * 2
    assert got[jan, "deeper"] == 70.0         # 60 + 1 of 4 at 10
    assert got[jan, "less1"] == 100.0         # 40 / 4 * 10
    assert got[jan, "less2"] == 130.0         # 100 + 3 more at 10
    assert got[jan, "negative"] == 35.0       # -5 + 4 of 5 at 10
    assert (got[jan, "none"], got[feb, "none"]) == (21.0, 27.0)   # strictly earlier price
    assert got[jan, "noprice"] is None


def reference_value(balance, batches, price):
    """One group, written row by row."""
    rows = sorted((x for x in batches if abs(x[1]) >= 1.490116e-8 and not (x[1] < 0 and x[2] > 0)), reverse=True)
    if not rows:
        return None if price is None else balance * price
    cq = cv = 0.0
    run = []
    for _, q, v in rows:
        cq, cv = cq + q, cv + v
        run.append((q, v, cq, cv))
    top = max(r[2] for r in run)
    if top == balance:
        return next(r[3] for r in run if r[2] == balance)
    if top > balance:
        q, v, cq, cv = next(r for r in run if r[2] > balance)
        return v / q * balance if q == cq else cv - v + v / q * (q - (cq - balance))
    q, v, cq, cv = run[-1]
    return v / q * balance if q == cq else cv + v / q * (balance - cq)


def test_lifo_and_rollback_against_rows(spark):
    rnd = random.Random(11)
    history, batches, want = [], [], {}
    for n in range(150):
        item = f"i{n}"
        stock = float(rnd.randrange(-3, 12))
        moves = {date(2024, m, 1): float(rnd.randrange(-4, 5)) for m in (1, 2)}
        history.append((None, "s", item, stock))
        history += [(m, "s", item, q) for m, q in moves.items() if q]
        own = [(date(2023, m, 1), float(rnd.randrange(-2, 6)), float(rnd.randrange(-30, 90)))
               for m in rnd.sample(range(1, 12), rnd.randrange(0, 6))]
        shifts = {(r, m): (float(rnd.randrange(-1, 3)), float(rnd.randrange(0, 9))) for r, _, _ in own for m in moves
                  if rnd.random() < 0.4}
        batches += [(None, r, "s", item, q, v) for r, q, v in own]
        batches += [(m, r, "s", item, q, v) for (r, m), (q, v) in shifts.items()]
        for s in SNAP:
            b = stock - sum(q for m, q in moves.items() if m >= s)
            mine = [(r, q - sum(x[0] for (rr, m), x in shifts.items() if rr == r and m >= s),
                     v - sum(x[1] for (rr, m), x in shifts.items() if rr == r and m >= s)) for r, q, v in own]
            if b:
                want[s, item] = reference_value(b, mine, 2.0)
    got = value(spark, history, batches, [(f"i{n}", date(2023, 1, 1), 2.0) for n in range(150)])
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert abs(got[k] - w) <= 0.0051, k


def test_rollback_without_movement_keeps_stock(spark):
    df = I.inv_rollback(spark.createDataFrame([(None, "s", "a", 4.0), (date(2024, 1, 1), "s", "b", 3.0)], H), SNAP)
    got = {(r.date, r.item_id): r.balance_qty for r in df.collect()}
    assert got == {(SNAP[0], "a"): 4.0, (SNAP[1], "a"): 4.0, (SNAP[0], "b"): -3.0}


def test_unknown_root_is_a_trade_item(spark):
    roots = spark.createDataFrame([("a", None), ("b", "000300000"), ("c", "000000001")], "item_id string, main_parent string")
    non_trade = I.non_trade_items(roots, Settings())
    stock = spark.createDataFrame([("a",), ("b",), ("c",), ("unknown",)], "item_id string")
    assert sorted(r.item_id for r in I.drop_non_trade(stock, non_trade).collect()) == ["a", "c", "unknown"]


def test_receipts_of_a_day_net_one_by_one(spark):
    """A receipt whose quantity nets to nothing in a month drops out with its cost, also where its day has others."""
    t = FrameTables({
        "batch_movement": spark.sql("""SELECT timestamp'2024-01-05' AS date_movement, true AS active, 1 AS store_ref, 1 AS item_ref, * FROM VALUES
            (0, 2.0D, 10.0D, 2.0D, 1), (1, 2.0D, 5.0D, 1.0D, 1), (0, 3.0D, 30.0D, 6.0D, 2) AS v(type_motion, item_motion_qty, item_store_sum, item_store_vat, receipt_doc_ref)"""),
        "receipt_doc": spark.sql("SELECT * FROM VALUES (1, timestamp'2023-12-01 08:00:00'), (2, timestamp'2023-12-01 17:00:00') AS r(ref, date)"),
        "assembly_doc": spark.sql("SELECT 9 AS ref, timestamp'2023-12-02' AS date"),
        "store_dim": spark.createDataFrame([(1, "s", 2), (2, "p", 2)], "ref int, store_id string, parent_ref int"),
        "item_dim": spark.createDataFrame([(1, "a")], "ref int, item_id string")})
    got = I.inv_movement_batch(t, date(2024, 1, 1), Settings()).collect()
    assert [(r.date_receipt, r.item_motion_qty, r.item_motion_cost) for r in got] == [(date(2023, 12, 1), 3.0, 36.0)]


def test_lifo_takes_sums_in_any_order_for_equal(spark):
    tenths = sum([0.1] * 3)  # not 0.3
    got = value(spark, [(None, "s", "i", 0.3)], [(None, date(2023, 5, 1), "s", "i", tenths, 9.0)], [("i", date(2023, 1, 1), 1.0)])
    assert got[SNAP[0], "i"] == 9.0


def test_lifo_values_a_group_without_windows(spark):
    """A warehouse and item is one row of an aggregate; windows cost most of the time of the stock values."""
    d = lambda m: date(2023, m, 1)
    history = [(None, "s", i, q) for i, q in (("late", 5.0), ("nocost", 4.0), ("moved", 2.0), ("unknown", None), ("alone", 6.0))]
    batches = [(None, d(5), "s", "late", 3.0, 30.0), (None, None, "s", "late", 4.0, 80.0),  # an unknown day is the oldest
               (None, d(6), "s", "nocost", 2.0, None), (None, d(5), "s", "nocost", 2.0, 8.0),
               (None, d(6), "s", "moved", 1.0, 5.0), (date(2024, 1, 1), d(6), "s", "moved", 1.0, 5.0), (None, d(5), "s", "moved", 3.0, 9.0),
               (None, d(5), "s", "unknown", 3.0, 30.0), (None, d(5), "s", "alone", 3.0, 30.0), (None, d(5), "s", "nostock", 3.0, 30.0)]
    jan, feb = SNAP
    got = value(spark, history, batches, [])
    # in January nothing of the newest batch of "moved" was there yet; "alone" has less in its one batch than in stock
    assert got == {(jan, "late"): 70.0, (feb, "late"): 70.0, (jan, "nocost"): 8.0, (feb, "nocost"): 8.0,
                   (jan, "moved"): 6.0, (feb, "moved"): 8.0, (jan, "alone"): 60.0, (feb, "alone"): 60.0}
    prices = spark.createDataFrame([], "date date, item_id string, item_price double")
    plan = I.inv_lifo_value(spark.createDataFrame(history, H), spark.createDataFrame(batches, B), prices, SNAP)
    assert "Window" not in plan._jdf.queryExecution().executedPlan().toString()


def test_low_vat_counts_as_none(spark):
    df = spark.createDataFrame([(100.0, 20.0), (100.0, 19.9), (100.0, 5.0)], "item_store_sum double, item_store_vat double")
    assert [r[0] for r in df.select(I._cost_with_vat()).collect()] == [120.0, 100.0, 100.0]


def test_price_floor(spark):
    t = FrameTables({
        "price_type_dim": spark.createDataFrame([(1, "000000005"), (2, "x")], "ref int, price_type_id string"),
        "item_dim": spark.createDataFrame([(1, "a"), (2, "b")], "ref int, item_id string"),
        "price_history": spark.sql("""SELECT * FROM VALUES
            (timestamp'2023-01-01', 1, 1, true, 1.0D), (timestamp'2023-06-01', 1, 1, true, 2.0D), (timestamp'2024-03-01', 1, 1, true, 3.0D),
            (timestamp'2023-12-01', 2, 1, true, 99.0D), (timestamp'2023-12-01', 1, 1, false, 98.0D), (timestamp'2024-03-01', 1, 2, true, 5.0D)
            AS t(date_setting, price_type_ref, item_ref, active, item_price)""")})
    got = I.price_history(t, date(2024, 1, 1), Settings()).orderBy("date_setting").collect()
    assert [(r.item_id, r.item_price) for r in got] == [("a", 2.0), ("a", 3.0)]


def test_category_count_unknown_when_a_value_is(spark):
    t = FrameTables({
        "item_dim": spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "item_id string, group_ref int"),
        "group_dim": spark.createDataFrame([(1, 7), (2, None)], "ref int, category_ref int"),
        "category_dim": spark.createDataFrame([(7, "K")], "ref int, category_id string")})
    v = spark.createDataFrame([(SNAP[0], "s", "a", 5.0), (SNAP[0], "s", "b", None), (SNAP[0], "s", "c", 1.0), (SNAP[1], "s", "a", 5.0)],
                              "date date, store_id string, item_id string, balance_sum double")
    got = {r.date: (r.category_inventory_sum, r.category_sku) for r in I.inv_category(v, t).collect()}
    assert got == {SNAP[0]: (5.0, None), SNAP[1]: (5.0, 1)}
    assert I.inv_category(v, t).filter(F.col("category_id") != "K").count() == 0


def test_stock_moves_once_by_reference_and_once_by_item(spark):
    """From the decoded rows to the sums by category nothing is dealt out again, however little is broadcast."""
    items = "SELECT 1 AS ref, 'a' AS item_id, 1 AS group_ref UNION ALL SELECT 2, 'b', 1"
    t = FrameTables({
        "stock_balance": spark.sql("SELECT timestamp'3999-11-01' AS date_balance, 1 AS store_ref, * FROM VALUES (1, 5.0D), (1, 1.0D), (2, 3.0D) AS v(item_ref, item_store_qty)"),
        "stock_movement": spark.sql("SELECT timestamp'2024-01-05' AS date_movement, true AS active, 1 AS store_ref, 1 AS item_ref, 0 AS type_motion, 2.0D AS item_motion_qty"),
        "batch_balance": spark.sql("SELECT timestamp'3999-11-01' AS date_balance, 1 AS store_ref, 1 AS item_ref, 6.0D AS item_store_qty, 30.0D AS item_store_sum, 0.0D AS item_store_vat, 1 AS receipt_doc_ref"),
        "batch_movement": spark.sql("SELECT timestamp'2024-01-05' AS date_movement, true AS active, 1 AS store_ref, 1 AS item_ref, 0 AS type_motion, 2.0D AS item_motion_qty, 10.0D AS item_store_sum, 0.0D AS item_store_vat, 1 AS receipt_doc_ref"),
        "receipt_doc": spark.sql("SELECT 1 AS ref, timestamp'2023-12-01 08:00:00' AS date"),
        "assembly_doc": spark.sql("SELECT 9 AS ref, timestamp'2023-12-02' AS date"),
        "store_dim": spark.sql("SELECT * FROM VALUES (1, 's', 2), (2, 'p', 2) AS v(ref, store_id, parent_ref)"),
        "item_dim": spark.sql(items),
        "group_dim": spark.sql("SELECT 1 AS ref, 7 AS category_ref"),
        "category_dim": spark.sql("SELECT 7 AS ref, 'K' AS category_id"),
        "price_type_dim": spark.sql("SELECT 1 AS ref, '000000005' AS price_type_id"),
        "price_history": spark.sql("SELECT timestamp'2023-06-01' AS date_setting, 1 AS price_type_ref, 2 AS item_ref, true AS active, 2.0D AS item_price")})
    start, cfg = SNAP[0], Settings()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        prices = I.prices_at(I.price_history(t, start, cfg), SNAP)
        v = I.inv_lifo_value(I.inv_history(t, start, SNAP[1], cfg), I.inv_batch_history(t, start, SNAP[1], cfg), prices, SNAP)
        df = I.inv_category(v, t)
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = {r.date: (r.category_inventory_sum, r.category_sku) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {SNAP[0]: (4 * 5.0 + 6.0, 2), SNAP[1]: (6 * 5.0 + 6.0, 2)}
    dealt = [line.split("Exchange hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert len([d for d in dealt if d.startswith("item_id#") and "REPARTITION_BY_COL" in d]) == 2
    assert not [d for d in dealt if "item_id#" in d and "store_id#" in d]
    assert len([d for d in dealt if "store_id#" in d]) == 1  # the sums by category


def test_categories_of_all_snapshots_as_columns(spark):
    """The columns give what rows per snapshot give: no stock at a date, an unknown value, a negative one."""
    wide = spark.createDataFrame(
        [("s", "a", 1.0, 5.0, 0.0, None), ("s", "b", 2.0, None, 1.0, 3.0), ("s", "c", 1.0, -1.0, None, 7.0),
         (None, "a", 0.0, 1.0, 4.0, 8.0), ("s", "z", 1.0, 1.0, 1.0, 1.0), ("u", "b", 0.0, 0.0, None, None)],
        "store_id string, item_id string, b0 double, balance_sum0 double, b1 double, balance_sum1 double")
    t = FrameTables({"item_dim": spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("z", 3)], "item_id string, group_ref int"),
                     "group_dim": spark.createDataFrame([(1, 1), (2, 2), (3, 9)], "ref int, category_ref int"),
                     "category_dim": spark.createDataFrame([(1, "K"), (2, "L")], "ref int, category_id string")})
    long = wide.select("store_id", "item_id", I._per_snapshot(SNAP, "b", "balance_sum")).filter("_s.b != 0").select(
        "_s.date", "store_id", "item_id", "_s.balance_sum")
    got = I._category_sums(wide, SNAP, t)
    assert rows(got) == rows(I.inv_category(long, t)) and got.count() == 4
    assert got.columns == I.inv_category(long, t).columns
    # one row of an item is dealt out, whatever the number of snapshots
    tree = got._jdf.queryExecution().optimizedPlan().toString()
    assert tree.index("Generate") < tree.index("Aggregate")

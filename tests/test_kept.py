"""Data kept between runs: lines by month, first receipts, closed months, whatever order rows come in."""
import random
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from registry.driver_tables import CFG, FINISH, DriverTables
from registry.queries import SNAPSHOTS, START, START_LONG, laid_out, stable, with_checkpoints
from shelfledger.kept.clients import FirstReceipts
from shelfledger.kept.folders import Versions, folders
from shelfledger.kept.lines import LineLayout
from shelfledger.kept.stock import StockMonths
from shelfledger.operators import inventory, loyalty, sales
from shelfledger.sources.readers import FrameTables

from .conftest import rows

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark):
    return DriverTables(with_checkpoints(spark), SF)


# ---- check lines by the month of their report ------------------------------------------------------

LINE = "report_ref int, check_nmbr int, check_time timestamp, item_ref int, item_sum double"


def line(report, n, day="2001-03-05", item=1, total=1.0):
    return (report, n, datetime.fromisoformat(day) if day else None, item, total)


def head_frame(spark, heads):
    return spark.createDataFrame([(r, datetime.fromisoformat(d)) for r, d in heads], "report_ref int, date timestamp")


def test_rows_of_reports_are_those_without_the_layout(spark, tables):
    laid = laid_out(tables)
    assert rows(laid["check_line"]) == rows(tables["check_line"])
    for start in (START, START_LONG):
        assert rows(stable(sales.sale_report(laid, start, FINISH, CFG))) == rows(stable(sales.sale_report(tables, start, FINISH, CFG)))
        assert rows(stable(sales.sale_check_category(laid, start, FINISH, CFG))) == rows(stable(sales.sale_check_category(tables, start, FINISH, CFG)))


def test_only_the_months_of_the_window_are_read(spark, tables):
    """The scan of the lines is pruned by the months of the reports, at run time, whatever the joins above."""
    laid = laid_out(tables)
    df = sales.sale_check_category(laid, START, FINISH, CFG)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*month.*dynamicpruning", plan)
    assert len(folders(spark, f"{laid.layouts['check_line'].root}/lines")) > 60


def test_late_lines_of_old_reports_land_in_the_month_of_the_report(spark, tmp_path):
    layout = LineLayout(spark, str(tmp_path))
    heads = head_frame(spark, [(1, "2001-01-31T10:00"), (2, "2001-02-01T00:00"), (3, "2001-03-15T00:00")])
    made = lambda lines: spark.createDataFrame(lines, LINE)
    layout.add(made([line(1, 1, "2001-01-31"), line(2, 2, "2001-02-10")]), heads, "a", F.col("check_time"))
    # a line rung years later, one without a time, one of an unknown report, one of no report
    layout.add(made([line(1, 3, "2004-07-01"), line(3, 4, None), line(9, 5, "2002-05-20"), line(None, 6)]), heads, "b", F.col("check_time"))
    month = {r.check_nmbr: str(r.month) for r in layout.lines.collect()}
    assert month == {1: "2001-01-01", 2: "2001-02-01", 3: "2001-01-01", 4: "2001-03-01", 5: "2002-05-01", 6: "1900-01-01"}
    # the unknown report shows up, and another one changes its date: their lines are found all the same
    moved = head_frame(spark, [(1, "2001-01-31T10:00"), (2, "2003-12-01T00:00"), (9, "2001-03-02T00:00")])
    assert sorted(r.check_nmbr for r in layout.of(moved).collect()) == [1, 2, 3, 5]
    layout.add(made([line(2, 7), line(9, 8)]), moved, "c", F.col("check_time"))
    assert sorted((r.check_nmbr, str(r.month)) for r in layout.lines.filter("check_nmbr > 6").collect()) == [(7, "2001-02-01"), (8, "2002-05-01")]
    assert sorted(r.check_nmbr for r in layout.of(moved.filter("report_ref in (2, 9)")).collect()) == [2, 5, 7, 8]


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    layout = LineLayout(spark, str(tmp_path))
    heads = head_frame(spark, [(1, "2001-01-31T10:00"), (2, "2001-02-01T00:00")])
    made = lambda lines: spark.createDataFrame(lines, LINE)
    layout.add(made([line(1, 1)]), heads, "a")
    for _ in range(2):
        layout.add(made([line(1, 2), line(2, 3), line(2, 4)]), heads, "b")
    assert sorted(r.check_nmbr for r in layout.of(heads).collect()) == [1, 2, 3, 4]
    assert layout.months.count() == 2
    layout.add(made([]), heads, "c")
    assert layout.lines.count() == 4


# ---- first receipts --------------------------------------------------------------------------------

def receipts(seed, n=400):
    """Headers, footers, desks; some deleted, failed, without client, without footer."""
    r = random.Random(seed)
    heads = [(k % 7, k, datetime(2001, r.randrange(1, 7), r.randrange(1, 28), r.randrange(24)), r.choice([None, *"abcdefghijklmnop"]), 0, k, int(r.random() < 0.1)) for k in range(n)]
    foots = [(k % 7, k, int(r.random() < 0.1), int(r.random() < 0.05)) for k in range(n) if r.random() < 0.95]
    return heads, foots


HEAD = "cash_id int, id int, date timestamp, client string, type int, global_number int, deleted int"
FOOT = "cash_id int, id int, result int, deleted int"


def pos_tables(spark, heads, foots):
    return FrameTables({
        "receipt_header": spark.createDataFrame(heads, HEAD), "receipt_footer": spark.createDataFrame(foots, FOOT),
        "pos": spark.createDataFrame([(k, k + 100) for k in range(6)], "cash_id int, store_id int"),
        "pos_store": spark.createDataFrame([(k + 100, f"s{k % 4}") for k in range(6)], "store_id int, code_subdivision string")})


@pytest.mark.parametrize("seed", [1, 2])
def test_first_receipts_in_any_order_equal_the_full_computation(spark, tmp_path, seed):
    heads, foots = receipts(seed)
    t = pos_tables(spark, heads, foots)
    r = random.Random(seed)
    kept = FirstReceipts(spark, str(tmp_path))
    batch_of = {("h", k): r.randrange(4) for k in range(400)} | {("f", k): r.randrange(4) for k in range(400)}
    for b in (0, 1, 2, 3):
        kept.merge(spark.createDataFrame([h for h in heads if batch_of["h", h[1]] == b], HEAD),
                   spark.createDataFrame([f for f in foots if batch_of["f", f[1]] == b], FOOT), t)
    for window in ((date(2001, 1, 1), date(2001, 3, 1)), (date(2001, 1, 1), date(2001, 7, 1)), (date(2001, 4, 1), date(2001, 5, 1))):
        assert rows(kept.new_cards(*window)) == rows(loyalty.new_cards(t, *window))
    footed = {f[1] for f in foots}
    assert {x.id for x in kept.waiting.read().collect()} == {h[1] for h in heads} - footed  # nothing else waits for ever
    before = rows(kept.clients.read())  # a batch that comes twice changes nothing
    kept.merge(spark.createDataFrame([h for h in heads if batch_of["h", h[1]] == 2], HEAD),
               spark.createDataFrame([f for f in foots if batch_of["f", f[1]] == 2], FOOT), t)
    assert rows(kept.clients.read()) == before


def test_a_merge_reads_the_new_partition_only(spark, tmp_path):
    heads, foots = receipts(3)
    t = pos_tables(spark, heads, foots)
    for name in ("receipt_header", "receipt_footer"):
        t[name].withColumn("loaded", F.col("id") % 3).write.partitionBy("loaded").parquet(f"{tmp_path}/{name}")
    kept = FirstReceipts(spark, f"{tmp_path}/state")
    for b in (1, 2, 0):
        new = [spark.read.parquet(f"{tmp_path}/{n}").filter(f"loaded = {b}") for n in ("receipt_header", "receipt_footer")]
        for df in new:
            assert re.search(r"PartitionFilters: \[.*loaded#\d+ = " + str(b), df._jdf.queryExecution().executedPlan().toString())
        kept.merge(*new, t)
    assert rows(kept.new_cards(date(2001, 1, 1), date(2002, 1, 1))) == rows(loyalty.new_cards(t, date(2001, 1, 1), date(2002, 1, 1)))
    # new cards come from the kept rows, without any receipt
    plan = kept.new_cards(date(2001, 1, 1), date(2002, 1, 1))._jdf.queryExecution().executedPlan().toString()
    assert "loaded" not in plan and "/clients/v" in plan


def test_a_job_that_dies_between_state_and_waiting_is_run_again(spark, tmp_path, monkeypatch):
    heads, foots = receipts(4, 60)
    t = pos_tables(spark, heads, foots)
    kept = FirstReceipts(spark, str(tmp_path))
    early = spark.createDataFrame([h for h in heads if h[1] % 2], HEAD), spark.createDataFrame([f for f in foots if not f[1] % 2], FOOT)
    late = spark.createDataFrame([h for h in heads if not h[1] % 2], HEAD), spark.createDataFrame([f for f in foots if f[1] % 2], FOOT)
    kept.merge(*early, t)
    write = Versions.write

    def dies(self, df):
        if "waiting" in self.root:
            raise RuntimeError("lost")
        return write(self, df)

    monkeypatch.setattr(Versions, "write", dies)
    with pytest.raises(RuntimeError):
        kept.merge(*late, t)
    monkeypatch.undo()
    kept.merge(*late, t)
    window = date(2001, 1, 1), date(2002, 1, 1)
    assert rows(kept.new_cards(*window)) == rows(loyalty.new_cards(t, *window))


def test_versions(spark, tmp_path):
    v = Versions(spark, f"{tmp_path}/x")
    assert v.last is None and v.read() is None
    for k in range(4):
        assert v.write(spark.range(k)).count() == k
    (tmp_path / "x" / "v000009").mkdir()  # an attempt that died
    assert v.last == 4 and v.read().count() == 3 and v.read(2).count() == 1
    v.forget(2)
    assert folders(spark, f"{tmp_path}/x") == ["v000003", "v000004", "v000009"]


# ---- closed months of stock ------------------------------------------------------------------------

def test_kept_months_equal_the_full_roll_back(spark, tables, tmp_path):
    kept = StockMonths(spark, str(tmp_path))
    for closed in range(len(SNAPSHOTS)):
        if closed:
            kept.close(tables, [SNAPSHOTS[closed - 1]])
        stock, batches = kept.moved(tables, "stock", START), kept.moved(tables, "batches", START)
        full = inventory.inv_rollback(inventory.inv_history(tables, START, FINISH, CFG), SNAPSHOTS)
        assert rows(inventory.inv_rollback(inventory.inv_history(tables, START, FINISH, CFG, stock), SNAPSHOTS)) == rows(full)
        close = lambda df: [(a, b, c, d, round(q, 6), round(v, 4)) for a, b, c, d, q, v in rows(df)]
        full = inventory.inv_batch_rollback(inventory.inv_batch_history(tables, START, FINISH, CFG), SNAPSHOTS)
        assert close(inventory.inv_batch_rollback(inventory.inv_batch_history(tables, START, FINISH, CFG, batches), SNAPSHOTS)) == close(full)


def test_closed_months_are_not_scanned(spark, tables, tmp_path):
    """Of the register only what came after the last closed month is read."""
    kept = StockMonths(spark, str(tmp_path))
    kept.close(tables, SNAPSHOTS[:-1])
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
        kept.moved(tables, "stock", START)._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(l_shipdate,2001-04-01" in plan and "l_shipdate,2001-01-01" not in plan
    assert re.search(r"PartitionFilters: \[.*closed#\d+ >= 2001-01-01.*closed#\d+ <= 2001-03-01", plan)


def test_a_month_closed_again_and_an_empty_one(spark, tmp_path):
    def with_moves(moves):
        return FrameTables({"stock_movement": spark.createDataFrame([(datetime.fromisoformat(d), True, s, i, k, q) for d, s, i, k, q in moves],
                                                                    "date_movement timestamp, active boolean, store_ref int, item_ref int, type_motion int, item_motion_qty double"),
                            "batch_movement": spark.createDataFrame([], "date_movement timestamp, active boolean, store_ref int, item_ref int, type_motion int, item_motion_qty double, "
                                                                        "item_store_sum double, item_store_vat double, receipt_doc_ref int")})
    kept = StockMonths(spark, str(tmp_path))
    first = with_moves([("2001-01-05", 1, 1, 0, 5.0), ("2001-03-01", 1, 1, 1, 2.0)])
    kept.close(first, [date(2001, 1, 1), date(2001, 2, 1)])
    assert kept.closed("stock") == kept.closed("batches") == [date(2001, 1, 1), date(2001, 2, 1)]
    assert rows(kept.moved(first, "stock", date(2001, 1, 1)).select("month", "q")) == [(date(2001, 1, 1), 5.0), (date(2001, 3, 1), -2.0)]
    late = with_moves([("2001-02-07", 1, 2, 0, 9.0), ("2001-03-01", 1, 1, 1, 2.0)])
    kept.close(late, [date(2001, 1, 1), date(2001, 2, 1)])  # the only movement of January was taken back
    assert rows(kept.moved(late, "stock", date(2001, 1, 1)).select("month", "q")) == [(date(2001, 2, 1), 9.0), (date(2001, 3, 1), -2.0)]
    # a month between that was never closed is read from the register
    kept.close(late, [date(2001, 4, 1)])
    assert rows(kept.moved(late, "stock", date(2001, 2, 1)).select("month", "q")) == [(date(2001, 2, 1), 9.0), (date(2001, 3, 1), -2.0)]

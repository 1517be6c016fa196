"""The shipped mapping on tables in the stored types, and a run saved and opened again."""
from datetime import date, datetime

from pyspark.sql import functions as F

from registry.driver_tables import CFG, FINISH, DriverTables, tour_legs
from shelfledger.config import Settings
from shelfledger.operators import sales
from shelfledger.plans.run import Run
from shelfledger.plans.saved import SavedRun, save
from shelfledger.sources.erp import POS_TABLES, mapping
from shelfledger.sources.readers import MappedTables

from .conftest import rows

SF = "/root/testdata/sf0.001"
ON, OFF = b"\x01", b"\x00"


def test_mapping_has_every_column_the_operators_read(spark):
    """The driver's logical tables name what is read; a physical table holds each column once."""
    tables, known = DriverTables(spark, SF), mapping()
    names = {n[1:] for n in dir(DriverTables) if n[1:] in known}
    assert names == set(known)
    for n in known:
        # references the operators never follow are not mapped to the driver's tables
        assert set(tables[n].columns) <= set(known[n]["columns"]) | {"subdiv_ref"}, n
        assert len(set(known[n]["columns"].values())) == len(known[n]["columns"])
    assert {n for n in POS_TABLES if f"_{n}" not in dir(DriverTables)} == set()


def test_columns_of_each_kind():
    m = mapping()
    assert m["sale_register"]["columns"]["sale_doc_ref"] == "_Fld17440_RRRef" and m["sale_register"]["columns"]["item_qty"] == "_Fld17445"
    assert m["trip"]["columns"]["store_ref"] == "_Fld12841RRef" and m["trip"]["flags"] == ["posted"]
    assert m["check_line"]["columns"]["report_ref"] == "_Document329_IDRRef"


def stored(spark):
    """A few check reports as the source stores them: binary references and flags, years moved by 2000."""
    ref = lambda n: bytes([n]) * 16
    frames = {
        "_Document329": ([(ref(1), ON, ON, datetime(4024, 3, 1), "R1", ref(7), ref(5)), (ref(2), ON, OFF, datetime(4024, 3, 1), "R2", ref(7), ref(5)),
                          (ref(3), OFF, ON, datetime(4024, 3, 1), "R3", ref(7), ref(5)), (ref(4), ON, ON, datetime(4023, 1, 1), "R4", ref(7), ref(5))],
                         "_IDRRef binary, _Posted binary, _Fld7964 binary, _Date_Time timestamp_ntz, _Number string, _Fld7962RRef binary, _Fld7966RRef binary"),
        # the first check was rung before its report's month; it counts all the same
        "_Document329_VT7992": ([(ref(1), "c1", datetime(4024, 2, 29, 23), ref(9), 2.0, 10.0), (ref(1), "c2", datetime(4024, 3, 1, 9), ref(9), 1.0, 5.0),
                                 (ref(2), "c3", datetime(4024, 3, 1), ref(9), 1.0, 7.0), (ref(4), "c4", datetime(4024, 3, 1), ref(9), 1.0, 7.0)],
                                "_Document329_IDRRef binary, _Fld8019 string, _Fld8020 timestamp_ntz, _Fld7994RRef binary, _Fld7998 double, _Fld7999 double"),
        "_Document329_VT8066": ([(ref(1), 3.0), (ref(4), 9.0)], "_Document329_IDRRef binary, _Fld8070 double"),
        "_AccumRg17487": ([(datetime(4024, 3, 1), ON, ref(5), ref(6), ref(1), ref(9), 2.0, 4.0, 1.0), (datetime(4024, 3, 1), OFF, ref(5), ref(6), ref(1), ref(9), 2.0, 4.0, 1.0)],
                          "_Period timestamp_ntz, _Active binary, _Fld17492RRef binary, _Fld17493RRef binary, _RecorderRRef binary, _Fld17488RRef binary, _Fld17494 double, _Fld17495 double, _Fld17496 double"),
        "_Reference120": ([(ref(9), "i9", "item", 1, None, None, None, None, ON, OFF)],
                          "_IDRRef binary, _Code string, _Description string, _Fld20858 int, _Fld2060RRef binary, _Fld2045RRef binary, _ParentIDRRef binary, _Fld2039RRef binary, _Fld2068 binary, _Marked binary"),
        "_Reference135": ([(ref(5), "s5", "shop", None, None, OFF)], "_IDRRef binary, _Code string, _Description string, _ParentIDRRef binary, _Fld18502RRef binary, _Marked binary"),
        "_Reference128": ([(ref(7), "o7")], "_IDRRef binary, _Code string"),
    }
    return {n: spark.createDataFrame(*f) for n, f in frames.items()}


def test_reports_from_the_stored_types(spark):
    frames = stored(spark)
    t = MappedTables(frames.__getitem__, mapping())
    got = sales.sale_report(t, date(2024, 3, 1), date(2024, 4, 1), Settings()).collect()
    assert [(r.date, r.nmbr_checks_report, r.subdiv_id, r.organization_id, r.checks_report_sum, r.total_checks_qty, r.checks_report_sku, r.doc_reg_cust_sum, r.doc_cost_sum) for r in got] == [
        (datetime(2024, 3, 1), "R1", "s5", "o7", 15.0, 2, 2, 3.0, 5.0)]


def test_flags_of_every_stored_kind(spark):
    for value, kind in ((ON, "binary"), (1, "int"), (True, "boolean")):
        off = {"binary": OFF, "int": 0, "boolean": False}[kind]
        t = MappedTables(lambda n, v=value, o=off, k=kind: spark.createDataFrame([(v,), (o,), (None,)], f"f {k}"), {"x": {"table": "x", "columns": {"flag": "f"}, "flags": ["flag"]}})
        assert rows(t["x"]) == [(None,), (False,), (True,)]
        assert t["x"].filter("flag").count() == 1


def test_run_saved_and_opened_again(spark, tmp_path):
    """A run for a day, written and served from its files; the KPI table has one row per store."""
    run = Run.for_day(DriverTables(spark, SF), date(2001, 4, 20), cfg=CFG, legs=tour_legs)
    assert run.finish == FINISH
    again = save(run, str(tmp_path))
    kpis = run.store_kpis
    assert kpis.count() == kpis.select("subdiv_id").distinct().count() > 0
    assert kpis.filter(F.col("subdiv_id").isin(*CFG.logistic_subdivs)).count() == 0
    opened = SavedRun(spark, str(tmp_path), CFG)
    for a in (again, opened):
        assert rows(a.store_kpis) == rows(kpis) and rows(a.proposals) == rows(run.proposals)
        assert rows(a.cards) == rows(run.cards) and rows(a.q75) == rows(run.q75)

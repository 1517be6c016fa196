from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from shelfledger.functions.periods import add_months
from shelfledger.sources import readers as R

from .conftest import rows


@pytest.fixture
def erp(spark, tmp_path):
    """A physical table with its own names, byte flags and dates shifted by 2000 years."""
    spark.sql("""SELECT * FROM VALUES (timestamp_ntz'4024-01-31 10:00:00', 1, 7, 5.0D), (timestamp_ntz'4024-02-29 10:00:00', 1, 8, 6.0D),
        (timestamp_ntz'4024-02-10 00:00:00', 0, 9, 7.0D), (timestamp_ntz'4024-03-01 00:00:00', 1, 9, 7.0D) AS t(_Period, _Active, _Fld1RRef, _Fld2)"""
              ).write.parquet(f"{tmp_path}/_AccumRg1")
    mapping = {"stock": {"table": "_AccumRg1", "flags": ["active"],
                         "columns": {"date": "_Period", "active": "_Active", "item_ref": "_Fld1RRef", "qty": "_Fld2"}}}
    return R.MappedTables(lambda n: spark.read.parquet(f"{tmp_path}/{n}"), mapping)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_mapped_slice_unshifts_dates(erp):
    df = erp.register("stock", "date", date(2024, 2, 1), date(2024, 3, 1), ["active"])
    assert rows(df.select("date", "item_ref")) == [(datetime(2024, 2, 29, 10), 8)]


def test_slice_reaches_the_scan_and_prunes_columns(erp):
    text = plan(erp.register("stock", "date", date(2024, 2, 1), date(2024, 3, 1)).select("item_ref"))
    assert "GreaterThanOrEqual(_Period" in text and "LessThan(_Period" in text
    assert "_Fld2" not in text.split("ReadSchema")[1]


def test_parquet_tables_and_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, m string")
    R.write_table(df, f"{tmp_path}/x", ["m"])
    t = R.ParquetTables(spark, str(tmp_path))
    assert rows(t["x"].select("k", "m")) == [(1, "a"), (2, "b")]
    assert t["x"] is t["x"]
    assert "PartitionFilters: [isnotnull(m" in plan(t["x"].filter(F.col("m") == "a"))


def test_missing_table_is_an_error():
    with pytest.raises(KeyError):
        R.FrameTables({})["nothing"]


def test_cut_lineage_keeps_rows(spark):
    df = R.cut_lineage(spark.range(5).withColumn("x", F.col("id") * 2))
    assert df.agg(F.sum("x")).first()[0] == 20
    assert "Range" not in plan(df)
    assert spark.sparkContext.getCheckpointDir()


def test_month_arithmetic():
    assert add_months(date(2024, 1, 1), 12) == date(2025, 1, 1)

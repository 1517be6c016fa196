from datetime import date, datetime

from pyspark.sql import functions as F

from shelfledger.config import NAME_CLEANING
from shelfledger.functions import periods as P
from shelfledger.functions import semantics as S


def one(spark, col, values, schema="x double"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(col).collect()]


def test_membership_null_rules(spark):
    vals = ["a", "b", None]
    assert one(spark, S.in_local(F.col("x"), ["a"]), vals, "x string") == [True, False, False]
    assert one(spark, S.not_in_local(F.col("x"), ["a"]), vals, "x string") == [False, True, True]
    assert one(spark, S.not_in_sql(F.col("x"), ["a"]), vals, "x string") == [False, True, None]


def test_ifelse_keeps_unknown(spark):
    assert one(spark, S.r_ifelse(F.col("x") > 1, F.lit("y"), F.lit("n")), [2.0, 0.0, None]) == ["y", "n", None]


def test_bankers_round_halves(spark):
    assert one(spark, S.bankers_round(F.col("x")), [0.5, 1.5, 2.5, -0.5, -1.5]) == [0.0, 2.0, 2.0, 0.0, -2.0]
    # noise of the last bits must not decide an exact half
    assert one(spark, S.bankers_round(F.col("x"), 2), [0.125, 0.125 + 1e-15, 0.135 - 1e-14, 1.005]) == [0.12, 0.12, 0.14, 1.0]
    # once, not first to six digits; and beyond the last bits a half is none
    assert one(spark, S.bankers_round(F.col("x")), [1.4999996, 2.5000004, 0.5 + 1e-9, -2.5, 1e17]) == [1.0, 3.0, 1.0, -2.0, 1e17]


def test_strict_and_lenient_sums(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("c", None)], "k string, x double")
    got = {r.k: (r.s, r.z) for r in df.groupBy("k").agg(
        S.r_sum(F.col("x")).alias("s"), S.sum_or_zero(F.col("x")).alias("z")).collect()}
    assert got == {"a": (None, 1.0), "b": (2.0, 2.0), "c": (None, 0.0)}


def test_conditional_and_local_distinct_counts(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", None)], "k string, x double")
    got = {r.k: (r.c, r.d) for r in df.groupBy("k").agg(
        S.conditional_count(F.col("x") > 1).alias("c"), S.count_distinct_local(F.col("x")).alias("d")).collect()}
    assert got == {"a": (1, 2), "b": (None, 2)}


def test_division_by_zero_is_null(spark):
    assert one(spark, S.safe_div(F.lit(1.0), F.col("x")), [0.0, 2.0]) == [None, 0.5]


def test_record_signs(spark):
    df = spark.createDataFrame([(0, 5.0), (1, 5.0), (None, 5.0)], "k int, x double")
    assert [r[0] for r in df.select(S.sign_by_kind(F.col("k"), F.col("x"))).collect()] == [5.0, -5.0, None]
    assert [r[0] for r in df.select(S.negate_when(F.col("k"), 1, F.col("x"))).collect()] == [5.0, -5.0, None]


def test_name_cleaning_first_match_and_bar(spark):
    vals = ["ТоргівельнийЦентр роздріб роздріб", "|оздріб x", "Кам'янець-Подільський"]
    assert one(spark, S.clean_name(F.col("x"), NAME_CLEANING), vals, "x string") == ["ТЦ  роздріб", " x", "Кам-Под"]


def test_texts(spark):
    assert one(spark, S.number_text(F.col("x")), [12.3, 12.0, 10.0, 0.125, None]) == ["12.3", "12", "10", "0.125", None]
    assert one(spark, S.number_text(F.col("x"), 0), [10.0]) == ["10"]
    assert one(spark, S.thousands_text(F.col("x")), [1234567.0, 12.0]) == ["1`234`567", "12"]
    assert one(spark, S.percent_text(F.col("x")), [0.123, 0.1]) == ["12.3%", "10%"]


def test_remap(spark):
    assert one(spark, S.remap(F.col("x"), {"a": "b"}), ["a", "c", None], "x string") == ["b", "c", None]


def test_period_finish(spark):
    days = [date(2024, 3, 19), date(2024, 3, 20), date(2024, 1, 5)]
    want = [date(2024, 2, 1), date(2024, 3, 1), date(2023, 12, 1)]
    assert one(spark, P.period_finish(F.col("x")), days, "x date") == want
    assert [P.period_finish_of(d) for d in days] == want


def test_year_shift_keeps_leap_day(spark):
    back = one(spark, P.shift_years(F.col("x"), -2000), [datetime(4024, 2, 29, 5)], "x timestamp_ntz")
    assert back == [datetime(2024, 2, 29, 5)]


def test_calendars(spark):
    df = spark.createDataFrame([(datetime(2023, 11, 5),), (datetime(2024, 2, 1),)], "d timestamp_ntz")
    assert [r.date for r in P.month_span(df, "d").collect()] == P.months_between(date(2023, 11, 1), date(2024, 2, 1))
    assert P.add_months(date(2024, 1, 1), -3) == date(2023, 10, 1)


def test_texts_sort_by_letters(spark):
    """Ukrainian letters stand where the alphabet has them, not where their code points are."""
    words = ["Яр", "Їжак", "Іній", "Ґанок", "Євро", "Гора", "Дім", "Еко", "Жук", "Йод", "Инше", "а", "А", "10", "9", "Їжак", None]
    df = spark.createDataFrame([(1, w) for w in words] + [(2, None)], "k int, x string")
    got = {r.k: r.s for r in df.groupBy("k").agg(S.sorted_texts(F.col("x")).alias("s")).collect()}
    assert got[1] == ["10", "9", "а", "А", "Гора", "Ґанок", "Дім", "Еко", "Євро", "Жук", "Инше", "Іній", "Їжак", "Йод", "Яр"] and got[2] == []
    assert dict(df.groupBy("k").agg(F.array_join(S.sorted_texts(F.col("x")), ", ").alias("s")).dtypes)["s"] == "string"
    ordered = df.filter("x is not null").distinct().orderBy(S.by_letters(F.col("x"))).select("x").collect()
    assert [r.x for r in ordered] == got[1]


def test_most_common_text_and_ties(spark):
    rows = [("a", "Яр"), ("a", "Їжак"), ("a", "Ґанок"), ("b", "Іній"), ("b", "Яр"), ("b", "Яр"), ("c", None), ("d", "Жук"), ("d", "Євро")]
    df = spark.createDataFrame(rows, "k string, x string")
    got = {r.k: r.m for r in df.groupBy("k").agg(S.most_common(F.col("x")).alias("m")).collect()}
    assert got == {"a": "Ґанок", "b": "Яр", "c": None, "d": "Євро"}

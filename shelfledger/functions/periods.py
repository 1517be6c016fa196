"""Reporting periods and calendars."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_months(d: date, n: int) -> date:
    """First-of-month arithmetic on plain dates."""
    k = d.year * 12 + d.month - 1 + n
    return date(k // 12, k % 12 + 1, d.day)


def period_finish(as_of: Column) -> Column:
    """End of the reporting window: this month's start from day 20 on, else last month's."""
    start = F.trunc(as_of, "month")
    return F.when(F.dayofmonth(as_of) >= 20, start).otherwise(F.add_months(start, -1))


def period_finish_of(as_of: date) -> date:
    """``period_finish`` for a plain date, so window bounds stay literals in the plan."""
    start = as_of.replace(day=1)
    return start if as_of.day >= 20 else add_months(start, -1)


def month_floor(c: Column) -> Column:
    return F.to_date(F.date_trunc("month", c))


def months_between(start: date, finish: date) -> list[date]:
    """Month starts from ``start`` to ``finish``, both included."""
    out, d = [], start
    while d <= finish:
        out.append(d)
        d = add_months(d, 1)
    return out


def month_span(df: DataFrame, ts: str) -> DataFrame:
    """Calendar of all months between a column's first and last date."""
    lo, hi = F.min(ts), F.max(ts)
    return df.agg(month_floor(lo).alias("lo"), month_floor(hi).alias("hi")).select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("date"))


def shift_years(c: Column, years: int) -> Column:
    """Move a timestamp by whole years; 2000 is a multiple of 400, so leap days survive."""
    if years == 0:
        return c
    step = F.make_ym_interval(F.lit(abs(years)), F.lit(0))
    return c + step if years > 0 else c - step


def shifted_bound(d: date | datetime, years: int) -> datetime:
    t = d if isinstance(d, datetime) else datetime(d.year, d.month, d.day)
    return t.replace(year=t.year + years)


def minutes_between(start: Column, finish: Column) -> Column:
    return (F.unix_timestamp(finish) - F.unix_timestamp(start)) / F.lit(60)

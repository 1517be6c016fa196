"""Null, rounding and text rules that differ from plain Spark behaviour."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two quantities closer than this count as equal (square root of double epsilon).
NEAR = 1.490116e-8
# Share of a value within which rounding takes it for a half.
HALF = 1e-12


def in_local(c: Column, values: Sequence) -> Column:
    """Membership that is false, never NULL, for a NULL value."""
    return F.coalesce(c.isin(list(values)), F.lit(False))


def not_in_local(c: Column, values: Sequence) -> Column:
    """Negated membership that keeps NULL rows."""
    return F.coalesce(~c.isin(list(values)), F.lit(True))


def not_in_sql(c: Column, values: Sequence) -> Column:
    """Negated membership that drops NULL rows, as SQL does."""
    return ~c.isin(list(values))


def r_ifelse(cond: Column, yes, no) -> Column:
    """Conditional that is NULL where the condition is NULL."""
    return F.when(cond.isNull(), F.lit(None)).when(cond, yes).otherwise(no)


def r_sum(c: Column) -> Column:
    """Sum that is NULL as soon as one value of the group is NULL."""
    return F.when(F.count(c) < F.count(F.lit(1)), F.lit(None)).otherwise(F.sum(c))


def sum_or_zero(c: Column) -> Column:
    """Sum over the known values, 0 when there is none."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def first_by(value: str, order: Sequence[str]) -> Column:
    """Aggregate: the first known ``value`` by the given columns, NULL last in each."""
    place = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"{c}_unknown"), F.col(c))])
    return F.min_by(value, F.when(F.col(value).isNotNull(), place))


def remap(c: Column, mapping: Mapping[str, str]) -> Column:
    """Replace listed codes, leave the others (and NULL) alone."""
    out = None
    for old, new in mapping.items():
        out = F.when(c == old, new) if out is None else out.when(c == old, new)
    return c if out is None else out.otherwise(c)


def safe_div(a: Column, b: Column) -> Column:
    """Division that is NULL on a zero divisor."""
    return F.try_divide(a, b)


def bankers_round(c: Column, digits: int = 0) -> Column:
    """Round once, halves to even.

    Partial sums arrive in any order on a cluster, so their last bits must not decide a
    half: within ``HALF`` of the value's size, it counts as one.
    """
    x = c.cast("double") * F.lit(10.0**digits)
    low = F.floor(x).cast("double")
    half = F.abs(x - low - 0.5) <= F.greatest(F.abs(x), F.lit(1.0)) * HALF
    return (F.when(half, low + F.abs(low % 2)).otherwise(F.rint(x)) / F.lit(10.0**digits)) + 0.0


def near_zero(c: Column) -> Column:
    return F.abs(c) < F.lit(NEAR)


def sign_by_kind(kind: Column, value: Column, plus_kind: int = 0) -> Column:
    """Register sign: the given record kind adds, every other one subtracts."""
    return F.when(kind == plus_kind, value).when(kind.isNotNull(), -value)


def negate_when(kind: Column, negative_kind: int, value: Column) -> Column:
    """Turn the value around for one record kind (refund receipts)."""
    return r_ifelse(kind == negative_kind, -value, value)


def replace_first(c: Column, pattern: str, replacement: str) -> Column:
    """Regex replacement of the first match only."""
    return F.regexp_replace(c, f"^(.*?)(?:{pattern})", "$1" + replacement)


def clean_name(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        c = replace_first(c, pattern, replacement)
    return c


def number_text(c: Column, digits: int = 6) -> Column:
    """Shortest decimal text: 12.30 prints as 12.3 and 12.0 as 12."""
    text = F.format_string(f"%.{digits}f", c)
    if digits > 0:
        text = F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
    return F.when(c.isNotNull(), text)


def by_letters(c: Column) -> Column:
    """A text that sorts as people write it: Г, Ґ, Д and И, І, Ї, Й, whatever their code points, small letters before capitals."""
    return F.collate(c, "uk")


def sorted_texts(c: Column) -> Column:
    """Distinct known texts of a group in order of their letters, as plain texts."""
    return F.transform(F.array_sort(F.transform(F.collect_set(c), by_letters)), lambda x: F.collate(x, "UTF8_BINARY"))


def most_common(c: Column) -> Column:
    """The most common text of a group; of several the first in order of letters."""
    return F.collate(F.mode(by_letters(c), True), "UTF8_BINARY")


def thousands_text(c: Column, mark: str = "`") -> Column:
    """Whole number with a mark between thousands."""
    return F.regexp_replace(F.format_number(c, 0), ",", mark)


def percent_text(c: Column) -> Column:
    return F.concat(number_text(bankers_round(c * 100, 1), 1), F.lit("%"))


def count_distinct_local(c: Column) -> Column:
    """Distinct count in which NULL is one more value."""
    return F.countDistinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))


def conditional_count(cond: Column) -> Column:
    """Number of true rows; NULL when the condition is unknown for any row."""
    return r_sum(cond.cast("bigint"))

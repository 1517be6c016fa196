"""Predicates that split a table of the source system into disjoint parts for parallel reads.

A JDBC read is dealt to tasks by a number or a date column. Most tables of the source
have neither: their key is a reference of 16 bytes. Here references are cut into ranges
of their first bytes, and registers, which have a time, into months. Every row satisfies
exactly one predicate: the first range is open below and takes what has no key, the last
one is open above.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime

from ..functions.periods import months_between, shifted_bound


def server_bytes(key: bytes) -> str:
    """A binary literal of the database server."""
    return f"0x{key.hex().upper()}"


def sql_bytes(key: bytes) -> str:
    """A binary literal of standard SQL."""
    return f"X'{key.hex().upper()}'"


def cut_points(parts: int, width: int = 16) -> list[bytes]:
    """Keys that cut all keys of ``width`` bytes into ``parts`` ranges of equal extent; at most 65,536 ranges."""
    if not 1 <= parts <= 1 << 16:
        raise ValueError("parts must be 1 to 65536")
    return [((k << 16) // parts).to_bytes(2, "big") + bytes(width - 2) for k in range(1, parts)]


def ranges(column: str, bounds: Sequence[str]) -> list[str]:
    """One predicate below, between and above the literals ``bounds``, which ascend."""
    if not bounds:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(bounds, bounds[1:])]
    return [f"{column} < {bounds[0]} OR {column} IS NULL", *inner, f"{column} >= {bounds[-1]}"]


def key_ranges(column: str, parts: int = 0, bounds: Sequence[bytes] = (), width: int = 16,
               literal: Callable[[bytes], str] = server_bytes) -> list[str]:
    """Ranges of a binary key: ``parts`` of equal extent, or cut at the keys ``bounds``.

    Keys whose first bytes are not spread evenly make uneven parts; ``bounds`` then takes
    keys seen at even steps through the table. Bounds may repeat or come in any order.
    """
    cuts = sorted(set(bounds)) or cut_points(parts, width)
    return ranges(column, [literal(c) for c in cuts])


def month_ranges(column: str, start: date, finish: date, shift: int = 0,
                 literal: Callable[[date | datetime], str] = lambda d: f"'{d:%Y-%m-%dT00:00:00}'") -> list[str]:
    """Ranges of a time column by calendar month, from before ``start`` until after ``finish``; years lie ``shift`` ahead in the table."""
    return ranges(column, [literal(shifted_bound(m, shift)) for m in months_between(start.replace(day=1), finish)])


#: Tables whose rows mostly carry one time, that of the current balance: split by item.
BY_KEY = {"stock_balance": "item_ref", "batch_balance": "item_ref"}


def split_plan(mapping: Mapping[str, dict], start: date, finish: date, parts: int = 32, shift: int = 2000) -> dict[str, list[str]]:
    """Predicates per physical table of a mapping: registers by month, all other tables with a reference by its ranges.

    The reference is a table's own (``ref``) or, of line tables, that of the document
    they belong to, which the mapping names first.
    """
    out = {}
    for name, entry in mapping.items():
        columns = entry["columns"]
        first = next(iter(columns.values()))
        if name in BY_KEY:
            out[entry["table"]] = key_ranges(columns[BY_KEY[name]], parts)
        elif "_Period" in columns.values():
            out[entry["table"]] = month_ranges("_Period", start, finish, shift)
        elif first.endswith("_IDRRef"):
            out[entry["table"]] = key_ranges(first, parts)
    return out

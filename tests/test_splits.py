"""Predicates for parallel reads: every row satisfies exactly one."""
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from shelfledger.sources import splits
from shelfledger.sources.erp import mapping
from shelfledger.sources.readers import jdbc_reader


def hits(df, predicates):
    """How many predicates each row satisfies, as a set; a NULL condition is not satisfied, as in WHERE."""
    count = sum((F.when(F.expr(p), 1).otherwise(0) for p in predicates), F.lit(0))
    return {r[0] for r in df.select(count.alias("n")).distinct().collect()}


@pytest.mark.parametrize("parts", [1, 2, 3, 16, 100])
def test_key_ranges_cover_every_key_once(spark, parts):
    r = random.Random(parts)
    edges = [bytes(16), b"\xff" * 16, bytes(15) + b"\x01", b"\x7f" + b"\xff" * 15, b"\x80" + bytes(15)]
    cuts = splits.cut_points(parts)
    around = [x for c in r.sample(cuts, min(40, len(cuts))) for x in (c, c[:-1] + b"\x01", (int.from_bytes(c, "big") - 1).to_bytes(16, "big"))]
    keys = edges + around + [r.randbytes(16) for _ in range(300)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k binary")
    predicates = splits.key_ranges("k", parts, literal=splits.sql_bytes)
    assert len(predicates) == parts and hits(df, predicates) == {1}


def test_parts_of_even_keys_are_even(spark):
    df = spark.range(6400).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("k"))
    n = [df.filter(p).count() for p in splits.key_ranges("k", 8, literal=splits.sql_bytes)]
    assert sum(n) == 6400 and min(n) > 700 and max(n) < 900


def test_ranges_at_given_keys(spark):
    """Where the keys share their first bytes, cuts at keys seen make even parts; repeats and any order do no harm."""
    keys = [bytes(12) + k.to_bytes(4, "big") for k in range(1000)]
    df = spark.createDataFrame([(k,) for k in keys], "k binary")
    assert [df.filter(p).count() for p in splits.key_ranges("k", 4, literal=splits.sql_bytes)] == [1000, 0, 0, 0]
    predicates = splits.key_ranges("k", bounds=[keys[500], keys[250], keys[750], keys[500]], literal=splits.sql_bytes)
    assert [df.filter(p).count() for p in predicates] == [250, 250, 250, 250] and hits(df, predicates) == {1}


def test_month_ranges_cover_every_time_once(spark):
    times = [datetime(1, 1, 1), datetime(4000, 12, 31, 23, 59, 59), datetime(4001, 1, 1), datetime(4001, 1, 31, 23, 59, 59), datetime(4001, 2, 1), datetime(4001, 3, 9), datetime(9999, 12, 31)]
    df = spark.createDataFrame([(t,) for t in times] + [(None,)], "t timestamp_ntz")
    predicates = splits.month_ranges("t", date(2001, 1, 15), date(2001, 3, 1), 2000)
    assert len(predicates) == 4 and hits(df, predicates) == {1}
    assert [df.filter(p).count() for p in predicates] == [3, 2, 1, 2]


def test_plan_of_the_source_splits_what_has_no_number():
    plan, m = splits.split_plan(mapping(), date(2001, 1, 1), date(2001, 4, 1), parts=8), mapping()
    lines, moves, balance = (plan[m[n]["table"]] for n in ("check_line", "stock_movement", "stock_balance"))
    assert len(lines) == 8 and lines[3] == "_Document329_IDRRef >= 0x6000" + "00" * 14 + " AND _Document329_IDRRef < 0x8000" + "00" * 14
    assert moves[0] == "_Period < '4001-01-01T00:00:00' OR _Period IS NULL" and len(moves) == 5
    assert balance[-1].startswith("_Fld17704RRef >= 0xE000")
    by_line = {n for n, e in m.items() if "_VT" in e["table"]}
    assert by_line and all(len(plan[m[n]["table"]]) == 8 for n in by_line)
    # whatever is large has a plan: registers, documents, their lines
    assert {n for n, e in m.items() if e["table"] not in plan and e["table"].startswith(("_AccumRg", "_Document", "_AccRg", "_Crg"))} == set()


class Recorder:
    """Stands for a session's reader: notes what would be read."""

    def __init__(self):
        self.read, self.seen = self, {}

    def format(self, kind):
        self.seen["format"] = kind
        return self

    def options(self, **kw):
        self.seen.setdefault("options", {}).update(kw)
        return self

    def option(self, k, v):
        return self.options(**{k: v})

    def load(self):
        return self.seen

    def jdbc(self, url, table, predicates, properties):
        return {"url": url, "table": table, "predicates": predicates, "properties": properties}


def test_reader_takes_predicates_or_a_number_column():
    options = {"url": "jdbc:x", "user": "u"}
    plan = {"A": ["k < 1 OR k IS NULL", "k >= 1"], "B": {"partitionColumn": "id", "lowerBound": "0", "upperBound": "9", "numPartitions": "3"}}
    assert jdbc_reader(Recorder(), options, plan)("A") == {"url": "jdbc:x", "table": "A", "predicates": plan["A"], "properties": {"user": "u"}}
    assert jdbc_reader(Recorder(), options, plan)("B") == {"format": "jdbc", "options": options | {"dbtable": "B"} | plan["B"]}
    assert jdbc_reader(Recorder(), options)("C") == {"format": "jdbc", "options": options | {"dbtable": "C"}}

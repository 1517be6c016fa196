"""Repeated runs of lines against brute force, and the plan."""
import random

import duckdb
import pytest

from shelfledger.llm import line_dedup
from shelfledger.llm.queries import QUERIES, SQL


def brute(rows, window):
    """rows: distinct (doc_id, text) in order -> text without windows of lines that stand earlier."""
    seen, out = set(), []
    for d, text in rows:
        if text is None:
            out.append((d, None))
            continue
        lines = text.split("\n")
        dead = set()
        for i in range(len(lines) - window + 1):
            key = tuple(lines[i:i + window])
            if key in seen:
                dead |= set(range(i, i + window))
            seen.add(key)
        out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in dead)))
    return out


def documents(seed, n=120):
    r = random.Random(seed)
    made = []
    for d in range(n):
        lines = [r.choice(["a", "b", "c", "", "common", f"own {r.random()}", f"own {r.random()}"]) for _ in range(r.choice([1, 2, 3, 12, 30]))]
        if made and r.random() < 0.4:  # a passage of another document
            other = r.choice(made)[1].split("\n")
            k = r.randrange(len(other))
            lines[1:1] = other[k:k + r.randint(1, 6)]
        made.append((d * 2, "\n".join(lines)))
    return made


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_same_as_brute_force(spark, window):
    rows = documents(window)
    df = spark.createDataFrame([(d, t, len(t), "x", 7) for d, t in rows], "doc_id long, text string, n_chars long, heads string, tag int")
    got = line_dedup.drop_repeated_runs(df.repartition(5), window)
    assert got.columns == df.columns
    got = got.collect()
    assert sorted((r.doc_id, r.text) for r in got) == brute(rows, window)
    assert all(r.n_chars == len(r.text) and (r.heads, r.tag) == ("x", 7) for r in got)


def test_nulls_repeats_and_long_texts(spark):
    long = "\n".join(f"line {k}" for k in range(30000))
    rows = [(1, "p\nq\nr"), (1, "p\nq\nr"), (2, None), (3, ""), (4, "\n\n\n"), (5, "p\nq\nz"), (None, "x\nq\nr"), (None, None), (6, long), (7, f"head\n{long}\ntail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, "p\nq\nr"), (1, "p\nq\nr"), (2, None), (3, ""), (4, ""), (5, "z"), (None, "x"), (None, None), (6, long), (7, "head\ntail")]
    # of the four empty lines the first stays, as each later pair repeats the first pair
    got = [tuple(r) for r in line_dedup.drop_repeated_runs(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert line_dedup.drop_repeated_runs(df.limit(0)).collect() == []


def test_same_rows_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    res = con.execute(SQL["op2_line_dedup"])
    names = [d[0] for d in res.description]
    got = QUERIES["op2_line_dedup"](spark, sf)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(res.fetchall())


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    assert "Python" not in line_dedup.drop_repeated_runs(df)._jdf.queryExecution().toString()


@pytest.mark.parametrize("window", [2, 3])
def test_long_lines_go_alone(spark, window):
    """A line of 50 words that stands earlier goes, whatever is before and after it; shorter ones only in runs."""
    r = random.Random(window)
    line = lambda n: "\t".join(f"w{r.randrange(900)}" for _ in range(n)).replace("\t", " ", n // 2)
    shared = [line(n) for n in (3, 49, 50, 51, 400) for _ in range(3)] + ["a " * 50, "x" * 300]
    rows = [(d, "\n".join(r.choice(shared) if r.random() < 0.4 else line(r.choice([1, 60])) for _ in range(r.choice([1, 2, 6, 12])))) for d in range(60)]
    seen, runs, want = set(), set(), []
    for d, text in rows:
        lines, dead = text.split("\n"), set()
        for i, x in enumerate(lines):
            if len(x.split()) >= 50:
                dead |= {i} if x in seen else set()
                seen.add(x)
            if len(key := tuple(lines[i:i + window])) == window:
                dead |= set(range(i, i + window)) if key in runs else set()
                runs.add(key)
        want.append((d, "\n".join(x for i, x in enumerate(lines) if i not in dead), len(lines), len(dead)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.drop_repeated_runs(df, window, ("n", "gone"), words=50)
    assert sorted(map(tuple, got.collect())) == want

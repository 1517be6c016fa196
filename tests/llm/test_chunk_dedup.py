"""Chunks, repeated passages and what is left of the texts."""
import random

import numpy as np
import pytest

from shelfledger.llm import chunk_dedup


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijé") for _ in range(r.randint(1, 9))) for _ in range(n))


def brute_cuts(text, radius):
    """Places after a hash that is least among its neighbours, from the definition."""
    code = [ord(c) for c in text]
    gear = [int(chunk_dedup.GEAR[(c ^ (c >> 8)) & 0xFF]) for c in code]
    h = [sum(gear[i - k] << k for k in range(min(16, i + 1))) & 0xFFFFFFFF for i in range(len(code))]
    at = [i + 1 for i in range(radius, len(h) - radius) if h[i] < min(h[i - radius:i]) and h[i] <= min(h[i + 1:i + radius + 1])]
    return [*at, len(text)] if text else []


@pytest.mark.parametrize("radius", [1, 5, 20])
def test_cuts_are_the_definition(radius):
    r = random.Random(radius)
    for text in ["", "a", "same " * 50, "é🙂 x" * 9, prose(r, 200), prose(r, 6)]:
        assert chunk_dedup.cuts(text, radius).tolist() == brute_cuts(text, radius)


def test_chunks_come_again_behind_an_insertion():
    r = random.Random(4)
    passage = prose(r, 60)
    sets = []
    for _ in range(2):
        text = f"{prose(r, 30)} {passage} {prose(r, 20)}"
        ends = chunk_dedup.cuts(text)
        sets.append({text[a:b] for a, b in zip([0, *ends[:-1]], ends)})
    shared = sets[0] & sets[1]
    assert sum(map(len, shared)) > len(passage) / 2 and all(s in passage for s in shared)


def brute_spans(rows, least=chunk_dedup.LEAST):
    """rows: (doc_id, text), doc_ids unique -> {doc_id: spans of chunks that stand earlier}."""
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda x: (x[0] is None, x[0])):
        ends = brute_cuts(text or "", chunk_dedup.RADIUS)
        runs = []
        for a, b in zip([0, *ends[:-1]], ends):
            if text[a:b] in seen:
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            seen.add(text[a:b])
        if runs := [x for x in runs if x[1] - x[0] >= least]:
            out[d] = runs
    return out


def corpus(seed):
    r = random.Random(seed)
    passages = [prose(r, 55) for _ in range(4)]
    rows = []
    for k in range(80):
        parts = [prose(r, r.choice([0, 5, 80])) for _ in range(3)]
        if k % 3 == 0:
            parts.insert(r.randrange(3), r.choice(passages))
        rows.append((k * 5, " ".join(parts)))
    return rows + [(1000, rows[7][1]), (1001, ""), (1002, None), (1003, "spam " * 20000), (None, rows[9][1])], passages


def test_spans_and_texts_are_those_of_brute_force(spark):
    rows, passages = corpus(8)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, tag string, starts int").repartition(4)
    spans = chunk_dedup.repeated_spans(df)
    got = {r.doc_id: [list(x) for x in zip(r.starts, r.ends)] for r in spans.collect()}
    assert got == brute_spans(rows)
    holders = [d for d, t in rows if d is not None and any(p in (t or "") for p in passages)]
    first = {min(d for d in holders if p in dict(rows)[d]) for p in passages}
    assert set(holders) - first <= set(got) and set(got) <= set(holders) | {1000, None}
    left = chunk_dedup.drop_spans(df, spans)
    assert left.columns == df.columns
    for d, text, *_ in left.collect():
        full, want, at = dict(rows)[d], "", 0
        for a, b in got.get(d, []):
            want, at = want + full[at:a], b
        assert text == (None if full is None else want + full[at:])


def test_repeated_rows_stay_and_equal_ids_are_told_apart(spark):
    r = random.Random(9)
    a, b = prose(r, 60), prose(r, 60)
    df = spark.createDataFrame([(1, a), (1, a), (2, b), (2, f"{b} and {a}")], "doc_id long, text string")
    spans = chunk_dedup.repeated_spans(df).collect()
    assert all(s.doc_id == 2 for s in spans) and len(spans) in (1, 2)
    left = chunk_dedup.drop_spans(df, chunk_dedup.repeated_spans(df)).collect()
    assert len(left) == 4 and [x.text for x in left if x.doc_id == 1] == [a, a]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert chunk_dedup.repeated_spans(df).collect() == []

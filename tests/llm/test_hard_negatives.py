"""Hard negatives against all scores."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfledger.llm import hard_negatives
from shelfledger.llm.common import ready
from tests.conftest import rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(data, every=100, least=80):
    known = []
    for i, v, l in data:
        if l is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        known.append((i, [math.floor(256 * x) for x in v], (l + 1) % 10 if i is not None and i % 7 == 0 else l))
    out = []
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for i, v, l in known:
        if i is None or i % every:
            continue
        scores = [(sum(a * b for a, b in zip(v, w)), j, m == l) for j, w, m in known if j != i]
        positives = sorted((s for s in scores if s[2]), key=order)[:5]
        for p, pid, _ in positives:
            found = sorted((s for s in scores if not s[2] and least * p <= 100 * s[0] <= 100 * p), key=order)[:5]
            out += [(i, pid, k + 1, nid, p, n) for k, (n, nid, _) in enumerate(found)]
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def mined(df, every=100):
    return rows(hard_negatives.mine(df, F.col("vec_id") % every == 0, label=hard_negatives.noisy_label()))


def vectors(seed, n, dims, labels=3, near=0.5):
    r = np.random.default_rng(seed)
    centre = r.normal(0, 0.2, (labels + 1, dims))
    return [(k, [float(np.float32(x)) for x in near * centre[k % (labels + 1)] + near * centre[0] + r.normal(0, 0.1, dims)], int(r.integers(labels))) for k in range(n)]


@pytest.mark.parametrize("seed, n, dims", [(1, 400, 16), (2, 700, 64), (3, 60, 5)])
def test_equal_to_all_scores(spark, seed, n, dims):
    ready(spark)
    data = vectors(seed, n, dims)
    every = 10
    assert brute(data, every)
    assert mined(spark.createDataFrame(data, SCHEMA), every) == brute(data, every)


def test_parts_of_rows_and_anchors(spark, monkeypatch):
    ready(spark)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "ROWS", 30)
    data = vectors(4, 500, 24)
    assert mined(spark.createDataFrame(data, SCHEMA), 10) == brute(data, 10)


def test_equal_vectors_and_ties(spark):
    ready(spark)
    r = random.Random(6)
    data = [(k, [r.choice([0.0, 0.25, 0.5]) for _ in range(4)], r.randrange(2)) for k in range(300)]
    data += [(1000 + k, [0.5, 0.5, 0.5, 0.5], k % 3) for k in range(300)]
    assert mined(spark.createDataFrame(data, SCHEMA), 10) == brute(data, 10)


def test_nulls_repeats_lengths_extremes_and_extra_columns(spark):
    ready(spark)
    good = vectors(8, 120, 6)
    odd = [(None, [0.3] * 6, 0), (None, [0.3] * 6, 1), (500, None, 1), (600, [0.1] * 6, None), (700, [None] + [0.1] * 5, 1), (800, [float("nan")] * 6, 1),
           (900, [float("inf")] * 6, 1), (1000, [0.2] * 3, 1), (1100, [0.2] * 9, 1), (1200, [], 1), (40, good[40][1], good[40][2]), (41, good[41][1], good[41][2])]
    data = good + odd
    df = spark.createDataFrame(data, SCHEMA)
    assert mined(df, 10) == brute(data, 10)
    wide = df.withColumns({c: F.lit(1) for c in ("v", "i", "j", "key", "nth", "rank", "scores")})
    assert mined(wide, 10) == brute(data, 10)
    assert mined(df.limit(0)) == [] and mined(df.filter("vec_id is null")) == []


def test_large_components_stay_exact(spark):
    ready(spark)
    r = random.Random(9)
    data = [(k, [float(np.float32(r.uniform(-3e4, 3e4))) for _ in range(8)], r.randrange(2)) for k in range(200)]
    assert mined(spark.createDataFrame(data, SCHEMA), 10) == brute(data, 10)
    beyond = mined(spark.createDataFrame([(k, [1e30, -1e30], k % 2) for k in range(40)], SCHEMA), 10)
    assert beyond and all(r[4] == 2 * hard_negatives.LIMIT ** 2 for r in beyond)

"""MinHash fingerprints against exact Jaccard similarity, and the next-document walk."""
import hashlib
import random

import numpy as np
import pytest

from shelfledger.llm import minhash


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(r, n):
    return " ".join(f"w{r.randrange(500)}" for _ in range(n))


def test_likeness_is_close_to_jaccard_and_unbiased():
    r, errors = random.Random(1), []
    for n in [40, 120, 600, 3000] * 30:
        a = prose(r, n)
        b = a[:int(len(a) * r.random())] + " " + prose(r, n // 3)
        errors.append(minhash.likeness(minhash.fingerprint(a), minhash.fingerprint(b)) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05 and np.max(np.abs(errors)) < 0.25


@pytest.mark.parametrize("bins, bits", [(64, 8), (512, 1), (1024, 2)])
def test_other_sizes(bins, bits):
    r = random.Random(2)
    a, c = prose(r, 800), prose(r, 800)
    b = a[:len(a) // 2] + c[:len(c) // 2]
    fa, fb = (minhash.fingerprint(x, bins, bits) for x in (a, b))
    assert len(fa) == bins * bits // 8
    assert abs(minhash.likeness(fa, fb, bits) - jaccard(a, b)) < 5 / bins**0.5


@pytest.mark.parametrize("a, b, want", [("", "", 1), ("", "word", 0), ("one two", "ONE  two", 1), ("one two", "two one", 0), (" \n", "", 1)])
def test_short_texts(a, b, want):
    assert minhash.likeness(minhash.fingerprint(a), minhash.fingerprint(b)) == pytest.approx(want, abs=0.06)


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_every_row_meets_the_next(spark, parts):
    r = random.Random(parts)
    rows = [(k * 2, prose(r, r.choice([0, 1, 3, 50, 200]))) for k in range(60)] + [(8, "é" * 7), (8, "é" * 7), (None, "no id"), (None, None), (500, prose(r, 40000))]
    r.shuffle(rows)
    df = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, edge string, task int").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = minhash.with_next(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    want = []
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        e = t[:len(t) - len(t) // 4] + n[:len(t) // 4]
        fp = [minhash.fingerprint(x) for x in (t, e, n)]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fp[0], fp[1], minhash.likeness(fp[0], fp[1]), minhash.likeness(fp[0], fp[2])))
    assert sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in g) for g in got), key=str) == sorted(want, key=str)


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    only = minhash.with_next(df).collect()
    assert len(only) == 1 and only[0].near_next == 1.0
    assert minhash.with_next(df.limit(0)).collect() == [] and minhash.fingerprints(df.limit(0)).collect() == []

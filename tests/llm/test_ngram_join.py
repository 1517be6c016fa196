"""The exact similarity join against brute force over all pairs."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfledger.llm import ngram_join
from shelfledger.llm.common import ready
from tests.conftest import rows

SCHEMA = "doc_id long, text string"


def shingles(text, words=3):
    w = (text or "").encode().lower().split()
    if len(w) < words:
        return {tuple(w)} if w else set()
    return {tuple(w[k:k + words]) for k in range(len(w) - words + 1)}


def brute(docs, least=90):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    lowest = {}
    for k, (d, _) in enumerate(docs):
        r = find(k)
        if d is not None:
            lowest[r] = min(lowest.get(r, d), d)
    return sorted(((d, len(sets[k]), lowest.get(find(k))) for k, (d, _) in enumerate(docs)), key=lambda r: tuple((x is not None, str(x)) for x in r))


def edited(r, words, n, fresh=True):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"x{r.randrange(10 ** 6)}" if fresh else f"w{r.randrange(30)}"
    return out


def families(seed, vocabulary, groups=12):
    """Groups of copies with few and many edits, chains of edits, shared passages, short texts."""
    r = random.Random(seed)
    prose = lambda n: [f"w{r.randrange(vocabulary)}" for _ in range(n)]
    passage = prose(60)
    texts = []
    for _ in range(groups):
        base = prose(r.choice([9, 12, 30, 100, 300]))
        texts += [base] * r.randrange(1, 4)
        texts += [edited(r, base, r.randrange(0, max(2, len(base) // 12)), r.random() < 0.7) for _ in range(r.randrange(1, 9))]
        chain = base
        for _ in range(6):
            chain = edited(r, chain, 1 + len(chain) // 100)
            texts.append(chain)
        texts.append(base[:-1])
        texts.append(base + prose(len(base) // 10))
        texts.append(passage + prose(r.choice([2, 4, 8, 60])))
    texts += [prose(r.randrange(1, 6)) for _ in range(20)]
    r.shuffle(texts)
    docs = [(k, " ".join(w.upper() if r.random() < 0.1 else w for w in t)) for k, t in enumerate(texts)]
    ids = [d for d, _ in docs]
    r.shuffle(ids)
    return [(i, t) for i, (_, t) in zip(ids, docs)]


@pytest.mark.parametrize("seed, vocabulary", [(1, 3), (2, 30), (3, 1000)])
def test_equal_to_all_pairs(spark, seed, vocabulary):
    ready(spark)
    docs = families(seed, vocabulary)
    assert rows(ngram_join.joined(spark.createDataFrame(docs, SCHEMA))) == brute(docs)


def test_other_threshold_and_one_large_family(spark):
    """Near copies of one text, many of them beyond the radius of each other: several rounds of pivots."""
    ready(spark)
    r = random.Random(5)
    base = [f"w{r.randrange(200)}" for _ in range(150)]
    docs = [(k, " ".join(edited(r, base, r.choice([0, 1, 2, 4, 6])))) for k in range(220)]
    df = spark.createDataFrame(docs, SCHEMA)
    for least in (90, 70):
        assert rows(ngram_join.joined(df, least=least)) == brute(docs, least)


@pytest.mark.parametrize("largest", [4, 40])
def test_regions_beyond_a_leaf_have_pivots(spark, monkeypatch, largest):
    ready(spark)
    monkeypatch.setattr(ngram_join, "LEAF", largest)
    r = random.Random(6)
    base = [f"w{r.randrange(200)}" for _ in range(120)]
    docs = families(4, 30, 4) + [(1000 + k, " ".join(edited(r, base, r.choice([1, 3, 5])))) for k in range(90)]
    assert rows(ngram_join.joined(spark.createDataFrame(docs, SCHEMA))) == brute(docs)


def test_near_copies_of_a_region_are_not_listed_as_pairs(spark):
    """What meets grows with the points of a group, not with its pairs; far points of a region are settled at once."""
    ready(spark)
    r = random.Random(8)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    far = [(1000 + k, " ".join(base[:6] + [f"z{r.randrange(10 ** 6)}" for _ in range(200)])) for k in range(60)]
    for n in (100, 300):
        docs = [(k, " ".join(edited(r, base, 1))) for k in range(n)] + far
        points = ngram_join.placed_rows(spark.createDataFrame(docs, SCHEMA), 3, 90).withColumn("id", F.col("doc_id"))
        members = ngram_join.region_members(points).withColumns({"root": F.col("id"), "seen": F.lit(False)}).cache()
        listed = ngram_join.leaf_pairs(members, points, 0.1)
        assert listed.count() < 2 * members.count()
        one = members.withColumn("region", F.lit(1).cast("long")).distinct()
        assert {(p.id, p.pivot) for p in ngram_join.leaf_pairs(one, points, 0.1).collect()} <= {(a, b) for b in range(n) for a in range(b)}
        assert n - 1 <= ngram_join.leaf_pairs(one, points, 0.1).count() < 2 * n
        # a region seen before gives every pair of different components
        seen = one.withColumns({"seen": F.lit(True), "root": F.when(F.col("id") < 10, F.col("id")).otherwise(10)})
        assert ngram_join.leaf_pairs(seen, points, 0.1).count() == 45 + 10 * (n - 10)
        # and it gives them once, however many regions they share
        twice = seen.union(seen.withColumn("region", F.lit(2).cast("long"))).union(seen.filter("id < 20").withColumn("region", F.lit(-3).cast("long")))
        assert ngram_join.leaf_pairs(twice, points, 0.1).count() == 45 + 10 * (n - 10)


def test_nulls_empty_ties_repeats_and_extra_columns(spark):
    ready(spark)
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "A"), (6, "a b"), (7, "a b c"), (8, "A  b\nC"), (9, "a b c d"),
            (None, "a b c"), (None, None), (None, "q r s"), (3, "z z z z z"), (3, "z z z"), (11, " "), (12, "É é"), (13, "é é")]
    got = rows(ngram_join.joined(spark.createDataFrame(docs, SCHEMA)))
    assert got == sorted([(d, n, d if not n else c) for d, n, c in brute(docs)], key=lambda r: tuple((x is not None, str(x)) for x in r))
    names = ("k1", "k2", "n", "tag", "sketch", "regions", "region", "component_id", "first", "row", "bucket", "id", "pivot")
    wide = spark.createDataFrame(docs, SCHEMA).withColumns({c: F.lit(1) for c in names})
    assert rows(ngram_join.joined(wide)) == got
    assert ngram_join.joined(wide.limit(0)).collect() == []


def test_very_long_text(spark):
    ready(spark)
    r = random.Random(7)
    long = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    docs = [(1, " ".join(long)), (2, " ".join(edited(r, long, 900))), (3, " ".join(edited(r, long, 4000))), (4, "x" * 300_000)]
    got = {d: c for d, _, c in rows(ngram_join.joined(spark.createDataFrame(docs, SCHEMA)))}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_sketch_never_exceeds_the_difference():
    """Also where sketches of different lengths are folded; of like sets it is near, of unlike ones far."""
    r = np.random.default_rng(1)
    for n in (5, 60, 70, 500, 1030, 5000, 40_000):
        a = r.integers(0, 2 ** 63, n).astype(np.uint64)
        for kept, more in ((1.0, 0.0), (0.95, 0.05), (0.5, 0.5), (0.9, 0.2), (0.0, 1.0)):
            b = np.concatenate([a[:int(n * kept)], r.integers(0, 2 ** 63, int(n * more)).astype(np.uint64)])
            bits, apart = ngram_join.differing(ngram_join.sketch(a), ngram_join.sketch(b)), len(set(a.tolist()) ^ set(b.tolist()))
            assert bits <= apart and (kept, more) != (1.0, 0.0) or bits == 0
            if n >= 500 and kept < 0.6 and n <= ngram_join.SKETCH[1]:
                assert bits > 2 * n / 9  # told apart from sets of a similarity of 0.8

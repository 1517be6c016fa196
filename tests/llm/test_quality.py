"""The additive model: its parts against plain loops, and its accuracy on rows it has not seen."""
import random
import zlib

import numpy as np
import pytest

from shelfledger.llm import quality

SF = "/root/testdata/sf0.01"


def test_features_are_their_definition():
    text = "Über the the CAT sat!!\n42 ??? x1.\n中文 the the"
    f = dict(zip(quality.FEATURES, quality.features(text)))
    words, n = text.split(), len(text)
    assert f["log_chars"] == pytest.approx(np.log1p(n)) and f["log_words"] == pytest.approx(np.log1p(len(words)))
    assert f["letters"] == pytest.approx(sum(c.isalpha() for c in text) / n) and f["odd_letters"] == pytest.approx(3 / n)
    assert f["upper"] == pytest.approx(4 / n) and f["digits"] == pytest.approx(3 / n) and f["symbols"] == pytest.approx(5 / n)
    assert f["distinct_words"] == pytest.approx(8 / 11) and f["top_word"] == pytest.approx(4 / 11) and f["repeated_next"] == pytest.approx(2 / 11)
    assert f["no_letters"] == pytest.approx(2 / 11) and f["symbol_ends"] == pytest.approx(2 / 11)  # "sat!!" and "???"
    assert f["stops"] == pytest.approx(3 / 11) and f["distinct_lines"] == 1.0


@pytest.mark.parametrize("text", [None, "", " ", "\n\n", "a", "中" * 10, "word " * 100000])
def test_any_text_has_finite_features(text):
    f = quality.features(text)
    assert f.shape == (len(quality.FEATURES),) and np.isfinite(f).all()


@pytest.mark.parametrize("seed", range(5))
def test_cuts_and_quadrants_are_the_best(seed):
    r = np.random.default_rng(seed)
    g, h = r.normal(size=9), r.random(9)
    gain = lambda a: g[a].sum()**2 / (h[a].sum() + quality.RIDGE)
    want = max((gain(slice(0, k)) + gain(slice(k, 9)) - gain(slice(0, 9)), k) for k in range(1, 9))
    assert quality.best_cut(g, h) == pytest.approx(want)
    g, h = r.normal(size=(4, 5)), r.random((4, 5))
    best = -1.0
    for i in range(1, 4):
        for j in range(1, 5):
            parts = [(slice(a, b), slice(c, d)) for a, b in ((0, i), (i, 4)) for c, d in ((0, j), (j, 5))]
            got = sum(g[p].sum()**2 / (h[p].sum() + quality.RIDGE) for p in parts) - g.sum()**2 / (h.sum() + quality.RIDGE)
            if got > best:
                best, values = got, np.zeros((4, 5))
                for p in parts:
                    values[p] = g[p].sum() / (h[p].sum() + quality.RIDGE)
    found, out = quality.quadrants(g, h)
    assert found == pytest.approx(best) and np.allclose(out, values)


def test_learns_sums_and_pairs():
    r = np.random.default_rng(1)
    x = r.random((4000, len(quality.FEATURES)))
    p = 1 / (1 + np.exp(-(6 * (x[:, 0] - 0.5) + 8 * np.sign(x[:, 3] - 0.5) * np.sign(x[:, 5] - 0.5) * 0.5)))
    y = (r.random(4000) < p).astype(float)
    m = quality.fit(x[:3000], y[:3000])
    assert {(3, 5)} & {(a, b) for a, b, _ in m.pairs}
    right = (m.score(x[3000:]) >= 0.5) == (p[3000:] >= 0.5)
    assert right.mean() > 0.9


def test_constant_without_both_labels():
    x = np.zeros((5, len(quality.FEATURES)))
    assert np.allclose(quality.fit(x, np.ones(5)).score(x), 6 / 7)
    assert np.allclose(quality.fit(x[:0], np.zeros(0)).score(x), 0.5)


def test_accuracy_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    known = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(known) > 40 and np.mean([g.predicted == y for g, y in known]) > 0.95


def test_rows_nulls_and_other_columns(spark):
    r = random.Random(7)
    good = lambda: " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 8))) for _ in range(60)) + "."
    rows = [(k, good() if k % 2 else "BUY!! NOW!! " * 30) for k in range(200)] + [(500, None), (501, ""), (None, good()), (502, good()), (502, good()), (503, "SALE!! " * 40)]
    docs = spark.createDataFrame([(*x, "z", 0.5) for x in rows], "doc_id long, text string, x string, score double")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)] + [(None, 1, 0), (3, None, 0), (9999, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(rows)
    kept = quality.keep_accepted(docs, labels)
    assert kept.columns == docs.columns
    ids = [x.doc_id for x in kept.collect()]
    assert sorted(x for x in ids if x is not None and x < 200) == list(range(1, 200, 2)) and ids.count(502) == 2 and None in ids and 503 not in ids
    # labels of held-out rows do not matter
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    again = quality.score(docs, flipped).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert len(quality.score(docs, labels.limit(0)).select("score").distinct().collect()) == 1
    assert quality.score(docs.limit(0), labels).collect() == []


@pytest.mark.parametrize("sample", [0, 10, 150, 5000])
def test_sample_is_bounded_and_the_same_every_time(spark, sample):
    rows = spark.createDataFrame([(k, [float(k)]) for k in range(2000)], "doc_id long, x array<double>")
    labels = rows.select("doc_id", (quality.F.col("doc_id") % 2).alias("quality"))
    known = sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(2000))
    got = [sorted(map(tuple, quality.labelled(rows.repartition(p), labels, sample).collect())) for p in (3, 7)]
    assert got[0] == got[1] and 0.9 * min(sample, known) <= len(got[0]) <= sample

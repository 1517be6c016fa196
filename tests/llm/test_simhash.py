"""SimHash near-duplicates against brute force over all pairs."""
import random
import re

import numpy as np
import pytest
import xxhash

from shelfledger.llm import simhash


def brute_fp(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: (doc_id, fingerprint) -> the least id each reaches."""
    group = list(range(len(fps)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 3:
                group[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(d, f, least.get(top(i))) for i, (d, f) in enumerate(fps)]


def texts(seed, n=60):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    out = []
    for _ in range(n):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 150, 400]))]
        out.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3])):  # near copies
            base[r.randrange(len(base))] = "changed"
            out.append(" ".join(base))
    return out


@pytest.mark.parametrize("text", ["", "a", "A b", "x Y z", "Ä B c\x0bd\x85e\tf  g", "a " * 70000])
def test_fingerprint_is_the_definition(text):
    assert simhash.fingerprint(text) == brute_fp(text)


def test_groups_are_those_of_all_pairs(spark):
    rows = list(enumerate(texts(5)))
    rows += [(1000, rows[3][1]), (1000, rows[3][1]), (2000, ""), (2001, None), (None, rows[0][1]), (None, "alone here it stands")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, component_id string, fp int")
    got = [(r.doc_id, bytes(r.fp), r.component_id) for r in simhash.near_groups(df).collect()]
    want = [(d, f.to_bytes(8, "big"), c) for d, f, c in brute_components([(d, brute_fp(t)) for d, t in rows])]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_one_of_each_group_stays_with_all_columns(spark):
    a = " ".join(f"w{k}" for k in range(200))
    df = spark.createDataFrame([(5, a, "p"), (3, a, "q"), (3, a, "q"), (9, "other words here", "r"), (None, a, "s")], "doc_id long, text string, kept string")
    kept = simhash.keep_one(df, simhash.near_groups(df))
    assert kept.columns == ["doc_id", "text", "kept"]
    assert sorted(((r.doc_id, r.kept) for r in kept.collect()), key=str) == [(3, "q"), (9, "r"), (None, "s")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_groups(df).collect() == [] and simhash.similar_groups(df).collect() == []
    assert simhash.keep_one(df, simhash.near_groups(df)).collect() == []


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("part", [16, 1 << 13])
def test_links_connect_what_is_near(spark, seed, part, monkeypatch):
    """Hot files too: most fingerprints share one file, which is dealt by parts."""
    monkeypatch.setattr(simhash, "PART", part)
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 2, dtype=np.uint64)
    fps = {int(rng.choice(base)) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(150)}
    nodes = spark.createDataFrame([(f.to_bytes(8, "big"),) for f in fps], "fp binary")
    links = [(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in simhash.near_pairs(simhash.block_files(nodes), 3).collect()]
    far = lambda a, b: bin(a ^ b).count("1")
    assert all(far(a, b) <= 3 for a, b in links)

    def groups(pairs):
        top = {f: f for f in fps}
        for a, b in pairs:
            old, new = top[a], top[b]
            top = {k: new if v == old else v for k, v in top.items()}
        return {frozenset(k for k, v in top.items() if v == t) for t in top.values()}

    assert groups(links) == groups((a, b) for a in fps for b in fps if a < b and far(a, b) <= 3)


@pytest.mark.parametrize("bits, radius", [(64, 12), (128, 26), (256, 0)])
@pytest.mark.parametrize("n", [3, 60, 300])
def test_lanes_of_any_width_and_radius(bits, radius, n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, (3, bits // 64), dtype=np.uint64)
    fp = base[rng.integers(0, 3, n)]
    for row in fp:
        for k in rng.choice(bits, rng.integers(0, radius + 2), replace=False):
            row[k // 64] ^= np.uint64(1 << int(k % 64))
    run = np.sort(rng.integers(0, 4, n))
    a, b = simhash.near_links(fp, run, np.zeros(n, int), radius)
    near = lambda i, j: run[i] == run[j] and int(np.bitwise_count(fp[i] ^ fp[j]).sum()) <= radius

    def groups(pairs):
        top = list(range(n))
        for i, j in pairs:
            top = [top[j] if t == top[i] else t for t in top]
        return {frozenset(k for k in range(n) if top[k] == t) for t in top}

    assert all(near(i, j) for i, j in zip(a, b))
    assert groups(zip(a, b)) == groups((i, j) for i in range(n) for j in range(i) if near(i, j))


def test_similar_texts_meet_and_others_do_not(spark):
    r = random.Random(11)
    words = [f"w{k}" for k in range(4000)]
    rows, pairs = [], []
    for k in range(150):
        base = [r.choice(words) for _ in range(r.choice([60, 250, 600]))]
        copy = list(base)
        for _ in range(max(1, len(base) // 60)):  # shingles in common: 0.85 and more
            copy[r.randrange(len(copy))] = "edited"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        a, b = ({tuple(x[i:i + 5]) for i in range(len(x) - 4)} for x in (base, copy))
        pairs.append(len(a & b) / len(a | b))
    rows += [(1000, ""), (1001, None), (1002, "one two"), (1003, "one  TWO"), (1004, "two one")]
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    close = [got[2 * k] == got[2 * k + 1] for k, j in enumerate(pairs) if j >= 0.8]
    assert len(close) > 100 and np.mean(close) > 0.97
    assert all(got[d] in (d, d - d % 2) for d in range(300))
    assert (got[1000], got[1001], got[1002], got[1003], got[1004]) == (1000, 1000, 1002, 1002, 1004)


def jaccard_groups(rows, least=0.8):
    """The least id each row reaches by links of the exact similarity of 5-word shingle sets."""
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (t.split() for _, t in rows)]
    top = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if top[i] != top[j] and len(a & sets[j]) >= least * len(a | sets[j]):
                top = [top[j] if x == top[i] else x for x in top]
    return {d: min(e for (e, _), y in zip(rows, top) if y == x) for (d, _), x in zip(rows, top)}


@pytest.mark.parametrize("part", [1 << 13, 50])
def test_similar_links_are_those_of_the_exact_similarity(spark, part, monkeypatch):
    """At, above and below 0.8, in short and in hot files, and where one shingle is repeated."""
    monkeypatch.setattr(simhash, "PART", part)
    r = random.Random(12)
    word = lambda: f"w{r.randrange(5000)}"
    texts = []
    for n in [8, 9, 10, 13, 40, 200, 204] * 12:
        base = [word() for _ in range(n)]
        texts.append(base)
        for cut in (0.03, 0.08, 0.11, 0.13, 0.2, 0.3):  # another end: similarity (1 - cut) / (1 + cut) or more
            k = max(1, round(cut * n))
            texts.append(base[:-k] + [word() for _ in range(r.choice([0, k]))])
    frame = [word() for _ in range(80)]
    for _ in range(150):  # one frame, own ends: about 0.65 of each other, some of them with a copy
        own = frame + [word() for _ in range(18)]
        texts += [own, own[:-2] + [word()]] if r.random() < 0.3 else [own]
    tail = [word() for _ in range(40)]
    texts += [["buy"] * 400 + tail, ["buy"] * 5 + tail, ["buy"] * 400 + [word() for _ in range(40)]]
    rows = list(enumerate(" ".join(t) for t in texts))
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_groups(rows)


def test_unlike_rows_of_one_id_stay_each(spark):
    r = random.Random(13)
    text = lambda: " ".join(f"w{r.randrange(4000)}" for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(5, a), (5, b), (5, b), (5, a + " end"), (7, b), (4, c), (8, c), (8, text()), (9, None), (9, c + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stays = set()
    for parts in (1, 7):
        kept = simhash.keep_one(df, simhash.similar_groups(df.repartition(parts)))
        got = sorted(map(tuple, kept.collect()), key=str)
        one = next(x for x in got if x in ((5, a), (5, a + " end")))  # by a hash of the text
        assert got == sorted([one, (5, b), (4, c), rows[7], (9, None)], key=str)
        stays.add(one)
    assert len(stays) == 1

"""Each stage of the pipeline against brute force on its own input, and the whole of it on planted cases."""
import random

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from shelfledger.llm import bpe, decontam, quality

from .test_decontam import brute_distance

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows before the first and after every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == COLUMNS
        out.append(docs.collect())
    return out


def fingerprint(text):
    w = text.encode().lower().split()
    grams = [b" ".join(w[k:k + 3]) for k in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_classifier_keeps_what_it_scores(spark, steps):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in quality.score(docs, labels).collect() if r.predicted}
    assert sorted(steps[1]) == sorted(r for r in steps[0] if r.doc_id in good)
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert np.mean([(d in good) == bool(q) for d, q in known.items()]) > 0.95


def test_lines(steps):
    """Runs of two lines, and lines of 50 words, that stand earlier go."""
    runs, long, want = set(), set(), []
    for d, text in sorted((r.doc_id, r.text) for r in steps[1]):
        lines, dead = text.split("\n"), set()
        for i, x in enumerate(lines):
            pair = tuple(lines[i:i + 2])
            if len(pair) == 2:
                dead |= {i, i + 1} if pair in runs else set()
                runs.add(pair)
            if len(x.encode().split()) >= 50:
                dead |= {i} if x in long else set()
                long.add(x)
        want.append((d, "\n".join(x for i, x in enumerate(lines) if i not in dead)))
    assert sorted((r.doc_id, r.text) for r in steps[2]) == want
    assert all(r.n_chars == len(r.text) for r in steps[2])


def test_near_duplicates(steps):
    """Of the documents that links of 3 bits or fewer connect the one of the least id stays."""
    fp = {r.doc_id: fingerprint(r.text) for r in steps[2]}
    root = {d: d for d in fp}
    for a in sorted(fp):
        for b in fp:
            if (fp[a] ^ fp[b]).bit_count() <= 3 and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = {d: x if r == y else r for d, r in root.items()}
    assert {r.doc_id for r in steps[3]} == set(root.values())
    assert sorted(steps[3]) == sorted(r for r in steps[2] if r.doc_id == root[r.doc_id])


def test_benchmark_passages(spark, steps):
    items = [decontam.folded(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {r.doc_id for r in steps[3]} - {r.doc_id for r in steps[4]}
    held = {r.doc_id for r in steps[3] if any(i in decontam.folded(r.text) for i in items)}
    assert held <= gone
    for r in steps[3]:
        if r.doc_id in gone - held:
            assert any(brute_distance(i, decontam.folded(r.text))[0] <= decontam.EDITS * len(i) for i in items)
    assert sorted(steps[4]) == sorted(r for r in steps[3] if r.doc_id not in gone)


def test_tokens(steps):
    library = Tokenizer.from_file(bpe.DEFAULT)
    assert sorted(r[:5] for r in steps[5]) == sorted(tuple(r) for r in steps[4])
    assert all(r.ids == library.encode(r.text, add_special_tokens=False).ids for r in steps[5])


def test_run_is_all_stages(spark, steps):
    assert sorted(__spark_entry__.queries()["pipeline"](spark, SF).collect()) == sorted(steps[5])


def test_planted_cases(spark, tmp_path):
    """Copies, passages and poor texts go, clean documents stay, also with nulls, repeats and other columns."""
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choice(["th", "er", "on", "an", "re", "in"]) for _ in range(r.randint(1, 4))) for _ in range(n)) + "."
    text = lambda: "\n".join(prose(r.randint(30, 60)) for _ in range(4))
    clean = {k: text() for k in range(100, 140)}
    item = prose(40)
    near = clean[100].split(" ")
    near[50] = "changed"
    rows = [*clean.items(), (200, clean[101]), (201, " ".join(near)), (202, f"{prose(30)} {item} {prose(30)}"), (203, "BUY!! NOW!! " * 50), (204, clean[102]), (104, clean[104]), (None, text()), (205, f"{prose(20)}\n" + clean[103])]
    train = [(k, text() if k % 2 else "SALE!! CHEAP!! " * r.randint(20, 60)) for k in range(1000, 1080)]
    spark.createDataFrame([(*x, "en", "s", len(x[1]), "extra", 1) for x in rows + train], "doc_id long, text string, lang string, source string, n_chars long, kept string, ids int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k, _ in train], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [x.doc_id for x in got if x.doc_id is None or x.doc_id < 1000]
    assert set(clean) <= set(ids) and ids.count(104) == 1 and None in ids
    assert not {202, 203} & set(ids) and len({200, 204} & set(ids)) <= 1 and len(set(ids) - set(clean)) <= 4
    assert {x.doc_id: x.text for x in got}[100] == clean[100]

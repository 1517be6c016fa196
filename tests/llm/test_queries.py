"""The registered queries on the smallest tables against their contracts, written out plainly."""
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from shelfledger.llm import bpe, chunk_dedup, decontam
from shelfledger.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(bpe.DEFAULT)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", ["op11_merkle", "op12_jaccard_join", "op13_hard_negatives"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    res = con.execute(SQL[name])
    names = [d[0] for d in res.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(res.fetchall())


def test_op1(spark, docs):
    fp = {}
    for d, t in docs.items():
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k:k + 3]), 42) for k in range(max(len(w) - 2, 1))] if w else []
        fp[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {d: d for d in fp}
    for a in sorted(fp):
        for b in fp:
            if (fp[a] ^ fp[b]).bit_count() <= 3 and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = {d: x if r == y else r for d, r in root.items()}
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, SF).collect()}
    assert got == {(d, f"{fp[d]:016x}", root[d]) for d in docs}


def regular(n):
    """Two regular words of one length that sums of powers do not tell apart."""
    word = [0]
    while len(word) < n:
        word += [1 - x for x in word]
    return ["xxxxxxxx" + "".join("ab"[x ^ k] for x in word) for k in (0, 1)]


@pytest.mark.parametrize("order, files", [(1, 1), (-1, 1), (1, 2), (-1, 2)])
def test_op3_and_op4_tell_regular_words_apart(spark, tmp_path, order, files):
    texts = regular(1024)[::order] + ["aaaaaaaaa\x00", "aaaaaaaaa", "aaaaaaaa\x00", "a\x00", "a", "xxxxxxxxx" * 50]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(files).write.parquet(f"{tmp_path}/documents.parquet")
    ids = {k: np.array(LIBRARY.encode(t, add_special_tokens=False).ids, "<u4") for k, t in enumerate(texts)}
    for r in QUERIES["op3_bpe"](spark, str(tmp_path)).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids[r.doc_id]), hashlib.sha256(ids[r.doc_id].tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    for r in QUERIES["op4_token_store"](spark, str(tmp_path)).collect():
        assert r.ids_crc32 == zlib.crc32(np.append(ids[r.doc_id], 2).astype("<u4").tobytes())


def test_op3_and_op4(spark, docs):
    ids = {d: np.array(LIBRARY.encode(t, add_special_tokens=False).ids, "<u4") for d, t in docs.items()}
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op3_bpe"](spark, SF).collect()}
    assert got == {(d, len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(x.tolist(), skip_special_tokens=False).encode()).hexdigest()) for d, x in ids.items()}
    want, start = set(), 0
    for d in sorted(docs):
        x = np.append(ids[d], 2).astype("<u4")
        want.add((d, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op4_token_store"](spark, SF).collect()} == want


def test_op5_names_passages_that_stand_earlier(spark, docs):
    for r in QUERIES["op5_chunk_dedup"](spark, SF).collect():
        assert r.n_spans == len(r.starts) == len(r.ends) == len(r.sources) and r.n_chars_deleted == sum(b - a for a, b in zip(r.starts, r.ends))
        assert all(0 <= a < b <= len(docs[r.doc_id]) for a, b in zip(r.starts, r.ends))
    assert chunk_dedup.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_op6_base_spans(spark, docs):
    kinds = (("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6, 1),
             ("access", re.compile(r"AKIA[A-Z0-9]+"), 20, 0), ("hex", re.compile(r"[0-9a-f]+"), 24, 0))
    for r in QUERIES["op6_secrets"](spark, SF).collect():
        found = [(m.start(), n, name, m.end()) for n, (name, p, least, g) in enumerate(kinds) for m in p.finditer(docs[r.doc_id]) if len(m[g]) >= least]
        spans = [f"{name}:{a}:{b}" for a, _, name, b in sorted(found)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(f[1] == n for f in found) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and set(spans) <= set(r.spans.split(",")) | {""}


def test_op7_edited_texts(spark, docs):
    order = sorted(docs)
    for r in QUERIES["op7_fingerprints"](spark, SF).collect():
        own, after = docs[r.doc_id], docs[order[(order.index(r.doc_id) + 1) % len(order)]]
        n = len(own) // 4
        text = own[:len(own) - n] + after[:n]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (own != text or r.near_edited == 1)


def test_op8_verbatim_items(spark, docs):
    items = {r.item_id: decontam.folded(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op8_decontamination"](spark, SF).collect()}
    held = {(d, i) for d, t in docs.items() for i, x in items.items() if x in decontam.folded(t)}
    assert {k for k, d in got.items() if d == 0} == held
    for (d, i), far in got.items():
        assert far <= decontam.EDITS * len(items[i]) and decontam.distance(items[i], decontam.folded(docs[d]))[0] == far


def test_op10_scores(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op10_quality"](spark, SF).collect()}
    assert set(got) == set(docs)
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([got[d].predicted == q for d, q in labels.items()]) > 0.9

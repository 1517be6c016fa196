"""The token store against the tokenizers library, and its perfect hashes."""
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfledger.llm import bpe, token_store

from .test_bpe import texts

LIBRARY = Tokenizer.from_file(bpe.DEFAULT)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_is_minimal_and_knows_foreign_keys(n):
    keys = np.random.default_rng(n).integers(0, 2**63, (2 * n, 2), dtype=np.uint64)
    own, foreign = keys[:n], keys[n:]
    raw = token_store.build_index(own, np.arange(n), np.arange(n) * 7, np.arange(n) + 1)
    held, entries = token_store.probe(raw, own)
    assert held.all() and (entries["at"] == np.arange(n) * 7).all() and (entries["n"] == np.arange(n) + 1).all()
    assert not token_store.probe(raw, foreign)[0].any()
    assert sorted(token_store.PerfectHash.read(raw)[0].slots(own)) == list(range(n))


def test_equal_keys_are_refused():
    with pytest.raises(ValueError):
        token_store.PerfectHash.build(np.array([[5, 6], [5, 6]], np.uint64))


def test_keys_that_share_a_half_are_told_apart():
    half = np.arange(300, dtype=np.uint64)
    keys = np.stack([np.concatenate([half // 100, half]), np.concatenate([half, half // 100 + 1000])], axis=1)
    raw = token_store.build_index(keys, np.arange(600), np.arange(600), np.arange(600))
    held, entries = token_store.probe(raw, keys)
    assert held.all() and entries["at"].tolist() == list(range(600))


@pytest.mark.parametrize("kept", [0, 50, 10**6])
def test_pieces_from_the_library_are_those_of_whole_texts(kept, monkeypatch):
    monkeypatch.setattr(token_store, "KEPT", kept)
    c = token_store.library_coder(bpe.DEFAULT, bpe.vocabulary(bpe.DEFAULT))
    for group in (texts(5, 300), texts(6, 300), [], [""], texts(5, 300)):
        ids, n = c.encode(group)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])][:len(group)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in group]


def expected(rows):
    out, start, last, copy = [], 0, object(), 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        copy = copy + 1 if d == last else 0
        last = d
        ids = np.array(LIBRARY.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((d, copy, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard", [50, 1 << 23])
def test_every_row_is_found_in_the_files(spark, shard, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_IDS", shard)
    rows = [(k * 3, f"text {k} " * (k % 7)) for k in range(200)] + [(6, None), (6, "again"), (6, "again"), (None, "no key"), (None, ""), (9, "ünï " * 40000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, copy string, start int")
    store = token_store.write(df)
    got = token_store.checksums(store, token_store.all_keys(df)).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[2], r[3])) == expected(rows)
    foreign = spark.createDataFrame([(1, 0), (6, 5), (3, 0)], "doc_id long, copy long")
    assert [r.doc_id for r in store.find(foreign).collect()] == [3]
    n = store.shards.agg(F.sum("n_ids")).first()[0]
    assert n == sum(r[3] for r in expected(rows))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    store = token_store.write(df)
    assert token_store.checksums(store, token_store.all_keys(df)).collect() == []

"""BPE against the tokenizers library, and round trips."""
import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from shelfledger.llm import bpe

LIBRARY = Tokenizer.from_file(bpe.DEFAULT)
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "'", "the", "The", " and", "é", "ß", "½", "²", "Ⅷ", "中文", "🙂", "é", "\x85", "\xa0",
         " ", "​", "\x1c", "\x1f", "\x0b", "!", "...", "123", " 7", "<|endoftext|>", "<|endof", "aaaa", "­", "ª", "_", "٣", "᠎", "﻿", "\x00"]


def texts(seed, n=800):
    r = random.Random(seed)
    return ["", " ", "aaaaaaaaaaaaa", " " * 40, "ab" * 40, *("".join(r.choice(PARTS) for _ in range(r.randint(1, 60))) for _ in range(n))]


@pytest.mark.parametrize("seed", range(3))
def test_pieces_below_256_start_where_the_pattern_says(seed):
    r = random.Random(seed)
    parts = ["'", "'s", "'re", "'ve", "'ll", "'d", "'m", "'t", "s", "re", "r", "l", " ", "  ", "\n", "\xa0", "\x85", "\x1c", "a", "é", "ª", "1", "²", "!", "''", "_", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(4000)]
    code = np.frombuffer("".join(texts).encode("latin-1"), np.uint8)
    begins = np.cumsum([0, *map(len, texts)])[:-1]
    want = [b + m.start() for b, t in zip(begins, texts) for m in bpe.PIECES.finditer(t)]
    assert bpe.latin_starts(code, begins).tolist() == want


@pytest.mark.parametrize("kept", [0, 100, 10**6])
def test_ids_are_those_of_the_library(kept, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", kept)
    c = bpe.Coder(bpe.vocabulary(bpe.DEFAULT))
    for group in (texts(1), texts(2), texts(1)):
        ids, n = c.encode(group)
        for text, own in zip(group, np.split(ids, np.cumsum(n)[:-1])):
            assert own.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, text


def test_any_ids_decode_as_in_the_library():
    r, v = random.Random(3), bpe.vocabulary(bpe.DEFAULT)
    for _ in range(300):
        ids = [r.randrange(v.size) for _ in range(20)]
        assert v.decode(np.array(ids)) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_round_trip_with_nulls_repeats_and_other_columns(spark):
    rows = [(1, "some text", "x"), (1, "some text", "x"), (2, None, None), (3, "", "y"), (None, "é <|endoftext|> " * 30000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    back = bpe.decode(bpe.encode(df))
    assert sorted(back.collect(), key=str) == sorted(((d, t or "") for d, t, _ in rows), key=str)
    for r in bpe.digests(df).collect():
        text = next(t or "" for d, t, _ in rows if d == r.doc_id)
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_empty_table_and_null_ids(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert bpe.decode(spark.createDataFrame([(4, None)], "doc_id long, ids array<int>")).collect() == [(4, "")]

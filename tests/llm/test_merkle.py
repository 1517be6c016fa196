"""Merkle manifest against a tree built and folded by plain loops."""
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from shelfledger.llm import merkle
from shelfledger.llm.common import ready
from tests.conftest import rows

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256(b"".join(p.encode() for p in parts)).hexdigest()


def leaf(r):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def tree(digests):
    """The levels of a tree, the lowest first."""
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k:k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def climb(levels, k, digest):
    """The top from a leaf's digest, and the siblings on the way."""
    siblings = []
    for level in levels[:-1]:
        start = k - k % 16
        run = level[start:start + 16]
        siblings += run[:k - start] + run[k - start + 1:]
        run[k - start] = digest
        digest, k = sha(*run), k // 16
    return digest, siblings


def brute(docs):
    if not docs:
        return []
    groups = {}
    for r in docs:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    over = tree([trees[g][-1][0] for g in names])
    out = []
    for j, g in enumerate(names):
        for k, r in enumerate(groups[g]):
            own = leaf(r)
            new = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                new = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            sub, below = climb(trees[g], k, new)
            folded, above = climb(over, j, sub)
            out.append((r[0], own, trees[g][-1][0], over[-1][0], sha(*below, *above), folded, folded == over[-1][0]))
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def corpus(n, sources, seed=1):
    r = random.Random(seed)
    return [(k * 3, r.choice(sources), r.choice(["en", None]), r.choice([None, k]), r.choice([None, "", f"Öl Text {k}", f"text {k}", "ÄB" * 50])) for k in range(n)]


@pytest.mark.parametrize("n, sources", [
    (1, ["a"]), (2, ["a"]), (16, ["a"]), (17, ["a"]), (40, ["a", "b", None]), (300, ["a"] * 30 + [f"s{k}" for k in range(20)]), (4200, ["hot"] * 9 + ["é", "z", None])])
def test_equal_to_plain_loops(spark, n, sources):
    ready(spark)
    docs = corpus(n, sources)
    got = rows(merkle.tampered_proofs(spark.createDataFrame(docs, SCHEMA)))
    assert got == brute(docs)


def test_more_levels_than_a_tile(spark, monkeypatch):
    """With tiles of one level every path goes through several rounds."""
    ready(spark)
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "TILE", 16)
    docs = [(k, "a" if k % 50 else f"s{k}", "en", k, f"Text {k}") for k in range(700)]
    assert rows(merkle.tampered_proofs(spark.createDataFrame(docs, SCHEMA))) == brute(docs)


def test_nulls_ties_repeats_empty_and_clashing_columns(spark):
    ready(spark)
    docs = [(None, None, None, None, None)] * 3 + [(5, "a", "x", 1, "T")] * 4 + [(5, "a", "x", 1, "U"), (None, "a", None, 0, "Z")]
    df = spark.createDataFrame(docs, SCHEMA)
    assert rows(merkle.tampered_proofs(df)) == brute(docs)
    names = ("leaf", "group", "key", "digest", "tie", "part", "pos", "gid", "left", "replacement", "n", "tile")
    wide = df.withColumns({c: F.lit("x") for c in names})
    assert rows(merkle.tampered_proofs(wide)) == brute(docs)
    empty = merkle.tampered_proofs(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_folding_resumes_the_state_of_the_slot():
    children = [sha(str(k)).encode() for k in range(16)]
    parent = merkle.Parent(children)
    assert len(parent.states) == 16
    for k in range(16):
        new = sha("new").encode()
        assert parent.fold(k, new) == sha(*(c.decode() for c in [*children[:k], new, *children[k + 1:]])).encode()
        assert parent.fold(k, children[k]) == parent.digest


def test_a_proof_holds_for_its_own_row_only(spark):
    """A changed value of any column leads to another root."""
    ready(spark)
    docs = [(k, "s", "en", 1, f"t{k}") for k in range(40)]
    df = spark.createDataFrame(docs, SCHEMA)
    for column, value in (("lang", F.lit(None)), ("n_chars", F.lit(2)), ("text", F.concat("text", F.lit("!")))):
        got = merkle.build(df, replaced={column: value}, where=F.col("doc_id") % 2 == 0).proofs()
        assert all(r.verified == (r.doc_id % 2 == 1) for r in got.collect())

"""Document fingerprints by one-permutation MinHash.

Every shingle is hashed once; the upper part of the hash names a bin and each bin keeps
its least hash. An empty bin takes over the value of a full one, found by a probe order
that is its own and the same for all documents (optimal densification), so that two
documents with equal shingles fill it alike. Of each bin the lowest ``bits`` bits are
stored. Equal bits are partly chance; the likeness is corrected for it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_folder

BINS, BITS, WORDS = 512, 4, 5


@lru_cache(maxsize=4)
def probe_ranks(bins: int) -> np.ndarray:
    """``[empty bin, full bin]``: at which probe an empty bin tries a full one."""
    return np.argsort(np.argsort(np.random.default_rng(bins).random((bins, bins)), axis=1), axis=1).astype(np.uint16 if bins <= 1 << 16 else np.uint32)


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the word shingles, ASCII letters in lower case; fewer words are one shingle."""
    w = text.encode("utf-8", "replace").lower().split()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(x) for x in w], np.uint64)
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, len(h) if len(h) < words else words, np.uint64)
        for k in range(min(words, len(h))):
            out = (out ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def fingerprint(text: str | None, bins: int = BINS, bits: int = BITS, words: int = WORDS) -> bytes:
    """Packed bins of a text; without words no bytes at all. ``bins`` is a power of two, ``bits`` 1, 2, 4 or 8."""
    h = np.sort(shingle_hashes(text or "", words))
    if not len(h):
        return b""
    shift = np.uint64(65 - bins.bit_length())
    first = np.searchsorted(h, np.arange(bins, dtype=np.uint64) << shift)
    value = h[np.minimum(first, len(h) - 1)]
    full = (first < len(h)) & (value >> shift == np.arange(bins, dtype=np.uint64))
    if not full.all():
        own = np.flatnonzero(full)
        empty = np.flatnonzero(~full)
        value[empty] = value[own[np.argmin(probe_ranks(bins)[np.ix_(empty, own)], axis=1)]]
    # another part of the hash than the order within a bin rests on
    low = (value & np.uint64((1 << bits) - 1)).astype(np.uint8)
    per = 8 // bits
    return np.bitwise_or.reduce(low.reshape(-1, per) << (bits * np.arange(per, dtype=np.uint8)), axis=1).tobytes()


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """Estimated share of common shingles, 0 to 1; texts without words are like each other only."""
    if not a or not b:
        return float(a == b)
    x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    parts = (x[:, None] >> (bits * np.arange(8 // bits, dtype=np.uint8))) & ((1 << bits) - 1)
    chance = 0.5**bits
    return float(min(1.0, max(0.0, (np.mean(parts == 0) - chance) / (1 - chance))))


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS, words: int = WORDS) -> DataFrame:
    """``(doc_id, fingerprint)`` of every row, as bytes. Null text is empty; other columns are not read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), bins, bits, words) for t in b.column(1)], pa.binary())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fingerprint", T.BinaryType())]))


def edited_text(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as much of the start of ``following``."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


RESULT = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def with_next(docs: DataFrame) -> DataFrame:
    """Every row fingerprinted, with its edited text and the next document in ascending doc_id (after the last: the first).

    Returns ``doc_id`` and the columns of ``RESULT``. Rows of one doc_id follow each other
    by their text, null ids come first; null text is empty. A single row is its own next.

    Rows are dealt by ranges of doc_id, so a task holds neighbours and passes over them
    once; only the first and the last row of each task wait for a second, small step.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    result = T._parse_datatype_string(RESULT).fields
    whole = T.StructType([T.StructField("doc_id", kind), *result])
    walked = T.StructType([*whole.fields, *T._parse_datatype_string("edge int, task long, text string").fields])

    def row(doc, text, fp, following, next_fp):
        edited = edited_text(text, following)
        efp = fp if edited == text else fingerprint(edited)
        return (doc, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), fp, efp, likeness(fp, efp), likeness(fp, next_fp))

    def batch(rows, schema):
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)], types.names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, task = None, TaskContext.get().partitionId()
        for b in batches:
            out = []
            for doc, text in zip(b.column(0), b.column(1)):
                doc, text = doc.as_py(), text.as_py() or ""
                fp = fingerprint(text)
                if held is None:
                    out.append((doc, len(text), None, fp, None, None, None, 1, task, text))
                else:
                    out.append((*row(*held, text, fp), 0, task, None))
                held = (doc, text, fp)
            if out:
                yield batch(out, walked)
        if held is not None:
            doc, text, fp = held
            yield batch([(doc, len(text), None, fp, None, None, None, 2, task, text)], walked)

    folder = f"{shared_folder(spark)}/fingerprints-{uuid.uuid4().hex}"
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(walk, walked).write.parquet(folder)
    made = spark.read.schema(walked).parquet(folder)
    # one row of two numbers a task is ordered in one task
    tasks = made.filter("edge = 2").select("task")
    order = W.orderBy("task")
    after = tasks.select("task", F.lead("task").over(order).alias("after"), F.min("task").over(W.partitionBy()).alias("least")).select("task", F.coalesce("after", "least").alias("after"))
    first = made.filter("edge = 1").select(F.col("task").alias("after"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fp"))
    last = made.filter("edge = 2").select("doc_id", "text", "fingerprint", "task").join(after, "task").join(first, "after")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield batch([row(*r) for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "fingerprint", "next_text", "next_fp")))], whole)

    ends = last.select("doc_id", "text", "fingerprint", "next_text", "next_fp").mapInArrow(close, whole)
    return made.filter("edge = 0").select(*whole.names).union(ends)

"""Token ids in binary shards, found again by document key through minimal perfect hashes.

Shards hold raw ids (little-endian, two or four bytes) of documents in ascending doc_id
order, behind a header of 16 bytes: magic ``IDS1``, bytes per id, zeros. Keys are dealt to
index buckets by their hash; each bucket's minimal perfect hash gives a key its slot, and
the slot holds a fingerprint of the key, the shard, the offset and the number of ids.

A task writes files of its own name and returns the names; only files named in the
store's tables count, so a task that runs twice leaves nothing but an unread file.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import cut, shared_folder

MAGIC = b"IDS1"
HEADER = 16
#: Ids after which the next document opens a new shard, and keys of an index bucket.
SHARD_IDS, BUCKET_KEYS = 1 << 23, 1 << 15
#: Characters encoded at once, and pieces a worker keeps.
SLAB, KEPT = 1 << 20, 300_000
#: Pieces a worker keeps between tasks: an executor may hold several workers that wait.
IDLE = 60_000

ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("at", "<u8"), ("n", "<u8")])


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of splitmix; a bijection for every seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A hash of both halves of 128-bit keys, two columns of 64 bits."""
    return mix(keys[:, 0] ^ mix(keys[:, 1], seed + 128), seed)


class PerfectHash:
    """Maps n distinct 128-bit keys to 0..n-1 in about three bits a key.

    Each level has a bit for every second position; a key alone at its position owns the
    bit and goes no further. A key's slot is the number of set bits before its own.
    """

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels  # bits as bytes of 0 and 1 would be wasteful: packed words
        self.before = np.cumsum([0, *(int(np.bitwise_count(b).sum()) for b in levels)])
        self.counts = [np.concatenate([[0], np.cumsum(np.bitwise_count(b).astype(np.int64))]) for b in levels]

    @classmethod
    def build(cls, keys: np.ndarray, spread: float = 2.0) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            if len(levels) == 64:
                raise ValueError("keys are not distinct")
            words = max(1, int(np.ceil(spread * len(left) / 64)))
            at = hashed(left, len(levels)) % np.uint64(64 * words)
            alone = np.bincount(at.astype(np.int64), minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at.astype(np.int64)]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for a key that no level holds; a foreign key may get a slot."""
        out, open_ = np.full(len(keys), -1), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = hashed(keys[open_], k) % np.uint64(64 * len(bits))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            own = (bits[word] >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[own]] = (self.before[k] + self.counts[k][word] + below)[own]
            open_ = open_[~own]
        return out

    def to_bytes(self) -> bytes:
        return np.array([len(self.levels), *map(len, self.levels)], "<u8").tobytes() + b"".join(b.tobytes() for b in self.levels)

    @classmethod
    def read(cls, raw: bytes) -> tuple[PerfectHash, int]:
        """The hash at the start of ``raw``, and where it ends."""
        n = int(np.frombuffer(raw, "<u8", 1)[0])
        size = np.frombuffer(raw, "<u8", n, 8).astype(int)
        ends = 8 * (1 + n + np.cumsum(size))
        return cls([np.frombuffer(raw, "<u8", s, int(e) - 8 * s) for s, e in zip(size, ends)]), int(ends[-1]) if n else 8


def build_index(keys: np.ndarray, shard: np.ndarray, at: np.ndarray, n: np.ndarray) -> bytes:
    """A bucket's perfect hash followed by its slots."""
    h = PerfectHash.build(keys)
    entries = np.zeros(len(keys), ENTRY)
    slot = h.slots(keys)
    for name, x in (("print", hashed(keys, 99) >> np.uint64(32)), ("shard", shard), ("at", at), ("n", n)):
        entries[name][slot] = x
    return h.to_bytes() + entries.tobytes()


def probe(index: bytes, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys the bucket holds, and the slots' entries of those."""
    h, end = PerfectHash.read(index)
    entries = np.frombuffer(index, ENTRY, offset=end)
    slot = h.slots(keys)
    held = slot >= 0
    held[held] = entries["print"][slot[held]] == hashed(keys[held], 99) >> np.uint64(32)
    return held, entries[slot[held]]


def with_keys(rows: DataFrame, buckets: int) -> DataFrame:
    """Key and bucket of ``(doc_id, copy)``; copy counts the rows of one doc_id from 0."""
    parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy"), F.col("doc_id").isNull().cast("int")]
    keyed = rows.withColumn("key", F.xxhash64(*parts)).withColumn("key2", F.xxhash64(F.lit("2"), *parts))
    return keyed.withColumn("bucket", F.pmod("key", F.lit(buckets)))


def pairs(keys: pd.DataFrame) -> np.ndarray:
    return keys[["key", "key2"]].to_numpy(np.int64).view(np.uint64)


@dataclass
class TokenStore:
    """Tables of a written store: ``shards`` (shard, file, base, n_ids), ``index`` (bucket, index)."""

    shards: DataFrame
    index: DataFrame
    buckets: int
    key_type: T.DataType

    def find(self, keys: DataFrame) -> DataFrame:
        """``(doc_id, copy, shard, at, n)`` of the keys ``(doc_id, copy)`` that the store holds."""
        def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"doc_id": [], "copy": [], "shard": [], "at": [], "n": []})
            held, e = probe(right["index"].iloc[0], pairs(left))
            out = left.loc[held, ["doc_id", "copy"]]
            return out.assign(shard=e["shard"].astype(np.int64), at=e["at"].astype(np.int64), n=e["n"].astype(np.int64))

        kind = T.StructType([T.StructField("doc_id", T.StringType()), *T._parse_datatype_string("copy long, shard long, at long, n long").fields])
        keyed = with_keys(keys, self.buckets).withColumn("doc_id", F.col("doc_id").cast("string"))
        found = keyed.groupBy("bucket").cogroup(self.index.groupBy("bucket")).applyInPandas(look, kind)
        return found.withColumn("doc_id", F.col("doc_id").cast(self.key_type))

    def read(self, keys: DataFrame, columns: str, of_ids) -> DataFrame:
        """``doc_id``, ``copy``, ``start`` (ids of all documents before it), ``n_tokens`` and ``of_ids(ids)`` of each key."""
        where = self.find(keys).join(self.shards, "shard").select("file", "at", "n", "doc_id", "copy", (F.col("base") + F.col("at")).alias("start"))
        kind = T.StructType([T.StructField("doc_id", self.key_type), *T._parse_datatype_string(f"copy long, start long, n_tokens long, {columns}").fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, raw, width = None, None, 4
            for b in batches:
                out = []
                for file, at, n in zip(*(b.column(c).to_pylist() for c in ("file", "at", "n"))):
                    if file != name:
                        if raw is not None:
                            raw.close()
                        system, path = fs.FileSystem.from_uri(file)
                        name, raw = file, system.open_input_file(path)
                        head = raw.read(HEADER)
                        if head[:4] != MAGIC:
                            raise ValueError(f"{file}: not a shard")
                        width = head[4]
                    raw.seek(HEADER + at * width)
                    out.append(of_ids(np.frombuffer(raw.read(n * width), f"<u{width}")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copy"), b.column("start"), b.column("n"), *(pa.array(x, f.type) for x, f in zip(zip(*out), arrow))], kind.names)
            if raw is not None:
                raw.close()

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = list(to_arrow_schema(kind))[4:]
        return where.repartition("file").sortWithinPartitions("file", "at").mapInArrow(run, kind)


PLAIN = re.compile(r" ?\S+")


def library_coder(path: str, v: bpe.Vocabulary) -> bpe.Coder:
    """Pieces are encoded by the tokenizers library; a piece's ids do not depend on its neighbours.

    Pieces without inner space go to the library a few hundred at a time, as lines of a
    text that it need only split at line feeds: a feed is a piece of its own, and its id
    parts the pieces' ids.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(path)
    whole, by_line = t.pre_tokenizer, pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    feed = t.encode("\n", add_special_tokens=False).ids
    if len(feed) != 1:
        raise ValueError(f"{path}: a line feed is not one id")

    def ids_of(texts: list[str]) -> np.ndarray:
        found = [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))

    def encode_pieces(words):
        lines = [PLAIN.fullmatch(w) is not None for w in words]
        plain = list(compress(words, lines))
        t.pre_tokenizer = by_line
        ids = ids_of(["\n".join([*plain[k:k + 512], ""]) for k in range(0, len(plain), 512)])
        t.pre_tokenizer = whole
        feeds = np.flatnonzero(ids == feed[0])
        apart = [t.encode(w, add_special_tokens=False).ids for w, line in zip(words, lines) if not line]
        flat = np.concatenate([np.delete(ids, feeds), np.array([i for x in apart for i in x], np.uint32)])
        length = np.concatenate([np.diff(feeds, prepend=-1) - 1, np.array([len(x) for x in apart], np.int64)])
        # back to the order asked for
        order = np.empty(len(words), np.int64)
        order[np.argsort(~np.array(lines, bool), kind="stable")] = np.arange(len(words))
        return bpe.gather(flat, (np.cumsum(length) - length)[order], length[order]), length[order]

    return bpe.Coder(v, encode_pieces, KEPT)


_coders: dict[str, bpe.Coder] = {}


def coder(path: str) -> bpe.Coder:
    """This worker's coder; its store of pieces outlives a task.

    Tasks find it by the module: what a task's own function refers to is copied for each.
    """
    if path not in _coders:
        _coders[path] = library_coder(path, bpe.vocabulary(path))
    return _coders[path]


def rest(path: str) -> None:
    """Between tasks a worker keeps few pieces and gives what is free back to the system."""
    coder(path).forget(IDLE)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def write(docs: DataFrame, path: str = bpe.DEFAULT, end_id: int = 2, folder: str | None = None) -> TokenStore:
    """Write every text's ids, each followed by ``end_id``, in ascending doc_id order.

    Rows of one doc_id follow each other by their text and are told apart by their copy
    number; null ids come first. Null and empty texts hold the end id alone. ``folder`` is
    a URI that all executors reach; by default a new one below the session's shared folder.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    doc_id = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(path).encode
        width = 2 if max(bpe.vocabulary(path).size, end_id + 1) <= 1 << 16 else 4
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        task, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        out, shard, at, last, copy = None, -1, 0, object(), 0

        def rows(ids, copies, shards, ats, ns, files):
            return pa.RecordBatch.from_arrays([pa.array(ids, arrow_id), pa.array(copies, pa.int64()), pa.array([task] * len(ns), pa.int64()), pa.array(shards, pa.int64()), pa.array(ats, pa.int64()), pa.array(ns, pa.int64()), pa.array(files, pa.string())], ["doc_id", "copy", "task", "part", "at", "n", "file"])

        for b in batches:
            arrow_id, ids, first = b.schema.field("doc_id").type, b.column(0).to_pylist(), 0
            for group in bpe.slabs((t.as_py() for t in b.column(1)), SLAB):
                flat, length = encode(group)
                cols = [[], [], [], [], [], []]
                for x, part in zip(ids[first:first + len(group)], np.split(flat, np.cumsum(length)[:-1])):
                    if out is None or at >= SHARD_IDS:
                        if out is not None:
                            out.close()
                            yield rows([None], [-1], [shard], [0], [at], [file])
                        shard, at = shard + 1, 0
                        file = f"{folder}/{task:06d}-{shard:04d}-{name}.ids"
                        out = system.open_output_stream(f"{root}/{task:06d}-{shard:04d}-{name}.ids")
                        out.write(MAGIC + bytes([width]) + bytes(HEADER - 5))
                    copy = copy + 1 if x == last else 0
                    last = x
                    out.write(np.append(part, end_id).astype(f"<u{width}").tobytes())
                    for c, y in zip(cols, (x, copy, shard, at, len(part) + 1, None)):
                        c.append(y)
                    at += len(part) + 1
                first += len(group)
                yield rows(*cols)
        if out is not None:
            out.close()
            yield rows([None], [-1], [shard], [0], [at], [file])
        rest(path)

    fields = T._parse_datatype_string("copy long, task long, part long, at long, n long, file string").fields
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = cut(ordered.mapInArrow(run, T.StructType([T.StructField("doc_id", doc_id), *fields])))
    # one row a shard is ordered in one task: a few bytes for some ten megabytes of ids
    order = W.orderBy("task", "part")
    shards = cut(made.filter("copy = -1").select(
        "task", "part", "file", F.col("n").alias("n_ids"), (F.row_number().over(order) - 1).cast("long").alias("shard"),
        (F.sum("n").over(order) - F.col("n")).alias("base")))
    rows = made.filter("copy >= 0")
    buckets = max(1, -(-rows.count() // BUCKET_KEYS))

    def build(keys: pd.DataFrame) -> pd.DataFrame:
        raw = build_index(pairs(keys), keys["shard"].to_numpy(), keys["at"].to_numpy(), keys["n"].to_numpy())
        return pd.DataFrame({"bucket": [keys["bucket"].iloc[0]], "index": [raw]})

    placed = with_keys(rows.join(shards.select("task", "part", "shard"), ["task", "part"]), buckets)
    index = placed.select("bucket", "key", "key2", "shard", "at", "n").groupBy("bucket").applyInPandas(build, "bucket long, index binary")
    index.write.parquet(f"{folder}/index")
    shards.select("shard", "file", "base", "n_ids").write.parquet(f"{folder}/shards")
    return open_store(spark, folder, buckets, doc_id)


def open_store(spark, folder: str, buckets: int, key_type: T.DataType = T.LongType()) -> TokenStore:
    """A store written before; ``buckets`` as :func:`write` has returned it."""
    return TokenStore(spark.read.parquet(f"{folder}/shards"), spark.read.parquet(f"{folder}/index"), buckets, key_type)


def all_keys(docs: DataFrame) -> DataFrame:
    """``(doc_id, copy)`` of every row of a table."""
    n = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))


def checksums(store: TokenStore, keys: DataFrame) -> DataFrame:
    """``(doc_id, copy, start, n_tokens, ids_crc32)`` of each key, from the files."""
    return store.read(keys, "ids_crc32 long", lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),))

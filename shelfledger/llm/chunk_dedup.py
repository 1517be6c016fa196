"""Repeated passages by content-defined chunks.

A gear hash rolls over the characters, each value resting on the last 16. A text is cut
after every character whose hash is the least within ``radius`` characters on both
sides, so cuts depend on nearby characters only: behind an insertion the same chunks
come again, wherever a passage stands. Chunks meet by digest and length; the first place
of each stays. A run of adjacent chunks that all stand earlier in the table is a
repeated passage if it is ``least`` characters long.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, shared_folder

RADIUS, LEAST = 20, 100

#: 256 random numbers, the same on every machine.
GEAR = np.random.default_rng(256).integers(0, 1 << 32, 256, dtype=np.uint32)
HIGH = np.uint32(0xFFFFFFFF)


def gear_hashes(text: str) -> np.ndarray:
    """Rolling hash at every character: the sum of the last 16 gear values, each shifted by its distance."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    h = GEAR[(code ^ (code >> 8)) & 0xFF]
    for s in (1, 2, 4, 8):
        longer = h.copy()
        longer[s:] += h[:-s] << np.uint32(s)
        h = longer
    return h


def cuts(text: str, radius: int = RADIUS) -> np.ndarray:
    """Where the chunks of a text end; the last ends with the text."""
    n = len(text)
    if n <= 2 * radius:
        return np.array([n] if n else [], np.int64)
    h = gear_hashes(text)
    # least of the ``radius`` hashes from each place on, in doubling steps
    low, size = h, 1
    while size < radius:
        step = min(size, radius - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    inner = np.arange(radius, n - radius)
    at = inner[(h[inner] < low[inner - radius]) & (h[inner] <= low[inner + 1])] + 1
    return np.append(at, n)


def chunks(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, tag, start, size, digest)`` of every chunk; tag tells texts of one doc_id apart. Null text has none."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string("tag int, start int, size int, digest long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for b in batches:
            row, tag, start, size, digests, held = [], [], [], [], [], 0

            def batch():
                at = np.concatenate([np.zeros(0, np.int32), *row]).astype(np.int32)
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(np.concatenate([np.zeros(0, np.int32), *x]).astype(np.int32)) for x in (tag, start, size)),
                                                   pa.array(np.array(digests, np.uint64).view(np.int64))], schema.names)

            for k, text in enumerate(b.column(1)):
                text = text.as_py()
                if not text:
                    continue
                ends = cuts(text, radius)
                begins = np.concatenate([[0], ends[:-1]])
                row.append(np.full(len(ends), k))
                tag.append(np.full(len(ends), xxhash.xxh32_intdigest(text) - (1 << 31)))
                start.append(begins)
                size.append(ends - begins)
                digests += [digest(text[i:j]) for i, j in zip(begins.tolist(), ends.tolist())]
                if len(digests) >= 1 << 16:
                    yield batch()
                    row, tag, start, size, digests = [], [], [], [], []
            yield batch()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, radius: int = RADIUS, least: int = LEAST) -> DataFrame:
    """``(doc_id, tag, starts, ends, sources)`` of every text with repeated passages.

    ``starts`` and ``ends`` (exclusive) are code points, in order; ``sources`` holds for
    each passage the doc_id where its first chunk stands first. The first place is that of
    the least doc_id, then tag, then start; null ids come last. Rows equal in doc_id and
    text are one document. Null and empty texts and those without repeats have no row.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    chunks(docs, radius).write.parquet(folder)
    rows = spark.read.parquet(folder)
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "tag", "start")
    first = rows.groupBy("digest", "size").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = rows.join(first, ["digest", "size"]).filter(place > F.col("first")).select("doc_id", "tag", "start", "size", F.col("first.doc_id").alias("source")).distinct()
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("tag", T.IntegerType()), *T._parse_datatype_string("starts array<int>, ends array<int>").fields, T.StructField("sources", T.ArrayType(kind))])

    def join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by text and start; a text may go on in the next batch."""
        from pyspark.sql.pandas.types import to_arrow_schema

        types = [f.type for f in to_arrow_schema(schema)]
        text, runs, run = None, [], None

        def closed():
            kept = [r for r in [*runs, run] if r and r[1] - r[0] >= least]
            return [(*text, *map(list, zip(*kept)))] if kept else []

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], schema.names)

        for b in batches:
            out = []
            for doc, tag, start, size, source in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tag", "start", "size", "source"))):
                if (doc, tag) != text:
                    out += closed() if text else []
                    text, runs, run = (doc, tag), [], None
                if run and run[1] == start:
                    run = (run[0], start + size, run[2])
                else:
                    if run:
                        runs.append(run)
                    run = (start, start + size, source)
            if out:
                yield batch(out)
        if text and (out := closed()):
            yield batch(out)

    return later.repartition("doc_id", "tag").sortWithinPartitions("doc_id", "tag", "start").mapInArrow(join_runs, schema)


def drop_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans of :func:`repeated_spans` cut out of their texts; every row stays, other columns as they are."""
    names = {c: free_name(docs, f"span_{c}") for c in ("doc_id", "tag", "starts", "ends")}
    tagged = free_name(docs, "text_tag")
    tags = F.pandas_udf(lambda t: t.map(lambda x: xxhash.xxh32_intdigest(x) - (1 << 31) if x else 0).astype("int32"), "int")
    spans = spans.select(*[F.col(a).alias(b) for a, b in names.items()])
    left = docs.withColumn(tagged, tags(F.coalesce("text", F.lit(""))))
    met = F.col("doc_id").eqNullSafe(F.col(names["doc_id"])) & (F.col(tagged) == F.col(names["tag"]))
    joined = left.join(spans, met, "left")
    starts, ends = F.col(names["starts"]), F.col(names["ends"])

    def kept(j):
        low = F.when(j == 0, 0).otherwise(F.element_at(ends, F.greatest(j, F.lit(1))))
        high = F.when(j == F.size(starts), F.length("text")).otherwise(F.element_at(starts, F.least(j + 1, F.size(starts))))
        return F.substring(F.col("text"), low + 1, high - low)

    text = F.when(starts.isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.size(starts)), kept), ""))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])

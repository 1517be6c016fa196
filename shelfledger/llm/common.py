"""Helpers shared by the text operators."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="llm-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute once, keep the rows in the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


#: Rows of an Arrow batch: a row holds a whole text, and Spark and Python each hold a batch per task.
BATCH_ROWS = 512


def ready(spark: SparkSession) -> None:
    """Make a session fit for texts, once.

    This library is sent to the executors, whose Python need not have it installed, and
    Arrow batches get ``BATCH_ROWS`` rows at most.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        root = Path(__file__).resolve().parents[2]
        library = __package__.split(".")[0]
        made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='ship-')}/{library}", "zip", root, library)
        sc.addPyFile(made)
        _shipped.add(sc.applicationId)


def gathered(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until ``column`` holds about ``size`` bytes."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.column(column).nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` of every node of an undirected graph; root is the least node it reaches.

    Stars are built round by round: every neighbour is hung below the least node its
    neighbour knows, first the larger ones, then the smaller ones, until each node hangs
    directly below a root. Rounds grow with the logarithm of a component's diameter. A
    node with very many links only meets partial minima and joins that can be split.
    """
    def hang(pairs: DataFrame, emit) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return emit(pairs.join(least, "u")).filter("u <> v").distinct()

    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = hang(both, lambda j: j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        small = hang(large, lambda j: j.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("p"))
                     .select(F.col("p.u").alias("u"), F.col("p.m").alias("v")))
        e = cut(small)
        # done when no node has two parents and no parent has a parent
        n, children = e.agg(F.count("*"), F.count_distinct("u")).first()
        if n == children and not e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").take(1):
            roots = e.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("v"))
            return e.union(roots).select(F.col("u").alias("node"), F.col("v").alias("root"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use."""
    taken = {x.lower() for x in df.columns}
    while name in taken:
        name = f"_{name}"
    return name

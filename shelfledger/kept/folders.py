"""Folders of kept data, in any store that Spark reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to the end."""
    fs, p = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders below ``root``, in order; none where it does not exist."""
    fs, p = _path(spark, root)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


class Versions:
    """A table in versions, each a folder of its own; readers see the last one that is complete.

    A version is written beside the others, so a job that dies leaves the last one as it
    was, and a plan that reads it can make the next.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _numbers(self, done: bool) -> list[int]:
        names = [n for n in folders(self.spark, self.root) if n[:1] == "v" and n[1:].isdigit()]
        return [int(n[1:]) for n in names if not done or complete(self.spark, f"{self.root}/{n}")]

    @property
    def last(self) -> int | None:
        return max(self._numbers(True), default=None)

    def read(self, version: int | None = None) -> DataFrame | None:
        """A version, by default the last complete one; None where there is none."""
        version = self.last if version is None else version
        return None if version is None else self.spark.read.parquet(f"{self.root}/v{version:06d}")

    def write(self, df: DataFrame) -> DataFrame:
        """The next version; what an attempt that died has left under its number is overwritten."""
        version = (self.last or 0) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/v{version:06d}")
        return self.read(version)

    def forget(self, keep: int = 2) -> None:
        """Remove all complete versions but the last ``keep``."""
        for n in sorted(self._numbers(True))[:-keep]:
            fs, p = _path(self.spark, f"{self.root}/v{n:06d}")
            fs.delete(p, True)

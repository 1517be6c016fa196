"""Logical tables over parquet, JDBC or any mapping of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.periods import shift_years, shifted_bound


def flag_of(df: DataFrame, name: str) -> Column:
    """A stored flag as a boolean: one byte 01, a number other than 0, or a boolean already."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.BinaryType):
        return F.col(name) == F.lit(b"\x01")
    if isinstance(kind, T.NumericType):
        return F.col(name) != 0
    return F.col(name).cast("boolean")


def scan_rename(df: DataFrame, columns: Mapping[str, str], flags: Sequence[str] = ()) -> DataFrame:
    """Project and rename (``new -> old``); ``flags`` become booleans.

    A plain projection, so only the named columns reach the file scan; a flag is compared
    in its stored type, so a filter on it does too.
    """
    return df.select(*[(flag_of(df, old) if new in flags else F.col(old)).alias(new) for new, old in columns.items()])


def time_bound(df: DataFrame, ts: str, d: date | datetime, shift: int = 0) -> Column:
    """Literal of the column's own type, so the comparison reaches the scan without a cast."""
    return F.lit(str(shifted_bound(d, shift))).cast(df.schema[ts].dataType)


def register_slice(df: DataFrame, ts: str, start: date | datetime | None = None,
                   finish: date | datetime | None = None, flags: Sequence[str] = (),
                   shift: int = 0) -> DataFrame:
    """Active rows with ``start <= ts < finish``, the stored year shift removed.

    The bounds move instead of the column, so the range still reaches the scan.
    """
    for flag in flags:
        df = df.filter(F.col(flag))
    if start is not None:
        df = df.filter(F.col(ts) >= time_bound(df, ts, start, shift))
    if finish is not None:
        df = df.filter(F.col(ts) < time_bound(df, ts, finish, shift))
    return df.withColumn(ts, shift_years(F.col(ts), -shift)) if shift else df


class Tables(Mapping):
    """Logical tables by name; each is built once and stays lazy."""

    shift = 0

    def __init__(self) -> None:
        self._cache: dict[str, DataFrame] = {}

    def _load(self, name: str) -> DataFrame:
        raise KeyError(name)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self._load(name)
        return self._cache[name]

    def __iter__(self):
        return iter(self._cache)

    def __len__(self) -> int:
        return len(self._cache)

    def register(self, name: str, ts: str, start=None, finish=None,
                 flags: Sequence[str] = ()) -> DataFrame:
        return register_slice(self[name], ts, start, finish, flags, self.shift)

    def lines_of(self, name: str, heads: DataFrame, key: str, window: tuple[date, date] | None = None) -> DataFrame:
        """The rows of ``name`` that belong to ``heads``, joined to them by ``key``.

        ``window`` is the period all heads lie in, for tables that can read less by it.
        """
        return self[name].join(heads, key)

    def unshift(self, df: DataFrame, *columns: str) -> DataFrame:
        """Remove the stored year shift from timestamps read without a slice."""
        for c in columns if self.shift else ():
            df = df.withColumn(c, shift_years(F.col(c), -self.shift))
        return df


class FrameTables(Tables):
    """Tables given as DataFrames."""

    def __init__(self, frames: Mapping[str, DataFrame], shift: int = 0) -> None:
        super().__init__()
        self._cache.update(frames)
        self.shift = shift


class ParquetTables(Tables):
    """One parquet dataset per logical table below ``root``."""

    def __init__(self, spark: SparkSession, root: str, shift: int = 0) -> None:
        super().__init__()
        self.spark, self.root, self.shift = spark, root.rstrip("/"), shift

    def _load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")


class MappedTables(Tables):
    """Physical tables renamed to logical ones.

    ``mapping`` gives per logical table the physical name, the columns
    (``new -> old``) and the flag columns; ``read`` opens a physical table, e.g.
    ``jdbc_reader(spark, options)`` or ``lambda n: spark.read.parquet(f"{root}/{n}")``.
    """

    def __init__(self, read: Callable[[str], DataFrame], mapping: Mapping[str, dict],
                 shift: int = 2000) -> None:
        super().__init__()
        self.read, self.mapping, self.shift = read, mapping, shift

    def _load(self, name: str) -> DataFrame:
        m = self.mapping[name]
        return scan_rename(self.read(m["table"]), m["columns"], m.get("flags", ()))


def jdbc_reader(spark: SparkSession, options: Mapping[str, str],
                split: Mapping[str, Mapping | Sequence[str]] | None = None) -> Callable[[str], DataFrame]:
    """Reader over a JDBC source.

    ``split`` says how a large table is read by many tasks: ``partitionColumn``,
    ``lowerBound``, ``upperBound`` and ``numPartitions`` of a number or time column, or a
    list of disjoint predicates, one for each task, as ``splits`` makes them.
    """
    rest = {k: v for k, v in options.items() if k != "url"}

    def read(table: str) -> DataFrame:
        how = (split or {}).get(table, {})
        if isinstance(how, Mapping):
            return spark.read.format("jdbc").options(**options).option("dbtable", table).options(**how).load()
        return spark.read.jdbc(options["url"], table, predicates=list(how), properties=rest)
    return read


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Save a result as parquet; month-partitioned facts prune on later reads."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder and go on from there.

    Reliable checkpoints survive lost executors. The folder is the one the session names
    in ``spark.checkpoint.dir``; with ``spark.cleaner.referenceTracking.cleanCheckpoints``
    (see ``session``) its files go when nothing refers to them any more.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)

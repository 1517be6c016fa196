"""Lines of documents laid out by the month of their document.

A report and its lines are two tables, and only the report has a date that counts. Read
as they are, the lines of a year mean a scan of all lines ever written. Here every line is
filed under the month of its report, so the reports of a window bring the months that
hold their lines, and only those are read.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import Tables
from .folders import exists

#: Month of lines that nothing dates.
UNDATED = date(1900, 1, 1)


class LineLayout:
    """Lines below ``root`` as ``lines/month=../batch=..``, and ``months``: where each document's lines lie.

    The month of a document is settled with its first line and then stays: that of the
    document's date, or, where the document is not known yet, that of the earliest of
    these lines. Lines are found through ``months``, so they stay found when a document
    changes its date later, and a late line joins those of its document, however old.

    A batch is written under its own name and may be written again: that replaces what an
    attempt before has left. ``months`` of a batch come last and make its new documents
    visible.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "report_ref") -> None:
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    @property
    def lines(self) -> DataFrame:
        """All lines with ``month`` and ``batch``."""
        return self.spark.read.parquet(f"{self.root}/lines")

    @property
    def months(self) -> DataFrame:
        """``(key, month, batch)``, a row for each document with lines."""
        return self.spark.read.parquet(f"{self.root}/months")

    def add(self, lines: DataFrame, heads: DataFrame, batch: str, line_time: Column | None = None) -> None:
        """Take in a batch of new lines; ``heads`` gives ``key`` and ``date`` of the documents known by now.

        ``line_time`` dates lines of unknown documents. Lines without a key belong to no
        document and are kept undated.
        """
        first = F.min(line_time) if line_time is not None else F.lit(None).cast("timestamp")
        seen = lines.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(first.alias("_line"))
        if exists(self.spark, f"{self.root}/months"):
            placed = self.months.filter(F.col("batch") != batch).select(self.key, "month")
            fresh = seen.join(placed, self.key, "left_anti")
        else:
            placed, fresh = None, seen
        dates = heads.select(self.key, F.col("date").alias("_date"))
        month = F.coalesce(*(F.trunc(F.to_date(c), "month") for c in ("_date", "_line")), F.lit(UNDATED))
        settled = fresh.join(dates, self.key, "left").groupBy(self.key).agg(F.min(month).alias("month"))
        settled.write.mode("overwrite").parquet(f"{self.root}/settling/{batch}")
        settled = self.spark.read.parquet(f"{self.root}/settling/{batch}")
        every = settled if placed is None else placed.unionByName(settled)
        filed = lines.join(every, self.key, "left").withColumn("month", F.coalesce("month", F.lit(UNDATED)))
        # files of a month in few tasks, and a large month in several
        self._write(filed.hint("rebalance", "month"), batch, "lines", "month", "batch")
        self._write(settled, batch, "months", "batch")

    def _write(self, df: DataFrame, batch: str, name: str, *by: str) -> None:
        (df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*by).parquet(f"{self.root}/{name}"))

    def of(self, heads: DataFrame) -> DataFrame:
        """The lines of ``heads`` joined to them; only the months that hold such lines are read."""
        wanted = heads.select(self.key).join(self.months.select(self.key, "month"), self.key).select("month").distinct()
        # one row a calendar month: small at any size, and its values prune the partitions
        read = self.lines.join(F.broadcast(wanted), "month", "left_semi").drop("month", "batch")
        return read.join(heads, self.key)


class LaidOut(Tables):
    """Tables of which some are laid out; all others are those of ``base``."""

    def __init__(self, base: Tables, layouts: dict[str, LineLayout]) -> None:
        super().__init__()
        self.base, self.layouts, self.shift = base, layouts, base.shift

    def _load(self, name: str) -> DataFrame:
        return self.layouts[name].lines.drop("month", "batch") if name in self.layouts else self.base[name]

    def lines_of(self, name: str, heads: DataFrame, key: str, window: tuple[date, date] | None = None) -> DataFrame:
        if name not in self.layouts:
            return self.base.lines_of(name, heads, key, window)
        return self.layouts[name].of(heads)

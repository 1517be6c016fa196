"""Signed stock movement of closed months, kept by month, for rolling stock back."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import add_months
from ..operators.inventory import moved_batches, moved_rows
from ..sources.readers import Tables
from .folders import folders

KINDS = {"stock": moved_rows, "batches": moved_batches}


class StockMonths:
    """``stock/month=..`` and ``batches/month=..``: what moved in a month, on references.

    Closing a month reads that month of the registers and replaces its partition, so a
    month may be closed again when movements were posted late. A roll-back then takes the
    kept months, the current stock, and of the registers only what came after the last
    closed month.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def close(self, t: Tables, months: Sequence[date]) -> None:
        """Keep the movement of the given months; each is read and replaced alone."""
        for month in months:
            for kind, moved in KINDS.items():
                rows = moved(t, month, add_months(month, 1)).drop("month")
                # a row of no warehouse, which nothing is joined to: an empty month too gets and replaces a partition
                mark = self.spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
                (rows.unionByName(mark).withColumn("closed", F.lit(month)).write.mode("overwrite")
                 .option("partitionOverwriteMode", "dynamic").partitionBy("closed").parquet(f"{self.root}/{kind}"))

    def closed(self, kind: str) -> list[date]:
        """The closed months in order."""
        names = folders(self.spark, f"{self.root}/{kind}")
        return sorted(date.fromisoformat(n.removeprefix("closed=")) for n in names if n.startswith("closed="))

    def moved(self, t: Tables, kind: str, start: date) -> DataFrame:
        """Movement per month from ``start`` on: kept months, and the register where it is open.

        Months are taken from the register from the first open one on; a gap of months
        that were never closed is therefore read, not lost.
        """
        known = set(self.closed(kind))
        month, kept = start, []
        while month in known:
            kept.append(month)
            month = add_months(month, 1)
        rows = KINDS[kind](t, month)
        if not kept:
            return rows
        old = self.spark.read.parquet(f"{self.root}/{kind}").filter(F.col("closed").between(F.lit(kept[0]), F.lit(kept[-1])))
        return old.filter("store_ref is not null").withColumnRenamed("closed", "month").select(rows.columns).unionByName(rows)

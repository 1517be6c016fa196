"""The first receipt of every client, kept and brought up to date with new receipts only."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.loyalty import cash_store
from ..sources.readers import Tables
from .folders import Versions


class FirstReceipts:
    """One row per client: ``(client, fdate, store)``, and receipts that are still half known.

    A receipt counts once its header and its footer are there. A header that has come without
    a footer, or the other way round, waits in ``waiting`` for a later batch. The first receipt is the least of
    (date, store), so batches may come in any order and twice; late receipts move a
    client's first date back. A receipt that is withdrawn after it was taken in stays;
    a new ``root`` filled from all receipts is the way to correct that.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.clients = Versions(spark, f"{root}/clients")
        self.waiting = Versions(spark, f"{root}/waiting")

    def merge(self, headers: DataFrame, footers: DataFrame, t: Tables) -> DataFrame:
        """Take in new receipts; only these, the kept row per client and what waits are read.

        ``headers`` and ``footers`` are the new rows of these logical tables, ``t`` gives
        the stores of the cash desks. Returns the new state.
        """
        key = ["cash_id", "id"]
        # rows that do not count wait as well, so that the other half finds them and does not wait for ever
        heads = headers.select(*key, "date", "client", ((F.col("deleted") == 0) & F.col("client").isNotNull()).alias("good"))
        foots = footers.select(*key, ((F.col("deleted") == 0) & (F.col("result") == 0)).alias("good"))
        held = self.waiting.read()
        if held is not None:
            heads = heads.unionByName(held.filter("head").select(*heads.columns))
            foots = foots.unionByName(held.filter("not head").select(*foots.columns))
        done = heads.filter("good").drop("good").join(foots.filter("good").select(*key).distinct(), key)
        new = (done.join(cash_store(t), "cash_id", "left").select("client", F.col("date").alias("fdate"), F.col("code_subdivision").alias("store")))
        old = self.clients.read()
        rows = new if old is None else new.unionByName(old)
        first = rows.groupBy("client").agg(F.min(F.struct("fdate", "store")).alias("f")).select("client", "f.fdate", "f.store")
        # the state before what waits: after a job that died between the two, the same batch finds its halves again
        state = self.clients.write(first)
        alone = heads.join(foots.select(*key), key, "left_anti").withColumn("head", F.lit(True))
        lone = foots.join(heads.select(*key), key, "left_anti").withColumn("head", F.lit(False))
        self.waiting.write(alone.unionByName(lone, allowMissingColumns=True).distinct())
        return state

    def new_cards(self, start: date, finish: date) -> DataFrame:
        """Clients by the store of their first receipt, if that falls into the window; from the kept state alone."""
        last = finish - timedelta(days=1)
        return (self.clients.read().filter(F.to_date("fdate").between(F.lit(start), F.lit(last)))
                .groupBy("store").agg(F.count(F.lit(1)).alias("count")))

"""A computed run written to files, and its views served from them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..config import Settings
from ..sources.readers import write_table
from . import rules, views
from .run import Run

RESULTS = ("store_kpis", "category_structure", "store_class", "card_stats", "quarter_growth")


def save(run: Run, root: str) -> SavedRun:
    """Write the five results of a run below ``root`` and open them from there."""
    results = run.results()
    for name in RESULTS:
        write_table(results[name], f"{root}/{name}")
    return SavedRun(run.categories.sparkSession, root, run.cfg)


class SavedRun:
    """The results of a run as files, under the names that a run has for them."""

    def __init__(self, spark: SparkSession, root: str, cfg: Settings | None = None) -> None:
        self.cfg = cfg or Settings()
        self.store_kpis, self.structure, self.classes, self.cards, self.growth = (
            spark.read.parquet(f"{root}/{name}") for name in RESULTS)

    @cached_property
    def q75(self) -> DataFrame:
        return views.quartiles(self.store_kpis, 0.75)

    @cached_property
    def q25(self) -> DataFrame:
        return views.quartiles(self.store_kpis, 0.25)

    @cached_property
    def proposals(self) -> DataFrame:
        return rules.proposals(self.store_kpis, self.q75, self.q25, self.growth, self.cfg)

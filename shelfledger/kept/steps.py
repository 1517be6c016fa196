"""Materialised steps of a run, so one that died goes on where it stopped."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from ..config import Settings
from ..sources.readers import cut_lineage
from .folders import complete, folders

Step = Callable[[], DataFrame]


class Checkpointed:
    """Every step through ``materialize``, by default a checkpoint; nothing outlives the session."""

    def __init__(self, materialize: Callable[[DataFrame], DataFrame] = cut_lineage) -> None:
        self.materialize = materialize

    def __call__(self, name: str, build: Step, *about: object) -> DataFrame:
        return self.materialize(build())


class StepStore:
    """Steps as tables below ``root``, each under what it was computed from.

    ``inputs`` names the state of the source tables, say the time of their last load. A
    step's folder carries a digest of that, of the settings and of the run's period. A
    step whose folder is complete is read and not even planned; one that was left half
    written, or stands under another digest, is computed (again). Steps that were computed
    from other inputs stay until :meth:`forget` removes them.
    """

    def __init__(self, spark: SparkSession, root: str, inputs: str, cfg: Settings | None = None) -> None:
        self.spark, self.root, self.inputs, self.cfg = spark, root.rstrip("/"), inputs, cfg or Settings()
        self.computed: list[str] = []

    def digest(self, *about: object) -> str:
        said = json.dumps([self.inputs, asdict(self.cfg), [str(x) for x in about]], sort_keys=True, default=str)
        return hashlib.sha256(said.encode()).hexdigest()[:24]

    def __call__(self, name: str, build: Step, *about: object) -> DataFrame:
        path = f"{self.root}/{name}/{self.digest(*about)}"
        if not complete(self.spark, path):
            build().write.mode("overwrite").parquet(path)
            self.computed.append(name)
        return self.spark.read.parquet(path)

    def manifest(self) -> dict[str, list[str]]:
        """The digests under which each step is complete."""
        return {name: [d for d in folders(self.spark, f"{self.root}/{name}") if complete(self.spark, f"{self.root}/{name}/{d}")]
                for name in folders(self.spark, self.root)}

    def forget(self, *about: object) -> None:
        """Remove all that does not belong to the present inputs, settings and period."""
        keep = self.digest(*about)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in folders(self.spark, self.root):
            for d in folders(self.spark, f"{self.root}/{name}"):
                if d != keep:
                    p = path(f"{self.root}/{name}/{d}")
                    p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

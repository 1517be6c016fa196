"""A run whose steps outlive it: it goes on after a break and computes again what is stale."""
from dataclasses import replace
from datetime import date

import pytest

from registry.driver_tables import CFG, FINISH, DriverTables, tour_legs
from registry.queries import stable, with_checkpoints
from shelfledger.kept.folders import complete, folders
from shelfledger.kept.steps import Checkpointed, StepStore
from shelfledger.plans.run import Run
from shelfledger.sources.readers import cut_lineage

from .conftest import rows

SF = "/root/testdata/sf0.001"
STEPS = {"sale_month", "expenses", "salary", "crews", "discount_days", "motion_units", "snapshots", "stop_list"}


def make(spark, store, cfg=CFG, finish=FINISH):
    return Run(DriverTables(with_checkpoints(spark), SF), finish, cfg, legs=tour_legs, keep=store)


def test_a_step_is_computed_once_for_its_inputs(spark, tmp_path):
    calls = []

    def build(n):
        return lambda: calls.append(n) or spark.range(n)

    root = str(tmp_path)
    store = StepStore(spark, root, "load 1", CFG)
    assert store("a", build(3), date(2001, 4, 1)).count() == 3
    assert StepStore(spark, root, "load 1", CFG)("a", build(4), date(2001, 4, 1)).count() == 3
    # another load, another period, other settings: computed again
    assert StepStore(spark, root, "load 2", CFG)("a", build(5), date(2001, 4, 1)).count() == 5
    assert store("a", build(6), date(2001, 5, 1)).count() == 6
    assert StepStore(spark, root, "load 1", replace(CFG, overhead_rate=0.07))("a", build(7), date(2001, 4, 1)).count() == 7
    assert store("b", build(8), date(2001, 4, 1)).count() == 8
    assert calls == [3, 5, 6, 7, 8] and {k: len(v) for k, v in store.manifest().items()} == {"a": 4, "b": 1}
    store.forget(date(2001, 4, 1))
    assert {k: len(v) for k, v in store.manifest().items()} == {"a": 1, "b": 1}
    assert store("a", build(9), date(2001, 4, 1)).count() == 3


def test_a_half_written_step_is_computed_again(spark, tmp_path):
    store = StepStore(spark, str(tmp_path), "load 1", CFG)
    folder = tmp_path / "a" / store.digest()
    folder.mkdir(parents=True)
    (folder / "part-00000.parquet").write_bytes(b"torn")
    assert not complete(spark, str(folder)) and store("a", lambda: spark.range(5)).count() == 5


@pytest.fixture(scope="module")
def whole(spark):
    """The KPI table of an unbroken run, which makes eight checkpoints at most."""
    made = []

    def materialize(df):
        made.append(df)
        return cut_lineage(df)

    out = rows(stable(make(spark, Checkpointed(materialize)).store_kpis))
    assert len(made) == len(STEPS) == 8
    return out


def test_a_run_that_broke_goes_on(spark, tmp_path, whole):
    """The run dies after some steps; the next one computes only the others and gives the same table, a third one none."""
    class Breaks(StepStore):
        def __call__(self, name, build, *about):
            if len(self.computed) >= 4:
                raise RuntimeError("lost")
            return super().__call__(name, build, *about)

    broken = Breaks(spark, str(tmp_path), "load 1", CFG)
    run = make(spark, broken)
    with pytest.raises(RuntimeError):
        for step in ("sale_month", "expenses", "salary", "crews", "discount_days", "motion_units", "snapshots", "stop_list"):
            getattr(run, step)
    store = StepStore(spark, str(tmp_path), "load 1", CFG)
    assert rows(stable(make(spark, store).store_kpis)) == whole
    assert len(broken.computed) == 4 and set(broken.computed) | set(store.computed) == STEPS
    assert not set(broken.computed) & set(store.computed)
    assert folders(spark, str(tmp_path)) == sorted(STEPS)
    again = StepStore(spark, str(tmp_path), "load 1", CFG)
    for step in STEPS:
        getattr(make(spark, again), step)
    assert again.computed == []
    # another load, or another setting, makes a step stale
    for stale in (StepStore(spark, str(tmp_path), "load 2", CFG), StepStore(spark, str(tmp_path), "load 1", replace(CFG, manager_share=0.5))):
        _ = make(spark, stale).discount_days
        assert stale.computed == ["discount_days"]

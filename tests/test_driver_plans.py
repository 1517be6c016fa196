"""What the driver holds stays small: flat plans, small filters."""

import re
import threading
import time
from types import SimpleNamespace

import pytest

from registry.driver_tables import CFG, FINISH, DriverTables, tour_legs
from registry.queries import with_checkpoints
from shelfledger.plans.run import Run
from shelfledger.session import RUNTIME_FILTERS
from tests.test_early_filters import plan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    """A run whose kept steps stay plans."""
    return Run(DriverTables(with_checkpoints(spark), SF), FINISH, CFG, legs=tour_legs, keep=lambda name, build, *about: build())


def test_trade_items_leave_no_rounds_in_a_plan(run):
    """Rounds kept in memory stood in each plan that drops non-trade items, thrice for each round after them."""
    for df in (run.motion_units, run.snapshots):
        assert len(re.findall("Exchange ", plan(df))) < 60
    assert "FileScan" not in plan(run.non_trade)


def test_views_read_the_table_and_not_its_facts(run):
    """Quartiles planned the whole run twice, the benchmark of a store five times."""
    assert "Exchange" not in plan(run.store_kpis) and "FileScan" not in plan(run.store_kpis)
    assert "FileScan" not in plan(run.q75.unionByName(run.q25))


def test_few_plans_are_held_at_once(run, monkeypatch):
    """Each plan holds its filters and broadcasts in the driver; six stood side by side."""
    now, most, lock = [], [], threading.Lock()

    def step(self, name):
        with lock:
            now.append(name)
            most.append(len(now))
        time.sleep(0.05)
        with lock:
            now.remove(name)

    monkeypatch.setattr(Run, "_spark_thread", lambda self, fn: step)
    run._together(*"abcdef")
    assert len(most) == 6 and max(most) == 2


def test_without_a_folder_for_checkpoints_steps_stay_in_memory():
    spark = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda name, other: other))
    assert Run._cut(None, SimpleNamespace(sparkSession=spark, persist=lambda: "in memory")) == "in memory"


def test_the_filters_of_a_plan_fit_into_the_driver():
    bits = int(RUNTIME_FILTERS["spark.sql.optimizer.runtime.bloomFilter.numBits"])
    assert bits / 8 * int(RUNTIME_FILTERS["spark.sql.optimizer.runtimeFilter.number.threshold"]) <= 64 << 20

"""Time the headline queries on local cores and print one JSON line.

Every query starts from the files: nothing computed for one query is kept for the next.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from registry import queries
from shelfledger.session import session

HEADLINE = (
    "agg_sum", "asof_price", "sale_report", "sale_structure", "service_profit", "expense_months",
    "salary_month", "account_balance", "delivery_crews", "leg_allocate", "stock_motion",
    "item_root", "inv_movement_batch", "inv_lifo_value", "inv_snapshots", "discount_class",
    "new_cards", "store_kpis",
)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    checkpoints = tempfile.mkdtemp(prefix="bench-")
    spark = session("bench", int(cpus), **{
        "spark.master": f"local[{cpus}]", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": cpus, "spark.checkpoint.dir": checkpoints,
        "spark.python.sql.dataFrameDebugging.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    queries.QUERIES["agg_count"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()
    shutil.rmtree(checkpoints, ignore_errors=True)


if __name__ == "__main__":
    main()

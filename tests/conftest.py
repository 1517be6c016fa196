import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from shelfledger.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", 8, **{
        "spark.master": "local[8]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g",
        # paths below a long temp folder stand whole in plans
        "spark.sql.maxMetadataStringLength": "1000",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")), "spark.python.sql.dataFrameDebugging.enabled": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df, *order):
    """Rows as tuples, sorted with NULL first."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))

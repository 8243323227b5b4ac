import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidewater.session import build_session, checkpoint_dir
    scratch = tempfile.mkdtemp(prefix="tidewater-tests-")
    s = build_session("local[*]", "tidewater-tests", 8, {
        "spark.sql.warehouse.dir": os.path.join(scratch, "warehouse"),
    })
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="tidewater-run-")


def one_col(spark, values, name="b", dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {dtype}")

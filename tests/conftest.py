import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pulse.session import get_spark
    s = get_spark("local[*]", shuffle_partitions=8, app="pulse-tests",
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="pulse-test-ckpt-"),
                         "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="pulse-test-wh-")})
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="pulse-test-")

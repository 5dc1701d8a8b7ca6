import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.path.join(ROOT, "tests"), os.environ.get("PYTHONPATH", "")])

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from feedspark.session import ensure_checkpoint_dir, get_spark
    s = get_spark("feedspark-tests", cores="*", shuffle_partitions=8)
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF0001

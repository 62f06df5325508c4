import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quern.session import session

    s = session("local[4]", partitions=4, spark__driver__memory="3g", spark__sql__adaptive__coalescePartitions__enabled="true")
    yield s
    s.stop()

import os
import sys
from pathlib import Path

import pytest

# the Python workers import what the tests define
_HERE = Path(__file__).resolve().parent
_FOLDERS = [str(_HERE.parent), str(_HERE), str(_HERE / "llm")]
sys.path[:0] = _FOLDERS
os.environ["PYTHONPATH"] = os.pathsep.join([*_FOLDERS, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from lodestead.session import local_session

    session = local_session(4, 4)
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    yield session
    session.stop()

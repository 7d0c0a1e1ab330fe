import os
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from sentiero.runtime import session

    os.environ.setdefault("TZ", "UTC")
    s = session("tests", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not DATA.exists():
        pytest.skip("no test data here")
    return str(DATA)

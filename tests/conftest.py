import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tributary.session import local_session

    s = local_session(8, "6g")
    s.sparkContext.setLogLevel("ERROR")
    return s


SF = "/root/testdata/sf0.001"

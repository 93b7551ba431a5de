import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lorewell.session import build_session, ship_package  # noqa: E402

SF = os.environ.get("LOREWELL_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("local[4]", "tests", **{"spark__sql__shuffle__partitions": "4", "spark__checkpoint__dir": str(tmp_path_factory.mktemp("shared")), "spark__driver__memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    return s


@pytest.fixture(scope="session")
def sf():
    if not Path(SF).is_dir():
        pytest.skip("no test tables")
    return SF

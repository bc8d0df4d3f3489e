import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from citegrid.session import build_session, ship

    work = tmp_path_factory.mktemp("spark")
    s = build_session(
        "tests",
        "local[4]",
        **{
            "spark__sql__shuffle__partitions": "4",
            "spark__driver__memory": "3g",
            "spark__checkpoint__dir": str(work / "checkpoints"),
            "spark__sql__warehouse__dir": str(work / "warehouse"),
            "spark__cleaner__referenceTracking__cleanCheckpoints": "true",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())

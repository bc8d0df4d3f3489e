import sys

import pytest

from citegrid.llm import queries as q
from oracle import check


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_sql(spark, sf, name):
    check(spark, sf, q.QUERIES[name], q.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_query_runs(spark, sf, name):
    df = q.QUERIES[name](spark, sf)
    assert df.count() > 0


def test_nothing_else_imports_this_folder():
    from pathlib import Path

    root = Path(sys.modules["citegrid"].__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text()

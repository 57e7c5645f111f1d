"""Registered queries against DuckDB, on the smallest data folder."""

import pytest
from oracle import FOLDER, same

from loamline.plans import catalog, pipeline, roundtrip

CASES = {n: (q, s.ORACLE[n]) for s in (catalog, pipeline, roundtrip) for n, q in s.QUERIES.items() if n in s.ORACLE}
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test data here")


@pytest.mark.parametrize("name", CASES)
def test_query(spark, name):
    same(spark, *CASES[name])


def test_registry():
    for source in (catalog, pipeline, roundtrip):
        assert set(source.ORACLE) <= set(source.QUERIES)
        for name, query in source.QUERIES.items():
            assert callable(query) and name == query.__name__

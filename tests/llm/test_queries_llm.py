"""Registered text queries: against DuckDB where SQL can say it, else that they run on the smallest data folder."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import FOLDER, same

from loamline.llm import queries

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test data here")


@pytest.mark.parametrize("name", queries.ORACLE)
def test_against_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE])
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, str(FOLDER)).count() >= 0

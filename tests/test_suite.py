"""Every named query against its oracle SQL in another engine."""

from __future__ import annotations

import math
import os
import re

import pytest

from plumbline import suite

duckdb = pytest.importorskip("duckdb")

SF_DIR = os.environ.get("SUITE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")

# No Python in the plan, and no cross joins.
BANNED = re.compile(r"CartesianProduct|NestedLoopJoin|EvalPython|PythonUDF|InPandas|InArrow")

QUERIES, ORACLES = suite.queries(), suite.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    from plumbline.suite.tables import TABLES

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    yield connection
    connection.close()


def canonical(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    frame = QUERIES[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not BANNED.search(plan)
    assert name in ORACLES
    result = oracle.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    order = sorted(columns)
    got = sorted(tuple(canonical(row[c]) for c in order) for row in frame.collect())
    wanted = sorted(
        tuple(canonical(row[columns.index(c)]) for c in order) for row in result.fetchall()
    )
    assert got == wanted

"""Registered queries against their SQL twins, on the smallest tables."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the generated tables")
TABLES = ("documents", "pages", "conversations", "events")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def ordered(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(float(r[i]) if isinstance(r[i], Decimal) else r[i] for i in order) for r in rows), key=repr)


def test_every_query_has_a_twin():
    assert set(contract.plans.registered()) == set(contract.oracle.statements())


def test_package_reaches_the_executors(spark):
    contract.ship(spark)
    assert any(str(f).endswith("parapet.zip") for f in spark.sparkContext.listFiles)


@pytest.mark.parametrize("name", sorted(contract.plans.registered()))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, str(SF))
    found = con.execute(contract.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    rows = df.collect()
    assert rows and ordered(df.columns, rows) == ordered(names, found.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["screen_chain", "pii_redact_all", "risk_scores", "route_requests", "body_screen"])
def test_narrow_queries_read_only_what_they_need(spark, name):
    plan = contract.queries()[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "hashpartitioning" not in plan  # at most the even redistribution of a single small split

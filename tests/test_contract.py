"""Every registered query runs, agrees with its DuckDB statement, and has a sound plan."""

import re

import pytest
from conftest import SMALL

import __spark_entry__ as contract
from marketlens.registry import EVENT_OPERATORS, OPERATORS
from marketlens.sources.adapter import from_testdata
from tools.check import compare, connect

QUERIES, STATEMENTS = contract.queries(), contract.oracle_sql()

LIMITED = {"journey_patterns"}


def test_names():
    assert set(STATEMENTS) <= set(QUERIES)
    assert len(QUERIES) > 100


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_agrees_with_duckdb(spark, name):
    relation = connect(SMALL).execute(STATEMENTS[name])
    assert compare(QUERIES[name](spark, SMALL), relation) is None


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_plan(spark, name):
    execution = OPERATORS[name](from_testdata(spark, SMALL))._jdf.queryExecution()
    text = execution.executedPlan().toString()
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    # no row-at-a-time Python
    assert "BatchEvalPython" not in text
    # whole tables: no sampling, and a row limit only where it is the operator
    logical = execution.optimizedPlan().toString()
    assert not re.search(r"^[\s:+\-]*Sample ", logical, re.MULTILINE)
    assert name in LIMITED or "GlobalLimit" not in logical


def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert EVENT_OPERATORS

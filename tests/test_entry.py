"""Registered queries against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

# One query per rule is the same plan with another pattern; a few stand for all, and `rule_scan` runs every rule.
SLICES = {"rule_api_006", "rule_swift_001", "rule_ios_002", "rule_config_003"}
ORACLES = entry.oracle_sql()
NAMES = [n for n in ORACLES if n in SLICES or not any(n.startswith(f"rule_{p}_0") for p in
         ("api", "map", "sdk", "db", "auth", "key", "swift", "ios", "config", "android"))]
ROWS_ONLY = sorted(set(entry.queries()) - set(ORACLES))


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_registry():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, connection, name):
    assert differences(entry.queries()[name](spark, SF_DIR), connection, ORACLES[name]) in ([], ["no rows"])


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_has_rows(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0

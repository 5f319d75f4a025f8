"""Registered queries against their SQL at the smallest scale."""

import os

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from sourcesweep.workload.oracle import ORACLES
from sourcesweep.workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
FAST = ["rule_line_findings", "xss_findings", "deps_all", "advisory_dedup", "csrf_forms",
        "csrf_php_state", "smell_long_function", "smell_magic", "secrets_entropy",
        "vuln_report_rows"]


def test_every_query_has_sql():
    """Every query of the scanners; operators that SQL can't express are tested against plain versions."""
    assert set(QUERIES) == set(ORACLES)
    assert set(ORACLES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in check.TABLES:
        con.sql(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    df = queries()[name](spark, SF_DIR)
    rel = con.execute(oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    got = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got and got == check.rows_of(columns, rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_entry(spark):
    assert entry(spark).count() > 0

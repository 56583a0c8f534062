"""Registered queries vs their DuckDB oracle SQL on sf0.01 (the driver's correctness gate)."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry
from lakehealth.sources.tables import TEST_TABLES

KEYS = ["wh_null_values", "wh_duplicates", "wh_fk_orphans", "lk_skew", "footer_chunks", "rule_gzip",
        "lk_nullability", "finding_hierarchy", "remediation", "delta_commit_summary", "discover_tables",
        "inv_lakehouse", "parse_table_path", "flatten_json", "wh_sensitive_values", "wh_settings_compliance",
        "rule_table_sql"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con(sf001):
    c = duckdb.connect()
    for t in TEST_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf001}/{t}.parquet')")
    return c


def test_every_query_has_oracle_or_is_documented():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    optional = {k for k in q if k == "pipeline" or re.match(r"op\d+_", k)}  # tested beside their operators
    assert set(q) - set(o) - optional == {"findings_lakehouse"}


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, sf001, key):
    df = entry.queries()[key](spark, sf001)
    cur = con.execute(entry.oracle_sql()[key])
    a = _rows(df.columns, [tuple(r) for r in df.collect()])
    b = _rows([d[0] for d in cur.description], cur.fetchall())
    assert a == b


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "result" in df.columns and "is_anomaly" in df.columns

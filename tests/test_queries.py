"""Registered queries against their SQL on the smallest tables.

Quick ones by default; BOREWATCH_ALL=1 runs every one (tools/compare.py does the same by hand).
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "drift_alerts", "rolling_z_v1", "detect_v1_statistical", "detect_v2_cold", "scored_readings", "planted_events",
    "classification_report", "calibration_error", "impact_assessment", "escalation_gate", "tool_permissions",
    "maintenance_records", "model_rollback", "dashboard_reasons", "daily_production", "field_statistics", "window_summaries",
    "readings_as_of", "golden_cases", "document_chunks", "guard_scan", "semantic_top_k", "lexical_top_k", "stream_hourly_rollup",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("BOREWATCH_ALL") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sql, name):
    df = entry.queries()[name](spark, FOLDER)
    result = sql.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), columns)


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["event_id", "user_id", "pos"] and df.limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())

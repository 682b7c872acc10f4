"""Table schemas, domain values, and the valid / quarantine split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The telemetry features, in their canonical order.
FEATURES = [
    "oil_rate_bopd",
    "water_cut_pct",
    "gas_oil_ratio",
    "bhp_psi",
    "wh_temp_f",
    "choke_64ths",
]

# Domains of the enumerated columns.
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
RISK_LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
GUARD_SEVERITIES = ["NONE", "LOW", "HIGH", "CRITICAL"]
ESCALATION_STATUSES = ["PENDING", "IN_REVIEW", "RESOLVED", "DISMISSED"]
ESCALATION_REASONS = [
    "LOW_CONFIDENCE",
    "LOW_EVIDENCE_COVERAGE",
    "HIGH_HSE_RISK",
    "MISSING_DATA",
    "INJECTION_DETECTED",
    "OPERATOR_OVERRIDE",
]

_FEATURE_DDL = ", ".join(f"{name} DOUBLE" for name in FEATURES)

TELEMETRY = f"timestamp TIMESTAMP, well_id STRING, field_name STRING, {_FEATURE_DDL}"
TELEMETRY_MESSAGE = f"timestamp STRING, well_id STRING, field_name STRING, {_FEATURE_DDL}"
TELEMETRY_TABLE = TELEMETRY + ", is_injector BOOLEAN, metadata MAP<STRING,STRING>, created_at TIMESTAMP"

ALERT = (
    "alert_id STRING, timestamp TIMESTAMP, well_id STRING, field_name STRING, severity STRING, "
    "anomaly_score DOUBLE, affected_features ARRAY<STRING>, baseline_values MAP<STRING,DOUBLE>, "
    "current_values MAP<STRING,DOUBLE>, deviation_pct MAP<STRING,DOUBLE>, description STRING"
)
ECONOMIC_IMPACT = (
    "STRUCT<revenue_at_risk_usd_per_day: DOUBLE, oil_loss_bopd: DOUBLE, "
    "water_excess_bbl_per_day: DOUBLE, details: STRING>"
)
ADAPTIVE_ALERT = ALERT + (
    ", anomaly_type STRING, cusum_triggered BOOLEAN, step_change_triggered BOOLEAN, "
    f"consecutive_days INT, economic_impact {ECONOMIC_IMPACT}, "
    "per_feature_zscore MAP<STRING,DOUBLE>, per_feature_cusum MAP<STRING,DOUBLE>"
)

DOCUMENT = (
    "document_id STRING, title STRING, doc_type STRING, well_id STRING, field_name STRING, "
    "source_path STRING, total_chunks INT, indexed_at TIMESTAMP, metadata MAP<STRING,STRING>"
)
CHUNK = (
    "document_id STRING, chunk_index INT, content STRING, section STRING, page_number INT, "
    "embedding ARRAY<FLOAT>, token_count INT"
)

CITATION = (
    "STRUCT<document_id: STRING, document_title: STRING, document_type: STRING, section: STRING, "
    "page: INT, relevance_score: DOUBLE, excerpt: STRING>"
)
PLAN_STEP = (
    "STRUCT<step_id: INT, description: STRING, tool_to_use: STRING, expected_output: STRING, "
    "completed: BOOLEAN, result: STRING>"
)
INVESTIGATION = (
    "investigation_id STRING, alert_id STRING, well_id STRING, timestamp TIMESTAMP, "
    "root_cause_hypothesis STRING, supporting_evidence ARRAY<STRING>, recommended_actions ARRAY<STRING>, "
    f"citations ARRAY<{CITATION}>, confidence_score DOUBLE, evidence_coverage DOUBLE, risk_level STRING, "
    "should_escalate BOOLEAN, escalation_reasons ARRAY<STRING>, escalation_message STRING, "
    f"agent_steps ARRAY<{PLAN_STEP}>, total_tokens_used INT, latency_ms DOUBLE, created_at TIMESTAMP"
)
ESCALATION = (
    "escalation_id STRING, investigation_id STRING, well_id STRING, created_at TIMESTAMP, "
    "resolved_at TIMESTAMP, resolved_by STRING, resolution_notes STRING, reasons ARRAY<STRING>, "
    "risk_level STRING, confidence_score DOUBLE, summary STRING, status STRING"
)
AUDIT = (
    "investigation_id STRING, agent_id STRING, step_name STRING, tool_called STRING, input_hash STRING, "
    "output_hash STRING, tokens_used INT, latency_ms DOUBLE, success BOOLEAN, error_message STRING, "
    "timestamp TIMESTAMP"
)
GOLDEN_CASE = (
    "id STRING, category STRING, question STRING, expected_topics ARRAY<STRING>, "
    "ground_truth STRING, document_sources ARRAY<STRING>"
)
MODEL_VERSION = (
    "model_name STRING, version INT, stage STRING, well_id STRING, detector_version STRING, "
    "event_recall DOUBLE, day_fpr DOUBLE, gate_passed BOOLEAN, data_source STRING, created LONG"
)


def fixed_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table of constants that lives in the plan: no Python data source, known size."""
    fields = T.StructType.fromDDL(ddl).fields

    def literal(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, (list, tuple)):
            return f"array({', '.join(literal(v) for v in value)})"
        if isinstance(value, str):
            quoted = value.replace("\\", "\\\\").replace("'", "\\'")
            return f"'{quoted}'"
        return f"{value!r}D" if isinstance(value, float) else str(value)

    values = ", ".join(f"({', '.join(literal(v) for v in row)})" for row in rows)
    names = ", ".join(f.name for f in fields)
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
    return table.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def rank_of(column: Column, ordered: list[str]) -> Column:
    """Position of an enumerated value in its order, for comparisons such as "at least HIGH"."""
    return F.array_position(F.array(*[F.lit(v) for v in ordered]), column)


def alert_rules() -> dict[str, Column]:
    """Domain constraints on alert rows."""
    return {
        "severity": F.col("severity").isin(SEVERITIES),
        "anomaly_score": F.col("anomaly_score").between(0.0, 1.0),
    }


def telemetry_rules() -> dict[str, Column]:
    return {
        "timestamp": F.col("timestamp").isNotNull(),
        "water_cut_pct": F.col("water_cut_pct").between(0.0, 100.0),
        **{f"{name} present": F.col(name).isNotNull() for name in FEATURES},
    }


def escalation_rules() -> dict[str, Column]:
    return {"status": F.col("status").isin(ESCALATION_STATUSES)}


def citation_rules() -> dict[str, Column]:
    return {"relevance_score": F.col("relevance_score").between(0.0, 1.0)}


def with_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add `violations`: the names of the rules a row breaks (null counts as broken)."""
    failed = [F.when(F.coalesce(rule, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*failed)))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine): nothing is dropped, bad rows keep the names of the broken rules."""
    ok = reduce(lambda a, b: a & b, (F.coalesce(r, F.lit(False)) for r in rules.values()))
    return df.filter(ok), with_violations(df.filter(~ok), rules)

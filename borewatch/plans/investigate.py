"""Alerts to evidence packs, investigations and escalations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borewatch.functions import decisions as dec
from borewatch.functions import text as tx
from borewatch.operators import queues, retrieval
from borewatch.operators import windows_of_time as wt
from borewatch.schema import FEATURES


def similar_incidents(alerts: DataFrame, chunks: DataFrame, embed, k: int = 5) -> DataFrame:
    """Per alert the incident citations among the five chunks closest to it."""
    queries = alerts.select(
        F.col("alert_id").alias("query_id"),
        tx.incident_query(F.col("description"), F.col("affected_features")).alias("query"),
    )
    embedded = queries.join(embed(queries, ["query_id"], "query"), "query_id", "left")
    answers = retrieval.answer(queries, retrieval.retrieve(embedded, chunks, k), chunks)
    return retrieval.incident_citations(answers).withColumnRenamed("query_id", "alert_id")


def evidence_packs(
    alerts: DataFrame,
    telemetry: DataFrame,
    order: list[str],
    chunks: DataFrame,
    embed,
    now: Column,
    features: list[str] = FEATURES,
) -> DataFrame:
    """Per alert: telemetry summary, well status, maintenance summary, similar incidents."""
    wells = alerts.select("well_id").distinct()
    summary = wt.summary_text(wt.summarise_before(alerts, telemetry, order, features), ["alert_id"])
    status = wt.well_status(
        wt.latest_reading(telemetry, order, features), wt.recent_alert_counts(alerts, now)
    ).select("well_id", F.col("summary_text").alias("status_text"))
    maintenance = queues.maintenance_summary(queues.maintenance_records(wells, chunks), wells).withColumnRenamed(
        "summary_text", "maintenance_text"
    )
    incidents = similar_incidents(alerts, chunks, embed).select(
        "alert_id", "context", "citations", "incident_citations", "source_coverage", "weak_evidence"
    )
    no_data = F.concat(F.lit("No telemetry data found for well "), F.col("well_id"), F.lit(" in the last 72 hours."))
    return (
        alerts.join(summary, "alert_id", "left")
        .join(status, "well_id", "left")
        .join(maintenance, "well_id", "left")
        .join(incidents, "alert_id", "left")
        .withColumn("summary_text", F.coalesce("summary_text", no_data))
        .withColumn(
            "status_text",
            F.coalesce("status_text", F.concat(F.lit("No telemetry data available for well "), F.col("well_id"), F.lit("."))),
        )
    )


def investigations(packs: DataFrame, now: Column) -> DataFrame:
    """Evidence packs -> investigation rows, decided by rule.

    Confidence and risk may be supplied as columns; by default confidence follows the coverage of
    the evidence and risk the severity of the alert.
    """
    confidence = F.col("confidence_score") if "confidence_score" in packs.columns else F.coalesce("source_coverage", F.lit(0.5))
    risk = F.col("risk_level") if "risk_level" in packs.columns else F.col("severity")
    steps = dec.investigation_plan(F.col("well_id"), F.col("affected_features"), F.col("severity"))
    staged = (
        packs.withColumn("confidence_score", dec.clamp_confidence(confidence, F.lit(0)))
        .withColumn("evidence_coverage", dec.evidence_coverage(F.array(F.col("source_coverage"))))
        .withColumn("risk_level", risk)
        .withColumn("error", F.lit(None).cast("string"))
        .withColumn("step_outputs", F.array("summary_text", "status_text", "maintenance_text"))
    )
    gated = dec.with_escalation(staged)
    return gated.select(
        F.substring(F.sha2(F.concat(F.lit("investigation|"), F.col("alert_id")), 256), 1, 32).alias("investigation_id"),
        "alert_id",
        "well_id",
        "timestamp",
        F.col("description").alias("root_cause_hypothesis"),
        F.array("summary_text", "status_text", "maintenance_text").alias("supporting_evidence"),
        F.array().cast("array<string>").alias("recommended_actions"),
        "citations",
        "confidence_score",
        "evidence_coverage",
        "risk_level",
        "should_escalate",
        "escalation_reasons",
        "escalation_message",
        steps.alias("agent_steps"),
        F.lit(0).alias("total_tokens_used"),
        F.lit(0.0).alias("latency_ms"),
        now.alias("created_at"),
        dec.needs_second_review(F.col("confidence_score"), F.col("risk_level"), F.lit(3)).alias("needs_second_review"),
    )

"""Alert, investigation and escalation tables: queues, lookups, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borewatch.operators.names import names_in_texts
from borewatch.operators.quantiles import exact_quantiles
from borewatch.schema import ESCALATION_STATUSES
from borewatch.session import stored_once
from borewatch.sources.tables import insert_absent

# Upper bounds of the confidence histogram.
CONFIDENCE_BUCKETS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 1.0]


def list_escalations(escalations: DataFrame, status: str = "PENDING", limit: int = 50) -> DataFrame:
    """Newest escalations of a status, or of all."""
    asked = status.upper()
    if asked not in [*ESCALATION_STATUSES, "ALL"]:
        raise ValueError(f"status must be one of {ESCALATION_STATUSES} or ALL, got {status}")
    chosen = escalations if asked == "ALL" else escalations.filter(F.col("status") == asked)
    return chosen.orderBy(F.desc("created_at"), "escalation_id").limit(limit)


def list_investigations(investigations: DataFrame, well: str | None = None, limit: int = 20) -> DataFrame:
    chosen = investigations if well is None else investigations.filter(F.col("well_id") == well)
    return chosen.orderBy(F.desc("created_at"), "investigation_id").limit(limit)


def resolve_escalations(
    escalations: DataFrame, updates: DataFrame, now: Column, newest: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(escalations after the updates, updates that match none).

    `updates` has escalation_id, resolved_by, resolution_notes, new_status (RESOLVED or DISMISSED).  Of several updates
    of one id the one with the largest `newest` counts; without that column, or on a tie, the largest row.
    """
    fresh = updates.select(
        "escalation_id",
        F.col("resolved_by").alias("_by"),
        F.col("resolution_notes").alias("_notes"),
        F.upper("new_status").alias("_status"),
        (F.col(newest) if newest else F.lit(0)).alias("_age"),
    ).filter(F.col("_status").isin("RESOLVED", "DISMISSED"))
    last = F.max(F.struct("_age", "_status", "_by", "_notes")).alias("_last")
    fresh = fresh.groupBy("escalation_id").agg(last).select("escalation_id", "_last._by", "_last._notes", "_last._status")
    hit = F.col("_status").isNotNull()
    merged = (
        escalations.join(fresh, "escalation_id", "left")
        .withColumns(
            {
                "status": F.coalesce("_status", "status"),
                "resolved_by": F.when(hit, F.col("_by")).otherwise(F.col("resolved_by")),
                "resolution_notes": F.when(hit, F.col("_notes")).otherwise(F.col("resolution_notes")),
                "resolved_at": F.when(hit, now).otherwise(F.col("resolved_at")),
            }
        )
        .select(*escalations.columns)
    )
    missing = updates.join(escalations.select("escalation_id"), "escalation_id", "left_anti")
    return merged, missing


def escalation_rows(investigations: DataFrame, now: Column) -> DataFrame:
    """Escalated investigations as queue rows; the id follows from the investigation."""
    summary = F.coalesce(
        "escalation_message",
        F.concat(
            F.lit("Investigation escalated for "), F.col("well_id"), F.lit(": "),
            F.substring("root_cause_hypothesis", 1, 200),
        ),
    )
    return investigations.filter("should_escalate").select(
        F.substring(F.sha2(F.concat(F.lit("escalation|"), F.col("investigation_id")), 256), 1, 32).alias("escalation_id"),
        "investigation_id",
        "well_id",
        now.alias("created_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        F.lit(None).cast("string").alias("resolved_by"),
        F.lit(None).cast("string").alias("resolution_notes"),
        F.col("escalation_reasons").alias("reasons"),
        "risk_level",
        "confidence_score",
        summary.alias("summary"),
        F.lit("PENDING").alias("status"),
    )


def new_escalations(existing: DataFrame, investigations: DataFrame, now: Column) -> DataFrame:
    return insert_absent(existing, escalation_rows(investigations, now), ["escalation_id"])


def maintenance_records(wells: DataFrame, chunks: DataFrame, newest: int = 5) -> DataFrame:
    """Per well its newest maintenance chunks: filed under the well, or naming it.

    The two conditions are two joins: an equi-join on the well, and the names that the texts hold
    (`names_in_texts`).  Both are exact, so no well meets a text that does not name it.  Only the
    newest few per well leave a task.  The chunks, which are read four times, are worked out once.
    """
    logs = chunks.filter(F.col("doc_type") == "Maintenance Log").select(
        "document_id", "chunk_index", "title", "doc_type", "content", "indexed_at", F.col("well_id").alias("_filed")
    )
    logs = stored_once(logs)
    key = ["document_id", "chunk_index"]
    filed = wells.select("well_id").join(logs, F.col("well_id") == F.col("_filed"))
    named = names_in_texts(wells, logs, "well_id", key, "content").join(logs, key)
    both = filed.unionByName(named.select(*filed.columns)).dropDuplicates(["well_id", *key])
    order = Window.partitionBy("well_id").orderBy(F.desc("indexed_at"), *key)
    return (
        both.withColumn("record_no", F.row_number().over(order))
        .filter(F.col("record_no") <= newest)
        .select("well_id", "record_no", *key, "title", "doc_type", F.substring("content", 1, 200).alias("excerpt"))
    )


def maintenance_summary(records: DataFrame, wells: DataFrame) -> DataFrame:
    """One sentence per well, also for wells without records."""
    # At most `newest` records per well.
    grouped = records.groupBy("well_id").agg(
        F.array_sort(F.collect_list(F.struct("record_no", F.substring("title", 1, 60).alias("t")))).alias("_r")
    )
    text = F.when(
        F.col("_r").isNull(), F.concat(F.lit("No maintenance records found for well "), F.col("well_id"), F.lit("."))
    ).otherwise(
        F.concat(
            F.lit("Found "), F.size("_r").cast("string"), F.lit(" maintenance records for "), F.col("well_id"), F.lit(": "),
            F.array_join(F.transform(F.slice("_r", 1, 3), lambda s: s["t"]), "; "),
        )
    )
    return wells.select("well_id").join(grouped, "well_id", "left").select("well_id", text.alias("summary_text"))


# ── Dashboards (A25) ──


def alerts_by_severity(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("alerts"))


def escalations_by_reason(escalations: DataFrame) -> DataFrame:
    return (
        escalations.select(F.explode("reasons").alias("reason"), "risk_level")
        .groupBy("reason", "risk_level")
        .agg(F.count(F.lit(1)).alias("escalations"))
    )


def per_hour(events: DataFrame, ts: str, out: str = "n") -> DataFrame:
    return (
        events.groupBy(F.window(ts, "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias(out))
        .select(F.col("w.start").alias("hour"), out)
    )


def token_rate(steps: DataFrame, ts: str, minutes: int = 5) -> DataFrame:
    """Tokens per minute by agent in windows of some minutes."""
    return (
        steps.groupBy(F.window(ts, f"{minutes} minutes").alias("w"), "agent_id")
        .agg((F.sum("tokens_used") / minutes).alias("tokens_per_minute"))
        .select(F.col("w.start").alias("window_start"), "agent_id", "tokens_per_minute")
    )


def latency_quantiles(steps: DataFrame, latency: str, keys: list[str], exact: bool = False) -> DataFrame:
    """p50, p95, p99; approximate with a bounded sketch unless `exact`, which scans the rows a few times."""
    q, names = [0.5, 0.95, 0.99], ["p50", "p95", "p99"]
    if exact:
        return exact_quantiles(steps, latency, keys, q, names)
    value = F.percentile_approx(latency, q, 10_000)
    return steps.groupBy(*keys).agg(value.alias("_q")).select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def confidence_histogram(df: DataFrame, confidence: str, keys: list[str]) -> DataFrame:
    """Cumulative counts at fixed upper bounds, per key."""
    counts = [F.count_if(F.col(confidence) <= b).alias(f"_b{i}") for i, b in enumerate(CONFIDENCE_BUCKETS)]
    wide = df.groupBy(*keys).agg(*counts)
    bounds = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(CONFIDENCE_BUCKETS)])
    return wide.select(*keys, F.explode(bounds).alias("_s")).select(*keys, "_s.*")

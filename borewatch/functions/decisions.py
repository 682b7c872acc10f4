"""Decision rules over investigation columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borewatch.functions.fixed import AGENT_TOOLS, APPROVAL_TOOLS, BLOCKED_TOOLS, PLAN_STEPS
from borewatch.functions.text import short_hash

# Thresholds of the gate.
MIN_CONFIDENCE = 0.75
MIN_COVERAGE = 0.60
REVIEW_CONFIDENCE = 0.80

# Promotion gate.
GATE_RECALL = 0.85
GATE_FPR = 0.20
DAILY_GATE_RECALL = 0.60

MODEL_PREFIX = "well-anomaly-detector"


def percent(column: Column, digits: int = 0) -> Column:
    value = column * 100
    return F.format_string(f"%.{digits}f%%", F.rint(value) if digits == 0 else value)


def escalation_reasons(
    confidence: Column, coverage: Column, risk: Column, error: Column, step_outputs: Column
) -> Column:
    """Distinct reasons to escalate, in rule order; empty means none."""
    failed = F.coalesce(error, F.lit("")) != ""
    missing = F.exists(
        F.transform(step_outputs, lambda s: F.lower(F.coalesce(s, F.lit("")))),
        lambda s: s.contains("no data") | s.contains("not found"),
    )
    return F.array_distinct(
        F.array_compact(
            F.array(
                F.when(failed, F.lit("LOW_CONFIDENCE")),
                F.when(failed, F.lit("MISSING_DATA")),
                F.when(risk.isin("HIGH", "CRITICAL"), F.lit("HIGH_HSE_RISK")),
                F.when(confidence < MIN_CONFIDENCE, F.lit("LOW_CONFIDENCE")),
                F.when(coverage < MIN_COVERAGE, F.lit("LOW_EVIDENCE_COVERAGE")),
                F.when(F.coalesce(missing, F.lit(False)), F.lit("MISSING_DATA")),
            )
        )
    )


def escalation_message(well: Column, reasons: Column, confidence: Column, coverage: Column, risk: Column) -> Column:
    """Text for the reviewer, null where nothing is escalated."""

    def words(reason: Column) -> Column:
        return (
            F.when(
                reason == "LOW_CONFIDENCE",
                F.concat(F.lit("AI confidence "), percent(confidence), F.lit(f" is below threshold {MIN_CONFIDENCE:.0%}")),
            )
            .when(
                reason == "LOW_EVIDENCE_COVERAGE",
                F.concat(F.lit("Evidence coverage "), percent(coverage), F.lit(f" is below threshold {MIN_COVERAGE:.0%}")),
            )
            .when(
                reason == "HIGH_HSE_RISK",
                F.concat(F.lit("Risk level "), risk, F.lit(" requires human review per HSE-OPS-001")),
            )
            .when(reason == "MISSING_DATA", F.lit("Insufficient telemetry or document data available"))
            .when(reason == "INJECTION_DETECTED", F.lit("Potential prompt injection detected in retrieved content"))
            .when(reason == "OPERATOR_OVERRIDE", F.lit("Operator manually requested human review"))
            .otherwise(reason)
        )

    summary = F.array_join(F.transform(reasons, words), "; ")
    return F.when(
        F.size(reasons) > 0,
        F.concat(
            F.lit("Investigation for well "), well, F.lit(" requires human review. Reasons: "), summary,
            F.lit(". Per HSE-OPS-001, an engineer must review before any operational changes."),
        ),
    )


def with_escalation(df: DataFrame) -> DataFrame:
    """Add should_escalate, escalation_reasons, escalation_message.

    Needs well_id, confidence_score, evidence_coverage, risk_level, error, step_outputs.
    """
    conf, cover, risk = F.col("confidence_score"), F.col("evidence_coverage"), F.col("risk_level")
    reasons = escalation_reasons(conf, cover, risk, F.col("error"), F.col("step_outputs"))
    return (
        df.withColumn("escalation_reasons", reasons)
        .withColumn("should_escalate", F.size("escalation_reasons") > 0)
        .withColumn(
            "escalation_message", escalation_message(F.col("well_id"), F.col("escalation_reasons"), conf, cover, risk)
        )
    )


def clamp_confidence(confidence: Column, gaps: Column) -> Column:
    """Into 0..1; 0.15 lower, but at least 0.1, with three or more logical gaps."""
    inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))
    return F.when(gaps >= 3, F.greatest(F.lit(0.1), inside - 0.15)).otherwise(inside)


def needs_second_review(confidence: Column, risk: Column, evidence: Column) -> Column:
    return risk.isin("HIGH", "CRITICAL") | (confidence < REVIEW_CONFIDENCE) | (evidence < 2)


def evidence_coverage(coverages: Column) -> Column:
    """Mean of the step coverages that exist, 0.5 without any."""
    known = F.array_compact(coverages)
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.try_divide(total, F.size(known).cast("double")), F.lit(0.5))


def investigation_plan(well: Column, features: Column, severity: Column) -> Column:
    """Rule-based plan: three steps, four for HIGH and CRITICAL."""
    names = [well, well, F.array_join(features, ", "), F.lit("")]

    def step(i: int) -> Column:
        text, tool, expected = PLAN_STEPS[i]
        description = F.replace(F.lit(text), F.lit("%s"), names[i])
        return F.struct(
            F.lit(i + 1).alias("step_id"),
            description.alias("description"),
            F.lit(tool).alias("tool_to_use"),
            F.lit(expected).alias("expected_output"),
            F.lit(False).alias("completed"),
            F.lit(None).cast("string").alias("result"),
        )

    base = F.array(*[step(i) for i in range(3)])
    return F.when(severity.isin("HIGH", "CRITICAL"), F.concat(base, F.array(step(3)))).otherwise(base)


def plan_quality(tools: Column, first: Column, required: Column, least: Column, most: Column) -> Column:
    """0.4 for the first tool, 0.4 for all required tools, 0.2 for the number of steps."""
    first_right = F.coalesce(F.get(tools, 0) == first, F.lit(False))
    covered = F.size(F.array_except(required, tools)) == 0
    in_range = F.size(tools).between(least, most)
    return F.struct(
        first_right.alias("first_tool_correct"),
        covered.alias("required_tools_covered"),
        in_range.alias("step_count_in_range"),
        (first_right.cast("int") * 0.4 + covered.cast("int") * 0.4 + in_range.cast("int") * 0.2).alias("score"),
    )


def tool_verdict(agent: Column, tool: Column) -> Column:
    """(is_permitted, reason, requires_approval) of a planned tool call.

    Blocked beats not permitted beats approval, in that order.  No agent may call a tool that
    needs approval, so that outcome shows only in `requires_approval`.
    """
    permitted = F.lit(None).cast("array<string>")
    for name, tools in AGENT_TOOLS.items():
        listed = F.array(*[F.lit(t) for t in sorted(tools)]).cast("array<string>")
        permitted = F.when(agent == name, listed).otherwise(permitted)
    permitted = F.coalesce(permitted, F.array().cast("array<string>"))
    blocked, approval = tool.isin(BLOCKED_TOOLS), tool.isin(APPROVAL_TOOLS)
    allowed = F.array_contains(permitted, tool)
    listing = F.concat(
        F.lit("["), F.array_join(F.transform(permitted, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]")
    )
    reason = (
        F.when(blocked, F.concat(F.lit("Tool '"), tool, F.lit("' is in the global blocked list")))
        .when(
            ~allowed,
            F.concat(
                F.lit("Agent '"), agent, F.lit("' is not permitted to call '"), tool, F.lit("'. Permitted: "), listing
            ),
        )
        .when(approval, F.concat(F.lit("Tool '"), tool, F.lit("' requires explicit human approval")))
        .otherwise("permitted")
    )
    return F.struct(
        (~blocked & allowed & ~approval).alias("is_permitted"), reason.alias("reason"), approval.alias("requires_approval")
    )


def meets_gate(recall: Column, fpr: Column, granularity: Column) -> Column:
    """Recall and false-positive rate suffice; daily data needs less recall."""
    return F.when(granularity == "daily", recall >= DAILY_GATE_RECALL).otherwise(
        (recall >= GATE_RECALL) & (fpr <= GATE_FPR)
    )


def promotion_justification(recall: Column, fpr: Column, granularity: Column) -> Column:
    r, f = F.format_string("%.2f", recall), F.format_string("%.2f", fpr)
    daily = F.concat(
        F.lit("Promoted with daily-data override: event_recall="), r,
        F.lit(f" (≥{DAILY_GATE_RECALL:.2f}). Full production metrics require sub-daily SCADA data "
              "(projected recall>95%, FPR<5%)."),
    )
    full = F.concat(
        F.lit("Meets production gate: event_recall="), r, F.lit(f" (≥{GATE_RECALL:.2f}), day_fpr="), f,
        F.lit(f" (≤{GATE_FPR:.2f})."),
    )
    failed = F.concat(
        F.lit("Quality gate FAILED: event_recall="), r, F.lit(f" (need ≥{GATE_RECALL:.2f}), day_fpr="), f,
        F.lit(f" (need ≤{GATE_FPR:.2f}). Registered in Staging only."),
    )
    passed = meets_gate(recall, fpr, granularity)
    return F.when(passed & (granularity == "daily"), daily).when(passed, full).otherwise(failed)


def model_name(well: Column, prefix: str = MODEL_PREFIX) -> Column:
    return F.concat(F.lit(prefix + "-"), F.translate(well, "/ ", "__"))


def evaluation_gates(plan: Column, recall: Column, ece: Column, faithfulness: Column) -> Column:
    """Whether evaluation results are good enough to release."""
    return F.struct(
        (plan >= 0.70).alias("plan_ok"),
        (recall >= 0.85).alias("recall_ok"),
        (ece <= 0.15).alias("ece_ok"),
        (faithfulness >= 0.80).alias("faithfulness_ok"),
        ((plan >= 0.70) & (recall >= 0.85) & (ece <= 0.15)).alias("thresholds_met"),
    )


def audit_record(df: DataFrame, input_text: str, output_text: str) -> DataFrame:
    """Agent steps -> audit rows that keep hashes instead of texts."""
    return df.select(
        "investigation_id",
        "agent_id",
        "step_name",
        "tool_called",
        short_hash(F.col(input_text)).alias("input_hash"),
        short_hash(F.col(output_text)).alias("output_hash"),
        "tokens_used",
        "latency_ms",
        "success",
        "error_message",
    )

"""Impact, decision rules, queues, lookups and dashboards over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borewatch.functions import decisions as dec
from borewatch.functions import economics
from borewatch.functions.fixed import APPROVAL_TOOLS, BLOCKED_TOOLS
from borewatch.operators import catalog, detect, queues
from borewatch.plans.catalogue import query
from borewatch.plans.registered.detection import v2_series
from borewatch.plans.roles import CORPUS_SQL, PROMPTS_SQL, corpus, prompts, table
from borewatch.sources.documents import as_chunks, as_documents


# ── Impact: each order is an alert whose current and baseline values follow from its columns ──

_TYPES = "['water_breakthrough', 'gor_spike', 'bhp_depletion', 'oil_rate_collapse', 'multi_feature_correlated']"
IMPACT_SQL = f"""alerts AS (
  SELECT o_orderkey, {_TYPES}[CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 1 WHEN '5-LOW' THEN 2 ELSE 5 END] AS kind,
    o_totalprice / 100 AS oil_base, o_totalprice / 100 * (1 - (o_custkey % 97) / 100.0::DOUBLE) AS oil_now, CAST(o_custkey % 60 AS DOUBLE) AS wc_base,
    CAST(o_custkey % 60 + o_orderkey % 31 AS DOUBLE) AS wc_now, CAST(1500 + o_orderkey % 1700 AS DOUBLE) AS bhp_base,
    (1500 + o_orderkey % 1700) * (1 - (o_custkey % 41) / 100.0::DOUBLE) AS bhp_now, CAST(1 + o_orderkey % 9 AS INTEGER) AS days FROM orders),
loss AS (SELECT *, greatest(0.0, oil_base - oil_now) AS lost, greatest(0.0, wc_now - wc_base) / 100 * (oil_base / greatest(0.01, 1 - wc_base / 100)) AS water FROM alerts),
total AS (SELECT *, lost < 5 AND kind <> 'oil_rate_collapse' AS indirect, lost * 80 + water * 4.5 AS direct FROM loss),
priced AS (SELECT *, CASE WHEN indirect THEN greatest(direct, oil_base * 80 * 0.15) ELSE direct END AS daily FROM total),
decl AS (SELECT *, greatest(0.0, (bhp_base - bhp_now) / bhp_base * 100) AS bd, greatest(0.0, (oil_base - oil_now) / greatest(1, oil_base) * 100) AS od FROM priced),
deg AS (SELECT *, greatest(bd, od * 0.7) AS degradation, kind IN ('bhp_depletion', 'oil_rate_collapse') AND (bd >= 5 OR od >= 10) AS has_rul FROM decl),
rul AS (SELECT *, CASE WHEN has_rul THEN CAST(least(floor(greatest(0.0, 35.0 - degradation) / greatest(0.1, degradation / greatest(1, days))), 365) AS INTEGER) END AS rul FROM deg)"""


def impact_alerts(spark: SparkSession, folder: str) -> DataFrame:
    kinds = {"1-URGENT": "oil_rate_collapse", "2-HIGH": "bhp_depletion", "3-MEDIUM": "water_breakthrough", "5-LOW": "gor_spike"}
    kind = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in kinds.items()], F.lit("multi_feature_correlated"))
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    oil, bhp = F.col("o_totalprice") / 100, (key % 1700 + 1500).cast("double")

    def values(oil_rate, cut, pressure):
        return F.create_map(F.lit("oil_rate_bopd"), oil_rate, F.lit("water_cut_pct"), cut, F.lit("bhp_psi"), pressure)

    return table(spark, folder, "orders").select(
        "o_orderkey",
        kind.alias("anomaly_type"),
        values(
            oil * (1 - (cust % 97) / F.lit(100.0)), (cust % 60 + key % 31).cast("double"),
            bhp * (1 - (cust % 41) / F.lit(100.0)),
        ).alias("current_values"),
        values(oil, (cust % 60).cast("double"), bhp).alias("baseline_values"),
        (key % 9 + 1).cast("int").alias("consecutive_days"),
    )


@query(
    "impact_assessment",
    f"""WITH {IMPACT_SQL}
SELECT o_orderkey, kind AS anomaly_type, round_even(lost * 10, 0) / 10 AS oil_loss, round_even(lost * 80 * 100, 0) / 100 AS revenue, round_even(water * 4.5 * 100, 0) / 100 AS water_cost,
  round_even(daily * 100, 0) / 100 AS daily, round_even(daily * 30 * 100, 0) / 100 AS month, round_even(daily * 90 * 100, 0) / 100 AS quarter, rul,
  CASE WHEN has_rul THEN CASE WHEN days >= 7 THEN 'HIGH' WHEN days >= 3 THEN 'MEDIUM' ELSE 'LOW' END END AS rul_confidence,
  CASE kind WHEN 'oil_rate_collapse' THEN 'IMMEDIATE' WHEN 'bhp_depletion' THEN CASE WHEN coalesce(rul < 30, false) THEN 'URGENT' ELSE 'PLANNED' END
       WHEN 'gor_spike' THEN 'PLANNED' ELSE 'URGENT' END AS urgency,
  CASE WHEN kind = 'bhp_depletion' AND has_rul THEN CASE WHEN rul < 60 THEN 3500000.0 ELSE 1050000.0 END WHEN kind = 'oil_rate_collapse' THEN 50000.0 ELSE 20000.0 END::DOUBLE AS cost,
  round_even(CASE WHEN daily > 0 THEN CASE WHEN kind = 'bhp_depletion' AND has_rul THEN CASE WHEN rul < 60 THEN 3500000.0 ELSE 1050000.0 END WHEN kind = 'oil_rate_collapse' THEN 50000.0 ELSE 20000.0 END::DOUBLE
       / greatest(1.0, round_even(daily * 100, 0) / 100) ELSE 999.0 END * 10, 0) / 10 AS roi_days, round(least(0.95, 0.4 + days * 0.08)::DOUBLE, 6) AS confidence FROM rul""",
)
def impact_assessment(spark: SparkSession, folder: str) -> DataFrame:
    assessed = economics.assess_impact(impact_alerts(spark, folder), today=F.to_date(F.lit("2024-01-01")))
    loss, life, advice = F.col("production_loss"), F.col("esp_rul"), F.col("recommendation")
    return assessed.select(
        "o_orderkey", "anomaly_type", loss["daily_oil_loss_bopd"].alias("oil_loss"), loss["daily_revenue_usd"].alias("revenue"),
        loss["daily_water_cost_uplift_usd"].alias("water_cost"), loss["total_daily_impact_usd"].alias("daily"),
        loss["cumulative_30day_usd"].alias("month"), loss["cumulative_90day_usd"].alias("quarter"),
        life["estimated_rul_days"].alias("rul"), life["confidence"].alias("rul_confidence"), advice["urgency"].alias("urgency"),
        advice["estimated_cost_usd"].alias("cost"), advice["roi_days"].alias("roi_days"),
        F.round(advice["confidence"], 6).alias("confidence"),
    )


@query(
    "impact_texts",
    f"""WITH {IMPACT_SQL}
SELECT o_orderkey, CASE WHEN indirect THEN 'Indirect cost estimate: 15% of baseline revenue ($' || printf('%.0f', round_even(oil_base, 0)) || ' BOPD × $80/bbl × 15% OPEX uplift)'
  ELSE 'Oil rate decline: ' || printf('%.0f', round_even(lost, 0)) || ' BOPD × $80/bbl = $' || format('{{:,.0f}}', round_even(lost * 80, 0)) || '/day'
    || CASE WHEN water > 0 THEN '; water handling uplift: ' || printf('%.0f', round_even(water, 0)) || ' bbl/day × $4.50/bbl = $' || format('{{:,.0f}}', round_even(water * 4.5, 0)) || '/day' ELSE '' END END AS basis,
  CASE WHEN has_rul THEN strftime(DATE '2024-01-01' + rul, '%Y-%m-%d') END AS deadline,
  CASE kind WHEN 'bhp_depletion' THEN '   BHP ' || printf('%.0f', round_even(bhp_base, 0)) || ' → ' || printf('%.0f', round_even(bhp_now, 0)) || ' psi'
            WHEN 'oil_rate_collapse' THEN '   Oil rate ' || printf('%.0f', round_even(oil_base, 0)) || ' → ' || printf('%.0f', round_even(oil_now, 0)) || ' BOPD'
            WHEN 'gor_spike' THEN '   GOR 0 → 0 scf/bbl' END AS chain_numbers,
  CASE kind WHEN 'multi_feature_correlated' THEN 4 WHEN 'water_breakthrough' THEN 5 ELSE 6 END AS chain_lines,
  CASE kind WHEN 'multi_feature_correlated' THEN 1 ELSE 3 END AS incidents FROM rul""",
)
def impact_texts(spark: SparkSession, folder: str) -> DataFrame:
    assessed = economics.assess_impact(impact_alerts(spark, folder), today=F.to_date(F.lit("2024-01-01")))
    numbered = F.col("anomaly_type").isin("bhp_depletion", "oil_rate_collapse", "gor_spike")
    return assessed.select(
        "o_orderkey", F.col("production_loss.basis").alias("basis"), F.col("esp_rul.intervention_deadline").alias("deadline"),
        F.when(numbered, F.col("causal_chain")[1]).alias("chain_numbers"), F.size("causal_chain").alias("chain_lines"),
        F.size("comparable_incidents").alias("incidents"),
    )


@query("alert_impact")
def alert_impact(spark: SparkSession, folder: str) -> DataFrame:
    """Version 2 alerts of every well, priced; the rules are covered by the two queries above."""
    alerts = detect.alerts_v2(detect.fold_series_v2(v2_series(spark, folder, 32)))
    assessed = economics.assess_impact(alerts)
    return assessed.select(
        "well_id", "ordinal", "anomaly_type", "production_loss.total_daily_impact_usd", "recommendation.urgency",
        "recommendation.roi_days",
    )


# ── Gate: each order is an investigation ──

GATE_SQL = """inv AS (
  SELECT o_orderkey, 'W-' || o_custkey AS well_id, (o_custkey % 101) / 100.0::DOUBLE AS confidence, (o_orderkey % 101) / 100.0::DOUBLE AS coverage,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS risk,
    CASE WHEN o_orderstatus = 'P' THEN 'timeout' END AS error, o_orderkey % 13 = 0 AS missing, CAST(o_orderkey % 5 AS INTEGER) AS gaps FROM orders)"""


def gate_cases(spark: SparkSession, folder: str) -> DataFrame:
    risk = F.coalesce(
        *[F.when(F.col("o_orderpriority") == p, r) for p, r in (("1-URGENT", "CRITICAL"), ("2-HIGH", "HIGH"), ("3-MEDIUM", "MEDIUM"))],
        F.lit("LOW"),
    )
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.concat(F.lit("W-"), "o_custkey").alias("well_id"),
        ((F.col("o_custkey") % 101) / F.lit(100.0)).alias("confidence_score"),
        ((F.col("o_orderkey") % 101) / F.lit(100.0)).alias("evidence_coverage"),
        risk.alias("risk_level"),
        F.when(F.col("o_orderstatus") == "P", "timeout").alias("error"),
        F.when(F.col("o_orderkey") % 13 == 0, F.array(F.lit("Fine"), F.lit("Well Not Found")))
        .otherwise(F.array(F.lit("Fine"))).alias("step_outputs"),
        (F.col("o_orderkey") % 5).cast("int").alias("gaps"),
        "o_orderdate",
    )


_REASON_SQL = """concat_ws(',', CASE WHEN error IS NOT NULL THEN 'LOW_CONFIDENCE' END, CASE WHEN error IS NOT NULL THEN 'MISSING_DATA' END,
  CASE WHEN risk IN ('HIGH', 'CRITICAL') THEN 'HIGH_HSE_RISK' END, CASE WHEN error IS NULL AND confidence < 0.75 THEN 'LOW_CONFIDENCE' END,
  CASE WHEN coverage < 0.6 THEN 'LOW_EVIDENCE_COVERAGE' END, CASE WHEN error IS NULL AND missing THEN 'MISSING_DATA' END)"""
_MESSAGE_SQL = """CASE WHEN reasons <> '' THEN 'Investigation for well ' || well_id || ' requires human review. Reasons: ' || array_to_string(list_transform(string_split(reasons, ','), lambda r:
  CASE r WHEN 'LOW_CONFIDENCE' THEN 'AI confidence ' || printf('%.0f%%', round_even(confidence * 100, 0)) || ' is below threshold 75%'
    WHEN 'LOW_EVIDENCE_COVERAGE' THEN 'Evidence coverage ' || printf('%.0f%%', round_even(coverage * 100, 0)) || ' is below threshold 60%'
    WHEN 'HIGH_HSE_RISK' THEN 'Risk level ' || risk || ' requires human review per HSE-OPS-001' ELSE 'Insufficient telemetry or document data available' END), '; ')
  || '. Per HSE-OPS-001, an engineer must review before any operational changes.' END"""


@query(
    "escalation_gate",
    f"""WITH {GATE_SQL}, g AS (SELECT *, {_REASON_SQL} AS reasons FROM inv)
SELECT o_orderkey, reasons <> '' AS should_escalate, reasons AS escalation_reasons, {_MESSAGE_SQL} AS escalation_message FROM g""",
)
def escalation_gate(spark: SparkSession, folder: str) -> DataFrame:
    return dec.with_escalation(gate_cases(spark, folder)).select(
        "o_orderkey", "should_escalate", F.array_join("escalation_reasons", ",").alias("escalation_reasons"), "escalation_message"
    )


@query(
    "review_rules",
    f"""WITH {GATE_SQL}
SELECT o_orderkey, round(CASE WHEN gaps >= 3 THEN greatest(0.1, confidence - 0.15) ELSE confidence END, 6) AS clamped,
  risk IN ('HIGH', 'CRITICAL') OR confidence < 0.8 OR gaps < 2 AS second_review,
  round(CASE WHEN missing THEN 0.5 ELSE (coverage + confidence) / 2 END, 6) AS evidence_coverage FROM inv""",
)
def review_rules(spark: SparkSession, folder: str) -> DataFrame:
    none = F.array(F.lit(None).cast("double"))
    coverages = F.when(F.col("o_orderkey") % 13 == 0, none).otherwise(F.array("evidence_coverage", "confidence_score"))
    return gate_cases(spark, folder).select(
        "o_orderkey",
        F.round(dec.clamp_confidence(F.col("confidence_score"), F.col("gaps")), 6).alias("clamped"),
        dec.needs_second_review(F.col("confidence_score"), F.col("risk_level"), F.col("gaps")).alias("second_review"),
        F.round(dec.evidence_coverage(coverages), 6).alias("evidence_coverage"),
    )


@query(
    "investigation_plans",
    f"""WITH {GATE_SQL}
SELECT o_orderkey, CASE WHEN risk IN ('HIGH', 'CRITICAL') THEN 4 ELSE 3 END AS steps,
  'query_timeseries,retrieve_documents,query_similar_incidents' || CASE WHEN risk IN ('HIGH', 'CRITICAL') THEN ',retrieve_documents' ELSE '' END AS tools,
  'Query 72-hour telemetry history for ' || well_id || ' to confirm anomaly trend' AS first_step, 'Search for similar bhp_psi, choke_64ths anomalies in historical incidents' AS third_step,
  round((0.4 + 0.4 + CASE WHEN risk IN ('HIGH', 'CRITICAL') THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS plan_score FROM inv""",
)
def investigation_plans(spark: SparkSession, folder: str) -> DataFrame:
    steps = dec.investigation_plan(F.col("well_id"), F.array(F.lit("bhp_psi"), F.lit("choke_64ths")), F.col("risk_level"))
    tools = F.transform("plan", lambda s: s["tool_to_use"])
    required = F.array(F.lit("query_timeseries"), F.lit("retrieve_documents"))
    quality = dec.plan_quality(tools, F.lit("query_timeseries"), required, F.lit(4), F.lit(5))
    return gate_cases(spark, folder).withColumn("plan", steps).select(
        "o_orderkey", F.size("plan").alias("steps"), F.array_join(tools, ",").alias("tools"),
        F.col("plan")[0]["description"].alias("first_step"), F.col("plan")[2]["description"].alias("third_step"),
        F.round(quality["score"], 6).alias("plan_score"),
    )


_TOOLS = ["query_timeseries", "retrieve_documents", "create_escalation", "modify_choke", "execute_shell", "notify_engineer"]
_AGENTS = ["planner", "executor", "critic", "escalation", "stranger"]


@query(
    "tool_permissions",
    f"""WITH c AS (SELECT event_id, [{", ".join(f"'{a}'" for a in _AGENTS)}][event_id % 5 + 1] AS agent, [{", ".join(f"'{t}'" for t in _TOOLS)}][user_id % 6 + 1] AS tool FROM events),
p AS (SELECT *, CASE agent WHEN 'executor' THEN ['get_equipment_status', 'get_well_metadata', 'query_similar_incidents', 'query_timeseries', 'retrieve_documents']
      WHEN 'escalation' THEN ['create_escalation', 'notify_engineer'] ELSE []::VARCHAR[] END AS permitted,
      tool IN ({", ".join(f"'{t}'" for t in BLOCKED_TOOLS)}) AS blocked, tool IN ({", ".join(f"'{t}'" for t in APPROVAL_TOOLS)}) AS requires_approval FROM c)
SELECT event_id, NOT blocked AND list_contains(permitted, tool) AND NOT requires_approval AS is_permitted, requires_approval,
  CASE WHEN blocked THEN 'Tool ''' || tool || ''' is in the global blocked list' WHEN NOT list_contains(permitted, tool)
    THEN 'Agent ''' || agent || ''' is not permitted to call ''' || tool || '''. Permitted: [' || array_to_string(list_transform(permitted, lambda t: '''' || t || ''''), ', ') || ']'
    ELSE 'permitted' END AS reason FROM p""",
)
def tool_permissions(spark: SparkSession, folder: str) -> DataFrame:
    agents, tools = F.array(*[F.lit(a) for a in _AGENTS]), F.array(*[F.lit(t) for t in _TOOLS])
    verdict = dec.tool_verdict(F.col("agent"), F.col("tool"))
    calls = table(spark, folder, "events").select(
        "event_id", agents[(F.col("event_id") % 5).cast("int")].alias("agent"), tools[(F.col("user_id") % 6).cast("int")].alias("tool")
    )
    return calls.withColumn("v", verdict).select("event_id", "v.is_permitted", "v.requires_approval", "v.reason")


@query(
    "audit_records",
    f"""WITH {PROMPTS_SQL}
SELECT CAST(conv_id AS VARCHAR) AS investigation_id, role AS agent_id, substr(sha256(text), 1, 16) AS input_hash, substr(sha256(upper(role)), 1, 16) AS output_hash, CAST(turn AS INTEGER) AS tokens_used FROM prompts""",
)
def audit_records(spark: SparkSession, folder: str) -> DataFrame:
    steps = prompts(spark, folder).select(
        F.col("conv_id").cast("string").alias("investigation_id"), F.col("role").alias("agent_id"), F.lit("turn").alias("step_name"),
        F.lit(None).cast("string").alias("tool_called"), "text", F.upper("role").alias("answer"),
        F.col("turn").cast("int").alias("tokens_used"), F.lit(0.0).alias("latency_ms"), F.lit(True).alias("success"),
        F.lit(None).cast("string").alias("error_message"),
    )
    return dec.audit_record(steps, "text", "answer").select(
        "investigation_id", "agent_id", "input_hash", "output_hash", "tokens_used"
    )


# ── Queues ──

QUEUE_SQL = """queue AS (SELECT 'E-' || o_orderkey AS escalation_id, o_orderdate AS created_at,
  ['PENDING', 'IN_REVIEW', 'RESOLVED', 'DISMISSED'][o_orderkey % 4 + 1] AS status FROM orders)"""


def queue(spark: SparkSession, folder: str) -> DataFrame:
    states = F.array(*[F.lit(s) for s in ("PENDING", "IN_REVIEW", "RESOLVED", "DISMISSED")])
    return table(spark, folder, "orders").select(
        F.concat(F.lit("E-"), "o_orderkey").alias("escalation_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        states[(F.col("o_orderkey") % 4).cast("int")].alias("status"),
        F.lit(None).cast("string").alias("resolved_by"),
        F.lit(None).cast("string").alias("resolution_notes"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )


@query(
    "pending_escalations",
    f"""WITH {QUEUE_SQL} SELECT escalation_id, strftime(created_at, '%Y-%m-%d') AS created, status FROM queue WHERE status = 'PENDING' ORDER BY created_at DESC, escalation_id LIMIT 50""",
)
def pending_escalations(spark: SparkSession, folder: str) -> DataFrame:
    return queues.list_escalations(queue(spark, folder)).select(
        "escalation_id", F.date_format("created_at", "yyyy-MM-dd").alias("created"), "status"
    )


@query(
    "resolved_escalations",
    f"""WITH {QUEUE_SQL}, u AS (SELECT 'E-' || l_orderkey AS escalation_id, max('by ' || l_suppkey) AS who, CASE WHEN max(l_linenumber) > 4 THEN 'RESOLVED' ELSE 'DISMISSED' END AS new_status FROM lineitem GROUP BY l_orderkey)
SELECT q.escalation_id, coalesce(u.new_status, q.status) AS status, u.who AS resolved_by FROM queue q LEFT JOIN u USING (escalation_id)""",
)
def resolved_escalations(spark: SparkSession, folder: str) -> DataFrame:
    updates = (
        table(spark, folder, "lineitem")
        .groupBy(F.concat(F.lit("E-"), F.col("l_orderkey")).alias("escalation_id"))
        .agg(
            F.max(F.concat(F.lit("by "), F.col("l_suppkey"))).alias("resolved_by"),
            F.lit("checked").alias("resolution_notes"),
            F.when(F.max("l_linenumber") > 4, "resolved").otherwise("Dismissed").alias("new_status"),
        )
    )
    merged, _ = queues.resolve_escalations(queue(spark, folder), updates, F.lit("2024-01-01").cast("timestamp"))
    return merged.select("escalation_id", "status", "resolved_by")


@query(
    "new_escalations",
    f"""WITH {GATE_SQL}, g AS (SELECT *, {_REASON_SQL} AS reasons FROM inv WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
SELECT substr(sha256('escalation|' || o_orderkey), 1, 32) AS escalation_id, well_id, reasons, risk AS risk_level, {_MESSAGE_SQL} AS summary, 'PENDING' AS status FROM g WHERE reasons <> ''""",
)
def new_escalations(spark: SparkSession, folder: str) -> DataFrame:
    """Escalated cases that are not in the queue yet."""
    now = F.lit("2024-01-01").cast("timestamp")
    gated = dec.with_escalation(gate_cases(spark, folder)).withColumn(
        "investigation_id", F.col("o_orderkey").cast("string")
    ).withColumn("root_cause_hypothesis", F.lit("Undetermined"))
    known = table(spark, folder, "lineitem").select(F.col("l_orderkey").cast("string").alias("investigation_id")).distinct()
    existing = queues.escalation_rows(gated.join(known, "investigation_id", "left_semi"), now)
    return queues.new_escalations(existing, gated, now).select(
        "escalation_id", "well_id", F.array_join("reasons", ",").alias("reasons"), "risk_level", "summary", "status"
    )


@query(
    "maintenance_records",
    f"""WITH {CORPUS_SQL}, wells AS (SELECT 'doc_' || (doc_id % 7) AS nothing, well_id FROM (SELECT doc_id, 'src' || (doc_id % 20) AS well_id FROM documents UNION SELECT doc_id, '15/9-f-' || doc_id FROM documents UNION SELECT doc_id, 'D-' || doc_id || 'H' FROM documents)),
w AS (SELECT DISTINCT well_id FROM wells), logs AS (SELECT c.*, r.doc_type FROM chunk_rows c JOIN registered r USING (document_id) WHERE r.doc_type = 'Maintenance Log'),
m AS (SELECT w.well_id, l.document_id, l.chunk_index, l.doc_id, l.content FROM w, logs l WHERE l.well_id = w.well_id OR contains(lower(l.content), lower(w.well_id))),
r AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY doc_id DESC, document_id, chunk_index) AS n FROM m)
SELECT well_id, CAST(n AS INTEGER) AS record_no, document_id, chunk_index, md5(substr(content, 1, 200)) AS excerpt_md5 FROM r WHERE n <= 5""",
)
def maintenance_records(spark: SparkSession, folder: str) -> DataFrame:
    source = corpus(spark, folder)
    # Chunks of other documents are no records; the type follows from the path, as the id does.
    documents = as_documents(source, F.lit("2024-01-01").cast("timestamp")).filter(F.col("doc_type") == "Maintenance Log")
    stamps = source.select(F.substring(F.sha2("path", 256), 1, 16).alias("document_id"), F.timestamp_seconds("doc_id").alias("indexed_at"))
    rows = as_chunks(documents).join(
        documents.select("document_id", "title", "doc_type", "well_id"), "document_id"
    ).join(stamps, "document_id")
    ids = table(spark, folder, "documents").select("doc_id")
    names = F.explode(
        F.array(
            F.concat(F.lit("src"), F.col("doc_id") % 20), F.concat(F.lit("15/9-f-"), F.col("doc_id")),
            F.concat(F.lit("D-"), F.col("doc_id"), F.lit("H")),
        )
    )
    wells = ids.select(names.alias("well_id")).distinct()
    return queues.maintenance_records(wells, rows).select(
        "well_id", "record_no", "document_id", "chunk_index", F.md5("excerpt").alias("excerpt_md5")
    )


# ── Model versions: each supplier trains on each return flag and status ──

VERSIONS_SQL = """versions AS (SELECT 'well-anomaly-detector-W_' || l_suppkey AS model_name, CAST(l_linenumber AS INTEGER) AS version, 'W ' || l_suppkey AS well_id,
  CASE max(l_returnflag) WHEN 'R' THEN 'Production' WHEN 'N' THEN 'Staging' ELSE 'Archived' END AS raw_stage, avg(l_discount) AS d FROM lineitem GROUP BY 1, 2, 3),
staged AS (SELECT *, CASE WHEN d < 0.0495 THEN 'Archived' WHEN d < 0.0505 THEN 'Staging' ELSE raw_stage END AS stage FROM versions)"""


def versions(spark: SparkSession, folder: str) -> DataFrame:
    top = F.max("l_returnflag")
    raw = F.when(top == "R", "Production").when(top == "N", "Staging").otherwise("Archived")
    well = F.concat(F.lit("W "), F.col("l_suppkey"))
    return (
        table(spark, folder, "lineitem")
        .groupBy(well.alias("well_id"), F.col("l_linenumber").cast("int").alias("version"))
        .agg(raw.alias("_raw"), F.avg("l_discount").alias("_d"))
        .withColumn("model_name", dec.model_name(F.col("well_id")))
        .withColumn("stage", F.when(F.col("_d") < 0.0495, "Archived").when(F.col("_d") < 0.0505, "Staging").otherwise(F.col("_raw")))
        .select("model_name", "version", "stage", "well_id")
    )


@query(
    "models_for_wells",
    f"""WITH {VERSIONS_SQL}, b AS (SELECT model_name, stage, max(version) AS version FROM staged WHERE stage IN ('Production', 'Staging') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY stage) AS n FROM b), w AS (SELECT DISTINCT well_id, model_name FROM staged)
SELECT w.well_id, 'models:/' || r.model_name || '/' || r.version AS model_uri, r.stage FROM w LEFT JOIN r ON r.model_name = w.model_name AND n = 1""",
)
def models_for_wells(spark: SparkSession, folder: str) -> DataFrame:
    every = versions(spark, folder)
    return catalog.model_for_wells(every.select("well_id").distinct(), every)


@query(
    "latest_model_versions",
    f"WITH {VERSIONS_SQL} SELECT model_name, stage, max(version) AS version FROM staged GROUP BY 1, 2",
)
def latest_model_versions(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.latest_versions(versions(spark, folder)).select("model_name", "stage", "version")


@query(
    "model_rollback",
    f"""WITH {VERSIONS_SQL}, c AS (SELECT model_name, max(version) AS a FROM staged WHERE stage = 'Production' GROUP BY 1),
p AS (SELECT s.model_name, max(version) AS p FROM staged s JOIN c USING (model_name) WHERE version <> a AND stage <> 'Archived' GROUP BY 1)
SELECT s.model_name, s.version, CASE WHEN version = a THEN 'Archived' WHEN version = p THEN 'Production' ELSE stage END AS stage FROM staged s LEFT JOIN c USING (model_name) LEFT JOIN p USING (model_name)""",
)
def model_rollback(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.apply_rollback(versions(spark, folder)).select("model_name", "version", "stage")


@query(
    "promotion_gate",
    """WITH m AS (SELECT l_suppkey, l_linestatus, avg(l_tax) * 25 AS r, avg(l_discount) * 4 AS f, CASE WHEN l_linestatus = 'O' THEN 'daily' ELSE 'hourly' END AS g FROM lineitem GROUP BY 1, 2),
q AS (SELECT *, round(r, 4) AS recall, round(f, 4) AS fpr FROM m),
p AS (SELECT *, CASE WHEN g = 'daily' THEN recall >= 0.6 ELSE recall >= 0.85 AND fpr <= 0.2 END AS ok FROM q)
SELECT l_suppkey, l_linestatus, ok AS gate_passed, CASE WHEN ok THEN 'Production' ELSE 'Staging' END AS stage,
  CASE WHEN ok AND g = 'daily' THEN 'Promoted' WHEN ok THEN 'Meets' ELSE 'Quality' END AS verdict FROM p""",
)
def promotion_gate(spark: SparkSession, folder: str) -> DataFrame:
    granularity = F.when(F.col("l_linestatus") == "O", "daily").otherwise("hourly")
    measured = (
        table(spark, folder, "lineitem")
        .groupBy("l_suppkey", "l_linestatus")
        .agg(
            F.round(F.avg("l_tax") * 25, 4).alias("event_recall"), F.round(F.avg("l_discount") * 4, 4).alias("day_fpr"),
        )
        .withColumn("data_granularity", granularity)
    )
    return catalog.judge(measured).select(
        "l_suppkey", "l_linestatus", "gate_passed", "stage", F.substring_index("justification", " ", 1).alias("verdict")
    )


# ── Dashboards: events are agent steps ──


@query(
    "dashboard_severity",
    f"WITH {GATE_SQL} SELECT risk AS severity, count(*) AS alerts FROM inv GROUP BY 1",
)
def dashboard_severity(spark: SparkSession, folder: str) -> DataFrame:
    return queues.alerts_by_severity(gate_cases(spark, folder).withColumnRenamed("risk_level", "severity"))


@query(
    "dashboard_reasons",
    f"""WITH {GATE_SQL}, g AS (SELECT risk, {_REASON_SQL} AS reasons FROM inv)
SELECT reason, risk AS risk_level, count(*) AS escalations FROM (SELECT risk, unnest(string_split(reasons, ',')) AS reason FROM g WHERE reasons <> '') GROUP BY 1, 2""",
)
def dashboard_reasons(spark: SparkSession, folder: str) -> DataFrame:
    gated = dec.with_escalation(gate_cases(spark, folder)).withColumnRenamed("escalation_reasons", "reasons")
    return queues.escalations_by_reason(gated)


@query(
    "dashboard_hourly",
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS escalations FROM events WHERE event_type = 'error' GROUP BY 1",
)
def dashboard_hourly(spark: SparkSession, folder: str) -> DataFrame:
    errors = table(spark, folder, "events").filter("event_type = 'error'").withColumn("ts", F.col("ts").cast("timestamp"))
    return queues.per_hour(errors, "ts", "escalations").withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query(
    "dashboard_token_rate",
    """SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M') AS window_start, event_type AS agent_id, round(sum(event_id % 1000) / 5, 6) AS tokens_per_minute FROM events GROUP BY 1, 2""",
)
def dashboard_token_rate(spark: SparkSession, folder: str) -> DataFrame:
    steps = table(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("agent_id"), (F.col("event_id") % 1000).alias("tokens_used")
    )
    rate = queues.token_rate(steps, "ts")
    return rate.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "agent_id",
        F.round("tokens_per_minute", 6).alias("tokens_per_minute"),
    )


@query(
    "dashboard_latency",
    """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""",
)
def dashboard_latency(spark: SparkSession, folder: str) -> DataFrame:
    exact = queues.latency_quantiles(table(spark, folder, "events"), "value", ["event_type"], exact=True)
    return exact.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@query(
    "dashboard_confidence",
    f"""WITH {GATE_SQL}, b AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 1.0]::DOUBLE[]) AS le)
SELECT risk AS risk_level, le, count(*) FILTER (WHERE confidence <= le) AS n FROM inv, b GROUP BY 1, 2""",
)
def dashboard_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return queues.confidence_histogram(gate_cases(spark, folder), "confidence_score", ["risk_level"])

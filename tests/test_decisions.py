import pytest
from pyspark.sql import functions as F

from borewatch.functions import decisions as dec
from borewatch.functions import economics
from borewatch.operators import catalog, metrics, queues

ESCALATIONS = [
    (0.88, "HIGH", True), (0.79, "HIGH", True), (0.90, "LOW", False), (0.92, "CRITICAL", True),
    (0.48, "MEDIUM", True), (0.87, "MEDIUM", False), (0.83, "LOW", False), (0.95, "CRITICAL", True),
]
CALIBRATION = [
    (0.88, True, False, False), (0.65, True, True, True), (0.82, True, False, False), (0.91, True, True, True),
    (0.85, False, False, True), (0.45, False, True, True), (0.78, True, False, False), (0.60, True, True, False),
]


def gate(spark, rows):
    ddl = "well_id STRING, confidence_score DOUBLE, evidence_coverage DOUBLE, risk_level STRING, error STRING, step_outputs ARRAY<STRING>"
    return dec.with_escalation(spark.createDataFrame(rows, ddl)).collect()


def test_known_escalations(spark):
    rows = gate(spark, [("W", c, 0.7, r, None, []) for c, r, _ in ESCALATIONS])
    assert [r["should_escalate"] for r in rows] == [e for *_, e in ESCALATIONS]
    assert all((r["escalation_message"] is not None) == r["should_escalate"] for r in rows)


def test_reasons_and_edges(spark):
    rows = gate(
        spark,
        [
            ("W", 0.75, 0.60, "MEDIUM", None, []),
            ("W", 0.749, 0.599, "LOW", None, ["fine"]),
            ("D-1H", 0.6, 0.9, "HIGH", "timeout", ["Well NOT FOUND"]),
            ("W", 0.9, 0.9, "LOW", None, ["No data for well"]),
        ],
    )
    assert rows[0]["escalation_reasons"] == []
    assert rows[1]["escalation_reasons"] == ["LOW_CONFIDENCE", "LOW_EVIDENCE_COVERAGE"]
    assert rows[2]["escalation_reasons"] == ["LOW_CONFIDENCE", "MISSING_DATA", "HIGH_HSE_RISK"]
    assert rows[2]["escalation_message"] == (
        "Investigation for well D-1H requires human review. Reasons: AI confidence 60% is below threshold 75%; "
        "Insufficient telemetry or document data available; Risk level HIGH requires human review per HSE-OPS-001. "
        "Per HSE-OPS-001, an engineer must review before any operational changes."
    )
    assert rows[3]["escalation_reasons"] == ["MISSING_DATA"]


def test_calibration_of_the_known_cases(spark):
    df = spark.createDataFrame(CALIBRATION, "confidence DOUBLE, correct BOOLEAN, predicted BOOLEAN, actual BOOLEAN")
    report = metrics.calibration(df, "confidence", F.col("correct")).first()
    assert report["ece"] == pytest.approx(0.2575) and report["calibration_grade"] == "POOR"
    # 0.60 belongs to the bin below 0.6000000000000001.
    bins = {r["bin"]: r["n"] for r in metrics.confidence_bins(df, "confidence", F.col("correct")).collect()}
    assert bins == {4: 1, 5: 1, 6: 1, 7: 1, 8: 3, 9: 1}
    assert df.agg(metrics.brier_score("confidence", F.col("correct"))).first()[0] == pytest.approx(0.16385)
    gate_report = metrics.escalation_calibration(df, "confidence", F.col("predicted"), F.col("actual")).first()
    assert (gate_report["true_positives"], gate_report["false_positives"], gate_report["false_negatives"]) == (3, 1, 1)
    assert gate_report["miss_rate"] == 0.25 and gate_report["safety_note"].startswith("Miss rate 25.0%")


def test_tool_rules(spark):
    calls = [
        ("executor", "query_timeseries", True, False), ("executor", "execute_shell", False, False),
        ("planner", "retrieve_documents", False, False), ("executor", "modify_choke", False, True),
        ("escalation", "notify_engineer", True, False), ("nobody", "query_timeseries", False, False),
    ]
    df = spark.createDataFrame([c[:2] for c in calls], "agent STRING, tool STRING")
    rows = df.select(dec.tool_verdict(F.col("agent"), F.col("tool")).alias("v")).select("v.*").collect()
    assert [(r["is_permitted"], r["requires_approval"]) for r in rows] == [c[2:] for c in calls]
    assert "blocked list" in rows[1]["reason"] and rows[2]["reason"].endswith("Permitted: []")


def test_plan_quality_of_the_known_cases(spark):
    cases = [
        ("HIGH", ["query_timeseries", "retrieve_documents"], 3, 5), ("HIGH", ["query_timeseries", "retrieve_documents", "query_similar_incidents"], 3, 5),
        ("MEDIUM", ["query_timeseries", "retrieve_documents"], 3, 4), ("CRITICAL", ["query_timeseries", "retrieve_documents"], 4, 5),
        ("MEDIUM", ["query_timeseries", "retrieve_documents", "query_similar_incidents"], 3, 5), ("LOW", ["modify_choke"], 4, 5),
    ]
    df = spark.createDataFrame(cases, "severity STRING, required ARRAY<STRING>, low INT, high INT").withColumn(
        "plan", dec.investigation_plan(F.lit("W"), F.array(F.lit("a"), F.lit("b")), F.col("severity"))
    )
    quality = dec.plan_quality(
        F.transform("plan", lambda s: s["tool_to_use"]), F.lit("query_timeseries"), F.col("required"), F.col("low"), F.col("high")
    )
    rows = df.select("plan", quality["score"].alias("score")).collect()
    assert [round(r["score"], 6) for r in rows] == [1.0, 1.0, 1.0, 1.0, 1.0, 0.4]
    assert [len(r["plan"]) for r in rows] == [4, 4, 3, 4, 3, 3]
    assert rows[0]["plan"][2]["description"] == "Search for similar a, b anomalies in historical incidents"


def test_small_rules(spark):
    row = spark.range(1).select(
        dec.clamp_confidence(F.lit(1.4), F.lit(0)).alias("a"), dec.clamp_confidence(F.lit(0.2), F.lit(3)).alias("b"),
        dec.evidence_coverage(F.array().cast("array<double>")).alias("c"),
        dec.needs_second_review(F.lit(0.8), F.lit("LOW"), F.lit(2)).alias("d"),
        dec.model_name(F.lit("15/9-F-1 C")).alias("e"),
        dec.meets_gate(F.lit(0.6), F.lit(0.9), F.lit("daily")).alias("f"),
        dec.promotion_justification(F.lit(0.5), F.lit(0.3), F.lit("hourly")).alias("g"),
        dec.evaluation_gates(F.lit(0.7), F.lit(0.85), F.lit(0.2), F.lit(0.9))["thresholds_met"].alias("h"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["f"], row["h"]) == (1.0, 0.1, 0.5, False, True, False)
    assert row["e"].endswith("15_9-F-1_C") and row["g"].startswith("Quality gate FAILED: event_recall=0.50")


def test_impact_by_hand(spark):
    rows = [
        ("oil_rate_collapse", {"oil_rate_bopd": 400.0, "bhp_psi": 2000.0}, {"oil_rate_bopd": 2000.0, "bhp_psi": 3000.0}, 2),
        ("gor_spike", {"oil_rate_bopd": 1000.0}, {"oil_rate_bopd": 1002.0}, 2),
        ("bhp_depletion", {"bhp_psi": 2850.0}, {"bhp_psi": 3000.0}, 8),
        ("thermal_excursion", {}, {}, 0),
    ]
    ddl = "anomaly_type STRING, current_values MAP<STRING,DOUBLE>, baseline_values MAP<STRING,DOUBLE>, consecutive_days INT"
    a, b, c, d = economics.assess_impact(spark.createDataFrame(rows, ddl), today=F.to_date(F.lit("2024-01-01"))).collect()
    assert a["production_loss"]["total_daily_impact_usd"] == 128000.0
    assert a["production_loss"]["basis"] == "Oil rate decline: 1600 BOPD × $80/bbl = $128,000/day"
    assert a["esp_rul"]["estimated_rul_days"] == 0 and a["esp_rul"]["intervention_deadline"] == "2024-01-01"
    assert a["recommendation"]["urgency"] == "IMMEDIATE" and a["recommendation"]["roi_days"] == 0.4
    assert b["production_loss"]["total_daily_impact_usd"] == 12024.0 and b["esp_rul"] is None
    # 5 % over 8 days: 30 % left at 0.625 % a day.
    assert c["esp_rul"]["estimated_rul_days"] == 48 and c["esp_rul"]["confidence"] == "HIGH"
    assert c["recommendation"]["urgency"] == "PLANNED" and c["recommendation"]["estimated_cost_usd"] == 3_500_000.0
    assert d["recommendation"]["roi_days"] == 999.0 and d["comparable_incidents"][0].startswith("No direct")
    assert len(d["causal_chain"]) == 4 and d["recommendation"]["supporting_evidence"] == []


def test_queue_and_catalogue(spark):
    now = F.lit("2024-01-02").cast("timestamp")
    queue = spark.sql(
        "SELECT 'e1' escalation_id, timestamp'2024-01-01' created_at, 'PENDING' status, CAST(NULL AS STRING) resolved_by, "
        "CAST(NULL AS STRING) resolution_notes, CAST(NULL AS TIMESTAMP) resolved_at "
        "UNION ALL SELECT 'e2', timestamp'2024-01-02', 'PENDING', NULL, NULL, NULL"
    )
    updates = spark.createDataFrame(
        [("e1", "ann", "ok", "resolved"), ("e9", "bob", "?", "DISMISSED")],
        "escalation_id STRING, resolved_by STRING, resolution_notes STRING, new_status STRING",
    )
    merged, missing = queues.resolve_escalations(queue, updates, now)
    state = {r["escalation_id"]: (r["status"], r["resolved_by"], r["resolved_at"] is not None) for r in merged.collect()}
    assert state == {"e1": ("RESOLVED", "ann", True), "e2": ("PENDING", None, False)}
    assert [r["escalation_id"] for r in missing.collect()] == ["e9"]
    assert [r["escalation_id"] for r in queues.list_escalations(queue, "all").collect()] == ["e2", "e1"]
    with pytest.raises(ValueError):
        queues.list_escalations(queue, "OPEN")
    versions = spark.createDataFrame(
        [("m", 1, "Archived"), ("m", 2, "Staging"), ("m", 3, "Production"), ("n", 1, "Production"), ("s", 4, "Staging")],
        "model_name STRING, version INT, stage STRING",
    )
    plan = {r["model_name"]: (r["archive_version"], r["promote_version"]) for r in catalog.rollback_plan(versions).collect()}
    assert plan == {"m": (3, 2), "n": (1, None)}
    wells = spark.createDataFrame([("m",), ("s",), ("x",)], "well_id STRING")
    renamed = versions.withColumn("model_name", dec.model_name(F.col("model_name")))
    uris = {r["well_id"]: r["model_uri"] for r in catalog.model_for_wells(wells, renamed).collect()}
    assert uris["m"].endswith("/3") and uris["s"].endswith("/4") and uris["x"] is None
    only = {r["well_id"]: r["model_uri"] for r in catalog.model_for_wells(wells, renamed, False).collect()}
    assert only["s"] is None


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame(
        [("a", 0.1, False), ("a", 0.4, True), ("a", 0.4, False), ("a", 0.9, True), ("b", 0.3, True)], "k STRING, s DOUBLE, y BOOLEAN"
    )
    areas = {r["k"]: r["roc_auc"] for r in metrics.roc_auc(df, "s", F.col("y"), ["k"]).collect()}
    assert areas == {"a": 0.875, "b": 0.5}


def test_maintenance_lookup(spark):
    chunks = spark.createDataFrame(
        [
            ("d1", 0, "Pump log", "Maintenance Log", "nothing", "A-1", 1), ("d2", 0, "Other", "Maintenance Log", "Seen near a-12h today", None, 2),
            ("d3", 0, "Report", "Well Report", "A-1 report", "A-1", 3), ("d4", 0, "Long", "Maintenance Log", "xA-1x", "B-2", 4),
        ],
        "document_id STRING, chunk_index INT, title STRING, doc_type STRING, content STRING, well_id STRING, t INT",
    ).withColumn("indexed_at", F.timestamp_seconds("t"))
    wells = spark.createDataFrame([("A-1",), ("B-2",), ("C-3",)], "well_id STRING")
    records = queues.maintenance_records(wells, chunks)
    found = {(r["well_id"], r["record_no"]): r["document_id"] for r in records.collect()}
    assert found == {("A-1", 1): "d4", ("A-1", 2): "d2", ("A-1", 3): "d1", ("B-2", 1): "d4"}
    texts = {r["well_id"]: r["summary_text"] for r in queues.maintenance_summary(records, wells).collect()}
    assert texts["A-1"] == "Found 3 maintenance records for A-1: Long; Other; Pump log"
    assert texts["C-3"] == "No maintenance records found for well C-3."


def test_two_updates_of_one_escalation_give_one_row(spark):
    held = spark.sql(
        "SELECT 'e1' escalation_id, 'PENDING' status, CAST(NULL AS STRING) resolved_by, CAST(NULL AS STRING) resolution_notes, "
        "CAST(NULL AS TIMESTAMP) resolved_at"
    )
    updates = spark.createDataFrame(
        [("e1", "ann", "first", "RESOLVED", 1), ("e1", "bo", "later", "DISMISSED", 2)],
        "escalation_id STRING, resolved_by STRING, resolution_notes STRING, new_status STRING, at INT",
    )
    merged, _ = queues.resolve_escalations(held, updates, F.lit("2024-01-01").cast("timestamp"), newest="at")
    assert [(r["status"], r["resolved_by"]) for r in merged.collect()] == [("DISMISSED", "bo")]

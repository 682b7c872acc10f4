import pandas as pd
from pyspark.sql import functions as F

from borewatch.functions.decisions import audit_record
from borewatch.operators import detect, queues
from borewatch.operators.retrieval import CHUNK_KEY, hashed_embedding
from borewatch.plans import investigate
from borewatch.schema import FEATURES, alert_rules, split_valid
from tests.series import noisy


def test_alerts_become_investigations_and_escalations(spark):
    frame = noisy(2, 200, shift_at=150)
    telemetry = spark.createDataFrame(frame)
    alerts = detect.detect_v2(telemetry).filter("ordinal > 150").cache()
    valid, broken = split_valid(alerts, alert_rules())
    assert valid.count() == alerts.count() > 0 and broken.isEmpty()
    chunks = spark.createDataFrame(
        [
            ("d1", 0, "Water breakthrough incident on W-0: water cut pct rose, oil rate bopd fell", "Incident report", "Well Report", None),
            ("d2", 0, "Pump serviced on w-1 in March", "Pump log", "Maintenance Log", "W-1"),
        ],
        "document_id STRING, chunk_index INT, content STRING, title STRING, doc_type STRING, well_id STRING",
    ).withColumns(
        {"section": F.lit("Body"), "page_number": F.lit(None).cast("int"), "source_path": F.lit("x.md"), "indexed_at": F.lit("2024-01-01").cast("timestamp")}
    )
    chunks = chunks.join(hashed_embedding(chunks, CHUNK_KEY, "content"), CHUNK_KEY).cache()
    now = F.lit("2024-01-10").cast("timestamp")
    packs = investigate.evidence_packs(valid, telemetry, ["timestamp"], chunks, hashed_embedding, now)
    rows = investigate.investigations(packs, now).cache()
    found = rows.collect()
    assert len(found) == alerts.count() and len({r["investigation_id"] for r in found}) == len(found)
    one = next(r for r in found if r["well_id"] == "W-1")
    summary, status, maintenance = one["supporting_evidence"]
    assert summary.startswith("Telemetry summary for W-1 over the last 72 hours (73 readings, 100% complete):")
    assert status.startswith("Well W-1 last reading at 2024-01-09") and "Recent alerts (7d)" in status
    assert maintenance == "Found 1 maintenance records for W-1: Pump log"
    assert "W-0" in next(r for r in found if r["well_id"] == "W-0")["supporting_evidence"][2]
    assert [s["step_id"] for s in one["agent_steps"]][:3] == [1, 2, 3]
    assert all(r["should_escalate"] == bool(r["escalation_reasons"]) for r in found)
    escalated = queues.escalation_rows(rows, now)
    assert escalated.count() == sum(r["should_escalate"] for r in found)
    assert queues.list_investigations(rows, "W-1", 1).count() == 1
    # Early mean, whole-window trend and tail trend by hand.
    part = frame[frame["well_id"] == "W-1"].reset_index(drop=True)
    at = part.index[part["timestamp"] == one["timestamp"]][0]
    window = part.loc[at - 72 : at, "water_cut_pct"]
    early, late = window.head(7).mean(), window.mean()
    line = next(x for x in summary.split("\n") if x.strip().startswith("water_cut_pct"))
    assert f"mean={round(late, 2)}" in line and f"{abs((late - early) / early * 100):.1f}%" in line


def test_audit_rows_keep_hashes(spark):
    df = spark.createDataFrame(
        pd.DataFrame([["i", "executor", "s", "t", "in", "out", 1, 2.0, True, "-"]], columns="investigation_id agent_id step_name tool_called a b tokens_used latency_ms success error_message".split())
    )
    row = audit_record(df, "a", "b").first()
    assert len(row["input_hash"]) == len(row["output_hash"]) == 16 and "a" not in audit_record(df, "a", "b").columns
    assert FEATURES[0] == "oil_rate_bopd"

"""Texts of alerts, windows, citations, gates and files over whole tables, each with SQL of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borewatch.functions import decisions as dec
from borewatch.functions import text as tx
from borewatch.operators import detect, retrieval
from borewatch.operators import windows_of_time as wt
from borewatch.plans import corpus
from borewatch.plans.catalogue import query
from borewatch.plans.registered.detection import (
    _BASE_V2_SQL, _WELL_ORDER, _base_v1_sql, _greatest, fold_sql, v2_series, z_sql,
)
from borewatch.plans.registered.generation import GOLDEN_SQL
from borewatch.plans.registered.telemetry import daily
from borewatch.plans.roles import READINGS_SQL, TELEMETRY_ORDER, TELEMETRY_SQL, readings, settled_sql, table, telemetry
from borewatch.schema import FEATURES
from borewatch.session import ensure_checkpoint_dir
from borewatch.sources import documents, production, tables
from borewatch.sources.named_files import write_named


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/evidence/{uuid.uuid4().hex}"


def _deviation(f: str, floored: bool) -> str:
    scale = f"greatest(abs(base_{f}), 1e-6)" if floored else f"abs(base_{f})"
    return settled_sql(f"100 * ({f} - base_{f}) / {scale}", 1)


def _phrases_sql(condition: str, floored: bool) -> str:
    """'water cut pct (+12.5%), ...' over the affected features."""
    parts = []
    for f in FEATURES:
        change = _deviation(f, floored) if floored else f"CASE WHEN base_{f} <> 0 THEN {_deviation(f, False)} ELSE 0.0 END"
        parts.append(f"CASE WHEN {condition.format(f=f)} THEN '{f.replace('_', ' ')} (' || printf('%+.1f', {change}) || '%)' END")
    return f"coalesce(concat_ws(', ', {', '.join(parts)}), '')"


def _change(f: str) -> str:
    return f"(CASE WHEN z_{f} >= 2 AND base_{f} <> 0 THEN {_deviation(f, False)} ELSE 0.0 END)"


_CAUSES_SQL = f"""concat_ws('; ',
  CASE WHEN z_water_cut_pct >= 2 AND {_change('water_cut_pct')} > 0 THEN 'possible water breakthrough or coning' END,
  CASE WHEN z_oil_rate_bopd >= 2 AND {_change('oil_rate_bopd')} < -20 THEN CASE WHEN z_bhp_psi >= 2 AND {settled_sql('bhp_psi', 2)} < 2500
    THEN 'possible pump failure or liquid loading' ELSE 'possible choke restriction or separator upset' END END,
  CASE WHEN z_gas_oil_ratio >= 2 AND {_change('gas_oil_ratio')} > 50 THEN 'possible gas coning or separator malfunction' END,
  CASE WHEN z_bhp_psi >= 2 AND {_change('bhp_psi')} < -15 THEN 'possible reservoir pressure depletion or pump issue' END)"""


@query(
    "alert_texts_v1",
    f"""WITH {TELEMETRY_SQL}, {z_sql(FEATURES, "well_id", _WELL_ORDER, 24, 1, "telemetry")},
b AS (SELECT *, {_greatest("z")} AS max_z, {_base_v1_sql()} FROM z),
t AS (SELECT *, {_phrases_sql("z_{f} >= 2", False)} AS phrases, coalesce({_CAUSES_SQL}, '') AS causes FROM b WHERE max_z >= 2)
SELECT well_id, pos AS ordinal, CASE WHEN max_z / 6 >= 0.85 OR max_z >= 5 THEN 'CRITICAL' WHEN max_z / 6 >= 0.65 OR max_z >= 3.5 THEN 'HIGH'
  WHEN max_z / 6 >= 0.45 OR max_z >= 2.5 THEN 'MEDIUM' ELSE 'LOW' END || ' anomaly on ' || well_id || ': abnormal ' || phrases || '.'
  || CASE WHEN causes <> '' THEN ' Possible causes: ' || causes || '.' ELSE '' END AS description FROM t""",
)
def alert_texts_v1(spark: SparkSession, folder: str) -> DataFrame:
    """What every version 1 alert says."""
    series = detect.v1_series(telemetry(spark, folder), order=TELEMETRY_ORDER, use_forest=False)
    return detect.alerts_v1(detect.diagnose_v1(series, use_forest=False)).select("well_id", "ordinal", "description")


_LOSS = "greatest(0.0, base_oil_rate_bopd - oil_rate_bopd)"
_WATER = (
    "greatest(0.0, water_cut_pct - base_water_cut_pct) / 100 * "
    "(base_oil_rate_bopd / greatest(0.01, 1 - base_water_cut_pct / 100))"
)


@query(
    "alert_texts_v2",
    f"""WITH RECURSIVE {TELEMETRY_SQL}, {z_sql(FEATURES, "well_id", _WELL_ORDER, 30, 2, "telemetry")},
live AS MATERIALIZED (SELECT *, {_greatest("z")} >= 3 AS raw_flag FROM (SELECT z.*, {_BASE_V2_SQL} FROM z)),
{fold_sql("live", "well_id", FEATURES)},
t AS (SELECT *, {_LOSS} AS loss, {_WATER} AS water, {_phrases_sql("z_{f} >= 2.4", True)} AS phrases FROM fold JOIN live USING (well_id, pos) WHERE alert)
SELECT well_id, pos AS ordinal, phrases, drift AS drift_named, loss > 0 AS loss_named, water > 0 AS water_named,
  CASE WHEN loss > 0 THEN printf('%.0f', round_even(loss, 0)) END AS barrels_lost FROM t""",
)
def alert_texts_v2(spark: SparkSession, folder: str) -> DataFrame:
    """What every version 2 alert says (P12), taken apart: the phrases, the drift, the losses."""
    alerts = detect.alerts_v2(detect.fold_series_v2(v2_series(spark, folder, 32)))
    said = F.col("description")
    head = F.concat("severity", F.lit(" "), "anomaly_type", F.lit(" on "), "well_id", F.lit(": "))
    body = F.when(said.startswith(head), F.substring(said, F.length(head) + 1, F.length(said)))
    lost = F.regexp_extract(body, r"Economic impact: (\d+) BOPD lost", 1)
    return alerts.withColumn("_body", body).select(
        "well_id", "ordinal", F.regexp_extract("_body", r"^(.*?)\. (?:CUSUM|Economic)", 1).alias("phrases"),
        F.col("_body").contains("CUSUM gradual drift confirmed. ").alias("drift_named"), (lost != "").alias("loss_named"),
        F.col("_body").contains("excess water handling").alias("water_named"), F.when(lost != "", lost).alias("barrels_lost"),
    )


@query(
    "window_of_a_well",
    f"""WITH {READINGS_SQL}, w AS (SELECT user_id, max(ts) AS top FROM readings GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1)
SELECT event_id, value FROM readings JOIN w USING (user_id) WHERE ts BETWEEN top - INTERVAL 72 HOUR AND top""",
)
def window_of_a_well(spark: SparkSession, folder: str) -> DataFrame:
    """The last 72 hours of the series with the most readings (F2)."""
    rows = readings(spark, folder).withColumns({"well_id": F.col("user_id").cast("string"), "timestamp": F.col("ts")})
    most = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("top")).orderBy(F.desc("n"), "user_id").first()
    return wt.in_window(rows, str(most["user_id"]), F.lit(most["top"])).select("event_id", "value")


@query(
    "titled_contexts",
    """SELECT doc_id, md5(substr('[Source: Report ' || doc_id || ']' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 400)) AS context_md5
FROM documents WHERE text IS NOT NULL""",
)
def titled_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts under their title, clipped (P10)."""
    rows = table(spark, folder, "documents").filter("text is not null")
    title = F.concat(F.lit(" Report "), "doc_id", F.lit("\n"))
    return rows.select("doc_id", F.md5(tx.titled(title, F.col("text"), 400)).alias("context_md5"))


@query(
    "incident_citations",
    """WITH c AS (SELECT doc_id // 10 AS query_id, doc_id, 'Report ' || doc_id || CASE doc_id % 7 WHEN 0 THEN ' PUMP FAILURE' WHEN 3 THEN ' upset' ELSE '' END AS title,
  CASE source WHEN 'src2' THEN 'Incident Log' ELSE 'Document' END AS kind FROM documents)
SELECT query_id, count(*) AS citations, count(*) FILTER (WHERE lower(title || kind) LIKE '%failure%' OR lower(title || kind) LIKE '%upset%' OR lower(title || kind) LIKE '%incident%') AS incidents
FROM c GROUP BY 1""",
)
def incident_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Citations whose title or kind names an incident."""
    number = F.col("doc_id")
    named = F.when(number % 7 == 0, " PUMP FAILURE").when(number % 7 == 3, " upset").otherwise("")
    citation = F.struct(
        F.concat(F.lit("Report "), number, named).alias("document_title"),
        F.when(F.col("source") == "src2", "Incident Log").otherwise("Document").alias("document_type"),
    )
    # ten documents answer a question
    answers = table(spark, folder, "documents").groupBy(F.floor(number / 10).alias("query_id")).agg(F.collect_list(citation).alias("citations"))
    return retrieval.incident_citations(answers).select(
        "query_id", F.size("citations").cast("long").alias("citations"), F.size("incident_citations").cast("long").alias("incidents")
    )


@query(
    "incident_queries",
    """SELECT event_id, 'production anomaly incident ' || concat_ws(', ', CASE WHEN value > 10 THEN 'oil_rate_bopd' END, CASE WHEN event_id % 3 = 0 THEN 'bhp_psi' END)
  || ': ' || event_type || ' on ' || user_id AS query FROM events""",
)
def incident_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The question an alert asks of the incident archive."""
    features = F.array_compact(
        F.array(F.when(F.col("value") > 10, F.lit("oil_rate_bopd")), F.when(F.col("event_id") % 3 == 0, F.lit("bhp_psi")))
    )
    said = F.concat("event_type", F.lit(" on "), F.col("user_id").cast("string"))
    return table(spark, folder, "events").select("event_id", tx.incident_query(said, features).alias("query"))


@query(
    "status_gates",
    """WITH m AS (SELECT o_orderkey, (o_orderkey % 100) / 100.0::DOUBLE AS p, (o_custkey % 100) / 100.0::DOUBLE AS r, (o_orderkey % 37) / 100.0::DOUBLE AS e, (o_custkey % 97) / 97.0::DOUBLE AS f FROM orders)
SELECT o_orderkey, p >= 0.7 AS plan_ok, r >= 0.85 AS recall_ok, e <= 0.15 AS ece_ok, f >= 0.8 AS faithfulness_ok, p >= 0.7 AND r >= 0.85 AND e <= 0.15 AS thresholds_met FROM m""",
)
def status_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Release gates over evaluation results."""
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    gates = dec.evaluation_gates(
        order % 100 / F.lit(100.0), customer % 100 / F.lit(100.0), order % 37 / F.lit(100.0), customer % 97 / F.lit(97.0)
    )
    return table(spark, folder, "orders").select("o_orderkey", gates.alias("g")).select("o_orderkey", "g.*")


@query("golden_set_read_back", f"WITH {GOLDEN_SQL} SELECT id, category, question, topics AS expected_topics, truth AS ground_truth, sources AS document_sources FROM golden")
def golden_set_read_back(spark: SparkSession, folder: str) -> DataFrame:
    """The golden set written as JSON and read again."""
    base = _folder(spark)
    tables.write_json(corpus.golden_cases(daily(spark, folder)), f"{base}/golden")
    return documents.read_golden(spark, f"{base}/golden", lines=True).withColumns(
        {"expected_topics": F.array_join("expected_topics", ", "), "document_sources": F.array_join("document_sources", ",")}
    )


@query(
    "scanned_corpus",
    r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE text END AS body, ['md', 'txt', 'csv'][doc_id % 3 + 1] AS kind FROM documents WHERE text IS NOT NULL)
SELECT 'page_' || doc_id || '.' || kind AS name, md5(body) AS text_md5 FROM d WHERE kind <> 'csv' AND regexp_matches(body, '\S')""",
)
def scanned_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Files in two folders, some of other kinds, some blank, and what the corpus scan takes of them."""
    base = _folder(spark)
    number = F.col("doc_id")
    kind = F.element_at(F.array(F.lit("md"), F.lit("txt"), F.lit("csv")), (number % 3 + 1).cast("int"))
    pages = table(spark, folder, "documents").filter("text is not null").select(
        "doc_id", F.concat(F.lit("page_"), number, F.lit("."), kind).alias("name"),
        F.when(number % 5 == 0, " ").otherwise(F.col("text")).alias("text"),
    )
    for part in (0, 1):
        write_named(pages.filter(number % 2 == part).drop("doc_id"), f"{base}/docs/part{part}")
    found = documents.read_corpus(spark, f"{base}/docs")
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.md5("text").alias("text_md5"))


@query(
    "cleared_stores",
    """SELECT 'orders' AS store, count(*) AS held, 0::BIGINT AS left_over FROM orders UNION ALL SELECT 'customer', count(*), 0 FROM customer""",
)
def cleared_stores(spark: SparkSession, folder: str) -> DataFrame:
    """Stores filled, appended to and cleared, with the rows each held."""
    base, schemas, rows = _folder(spark), {}, []
    for name in ("orders", "customer"):
        df = table(spark, folder, name)
        key = df.columns[0]
        tables.replace_table(df.filter(F.col(key) % 2 == 0), f"{base}/{name}")
        for _ in range(2):
            tables.append_rows(df.filter(F.col(key) % 2 != 0), f"{base}/{name}", "odd")
        schemas[f"{base}/{name}"] = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    held = tables.clear_tables(spark, schemas)
    for path, n in held.items():
        rows.append((path.rsplit("/", 1)[1], n, tables.read_table(spark, path, schemas[path]).count()))
    return spark.createDataFrame(rows, "store STRING, held BIGINT, left_over BIGINT")


@query(
    "cached_tables",
    """SELECT (SELECT count(*) FROM orders) AS orders, (SELECT round(sum(o_totalprice), 2) FROM orders) AS price, (SELECT count(*) FROM customer) AS customers, true AS incomplete_is_none""",
)
def cached_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Frames through the cache, and a cache that lacks one."""
    base = _folder(spark)
    production.save_cache({n: table(spark, folder, n) for n in ("orders", "customer")}, base)
    held = production.load_cache(spark, base, ["orders", "customer"])
    absent = production.load_cache(spark, base, ["orders", "monthly"]) is None
    sums = held["orders"].agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("price"))
    count = held["customer"].agg(F.count(F.lit(1)).alias("n"))
    return sums.withColumn("customers", count.scalar()).withColumn("incomplete_is_none", F.lit(absent))

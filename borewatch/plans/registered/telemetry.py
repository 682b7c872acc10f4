"""Production scans, statistics and time windows over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borewatch.operators import production_stats as stats
from borewatch.operators import windows_of_time as wt
from borewatch.plans.catalogue import query
from borewatch.plans.roles import (
    DAILY_SQL,
    MONTHLY_SQL,
    READINGS_SQL,
    TELEMETRY_SQL,
    raw_daily,
    raw_monthly,
    readings,
    settled_sql,
    table,
    telemetry,
)
from borewatch.schema import FEATURES, fixed_table, split_valid
from borewatch.sources import production

DAY = "yyyy-MM-dd"
DAILY_COLUMNS = ", ".join(FEATURES)


def daily(spark: SparkSession, folder: str) -> DataFrame:
    return production.normalise_daily(raw_daily(spark, folder))


def monthly(spark: SparkSession, folder: str) -> DataFrame:
    return production.normalise_monthly(raw_monthly(spark, folder), None, 1990, 2024)


@query(
    "daily_production",
    f"""WITH {DAILY_SQL}
SELECT strftime("timestamp", '%Y-%m-%d') AS day, well_id, field_name, on_stream_hrs, {DAILY_COLUMNS}, is_producing FROM daily""",
)
def daily_production(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder).select(
        F.date_format("timestamp", DAY).alias("day"), "well_id", "field_name", "on_stream_hrs", *FEATURES, "is_producing"
    )


@query(
    "monthly_production",
    f"""WITH {MONTHLY_SQL} SELECT * FROM monthly WHERE "year" BETWEEN 1990 AND 2024""",
)
def monthly_production(spark: SparkSession, folder: str) -> DataFrame:
    return monthly(spark, folder).select(
        "field_name", "year", "month", "days_in_month", "oil_net_mill_sm3", "gas_net_bill_sm3",
        "produced_water_mill_sm3", "oil_bopd", "water_bwpd", "water_cut_pct", "gor_scf_bbl",
    )


@query(
    "wellbore_monthly_production",
    f"""WITH {MONTHLY_SQL} SELECT 'bore ' || field_name AS well_id, field_name, "year", "month", oil_net_mill_sm3, produced_water_mill_sm3 AS water_net_mill_sm3, oil_bopd, water_bwpd, water_cut_pct, gor_scf_bbl
FROM monthly WHERE "year" BETWEEN 1993 AND 1996""",
)
def wellbore_monthly_production(spark: SparkSession, folder: str) -> DataFrame:
    """The monthly file of wellbores, which names its columns in its own way (S3)."""
    raw = raw_monthly(spark, folder).withColumnRenamed("prfPrdProducedWaterInFieldMillSm3", "prfPrdWaterNetMillSm3")
    raw = raw.withColumn("wlbWellboreName", F.concat(F.lit("bore "), "prfInformationCarrier"))
    return production.normalise_wellbore_monthly(raw, 1993, 1996).select(
        "well_id", "field_name", "year", "month", "oil_net_mill_sm3", "water_net_mill_sm3", "oil_bopd", "water_bwpd",
        "water_cut_pct", "gor_scf_bbl",
    )


@query(
    "well_statistics",
    f"""WITH {DAILY_SQL}
SELECT well_id, count(*) AS producing_days, max(oil_rate_bopd) AS peak_oil_bopd, round(avg(oil_rate_bopd), 9) AS avg_oil_bopd,
       max(water_cut_pct) AS peak_water_cut_pct, round(avg(water_cut_pct), 9) AS avg_water_cut_pct,
       round(avg(gas_oil_ratio), 9) AS avg_gor_scf_bbl,
       round(coalesce(avg(bhp_psi) FILTER (WHERE bhp_psi > 0), 0), 9) AS avg_bhp_psi,
       strftime(min("timestamp"), '%Y-%m-%d') || ' → ' || strftime(max("timestamp"), '%Y-%m-%d') AS date_range
FROM daily WHERE is_producing GROUP BY well_id""",
)
def well_statistics(spark: SparkSession, folder: str) -> DataFrame:
    means = ["avg_oil_bopd", "avg_water_cut_pct", "avg_gor_scf_bbl", "avg_bhp_psi"]
    return stats.well_statistics(daily(spark, folder)).withColumns({m: F.round(m, 9) for m in means})


@query(
    "peak_days",
    f"""WITH {DAILY_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY oil_rate_bopd DESC, "timestamp", water_cut_pct, gas_oil_ratio) AS a,
             row_number() OVER (PARTITION BY well_id ORDER BY water_cut_pct DESC, "timestamp", oil_rate_bopd, gas_oil_ratio) AS b FROM daily WHERE is_producing)
SELECT well_id, max(CASE WHEN a = 1 THEN strftime("timestamp", '%Y-%m-%d') END) AS peak_oil_day,
       max(CASE WHEN a = 1 THEN oil_rate_bopd END) AS peak_oil, max(CASE WHEN b = 1 THEN strftime("timestamp", '%Y-%m-%d') END) AS peak_cut_day,
       max(CASE WHEN b = 1 THEN water_cut_pct END) AS peak_cut, max(CASE WHEN b = 1 THEN oil_rate_bopd END) AS oil_at_peak_cut
FROM o GROUP BY well_id""",
)
def peak_days(spark: SparkSession, folder: str) -> DataFrame:
    peaks = stats.peak_days(daily(spark, folder), ["timestamp", "oil_rate_bopd", "water_cut_pct", "gas_oil_ratio"])
    return peaks.select(
        "well_id",
        F.date_format("peak_oil.timestamp", DAY).alias("peak_oil_day"),
        F.col("peak_oil.oil_rate_bopd").alias("peak_oil"),
        F.date_format("peak_cut.timestamp", DAY).alias("peak_cut_day"),
        F.col("peak_cut.water_cut_pct").alias("peak_cut"),
        F.col("peak_cut.oil_rate_bopd").alias("oil_at_peak_cut"),
    )


@query(
    "recent_monthly_means",
    f"""WITH {DAILY_SQL},
m AS (SELECT well_id, date_trunc('month', "timestamp") AS m, count(*) AS days, avg(oil_rate_bopd) AS o, avg(water_cut_pct) AS w FROM daily GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY m DESC) AS back FROM m)
SELECT well_id, strftime(m, '%Y-%m') AS "month", days, round(o, 9) AS oil_bopd_mean, round(w, 9) AS wct_mean FROM r WHERE back <= 48""",
)
def recent_monthly_means(spark: SparkSession, folder: str) -> DataFrame:
    return stats.monthly_means(daily(spark, folder)).select(
        "well_id", F.date_format("month", "yyyy-MM").alias("month"), "days",
        F.round("oil_bopd_mean", 9).alias("oil_bopd_mean"), F.round("wct_mean", 9).alias("wct_mean"),
    )


@query(
    "field_statistics",
    f"""WITH {MONTHLY_SQL},
kept AS (SELECT * FROM monthly WHERE "year" BETWEEN 1990 AND 2024),
r AS (SELECT *, row_number() OVER (PARTITION BY field_name ORDER BY "year" DESC, "month" DESC) AS back,
             row_number() OVER (PARTITION BY field_name ORDER BY oil_bopd DESC, "year", "month") AS top FROM kept)
SELECT field_name, {settled_sql('sum(oil_net_mill_sm3) * 1e6 * 6.28981 / 1000', 0)} AS total_oil_thousand_bbl,
       max(oil_bopd) AS peak_oil_bopd, max(CASE WHEN top = 1 THEN "year" END) AS peak_year,
       {settled_sql('avg(water_cut_pct)', 1)} AS avg_water_cut_pct, {settled_sql('avg(gor_scf_bbl)', 0)} AS avg_gor_scf_bbl,
       min("year") || '-' || max("year") AS production_years, count(*) AS months_of_data,
       {settled_sql('avg(water_cut_pct) FILTER (WHERE back <= 24)', 1)} AS late_field_water_cut_pct
FROM r GROUP BY field_name""",
)
def field_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return stats.field_statistics(monthly(spark, folder))


@query(
    "period_contexts",
    f"""WITH {MONTHLY_SQL},
i AS (SELECT *, "year" * 12 + "month" AS idx FROM monthly WHERE "year" BETWEEN 1990 AND 2024)
SELECT field_name, "year", "month", oil_bopd, round(avg(oil_bopd) OVER w, 9) AS avg_oil_bopd_12m,
       round(avg(water_cut_pct) OVER w, 9) AS avg_water_cut_pct_12m, max(oil_bopd) OVER w AS max_oil_bopd_12m
FROM i WINDOW w AS (PARTITION BY field_name ORDER BY idx RANGE BETWEEN 12 PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def period_contexts(spark: SparkSession, folder: str) -> DataFrame:
    return stats.every_period_context(monthly(spark, folder)).select(
        "field_name", "year", "month", "oil_bopd", F.round("avg_oil_bopd_12m", 9).alias("avg_oil_bopd_12m"),
        F.round("avg_water_cut_pct_12m", 9).alias("avg_water_cut_pct_12m"), "max_oil_bopd_12m",
    )


@query(
    "field_facts",
    f"""WITH {MONTHLY_SQL},
names AS (SELECT DISTINCT o_orderpriority AS field_name FROM orders UNION SELECT 'Volve' UNION SELECT 'DRAUGEN'),
m AS (SELECT field_name, max(oil_bopd) AS peak FROM monthly WHERE "year" BETWEEN 1990 AND 2024 GROUP BY 1),
k(field_name, block, operator, peak) AS (VALUES ('Volve', '15/9', 'Equinor', 56200.0), ('Draugen', '6407/9', 'Okea', 200000.0))
SELECT n.field_name, k.block, k.operator, CAST(coalesce(m.peak, k.peak) AS DOUBLE) AS peak_oil_bopd,
       CASE WHEN m.field_name IS NOT NULL THEN 'measured' WHEN k.field_name IS NOT NULL THEN 'published' END AS basis
FROM names n LEFT JOIN m ON upper(n.field_name) = upper(m.field_name) LEFT JOIN k ON upper(n.field_name) = upper(k.field_name)""",
)
def field_facts(spark: SparkSession, folder: str) -> DataFrame:
    named = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("field_name")).distinct()
    asked = named.unionByName(fixed_table(spark, [("Volve",), ("DRAUGEN",)], "field_name STRING"))
    facts = stats.with_field_facts(asked, stats.field_statistics(monthly(spark, folder)))
    return facts.select("field_name", "block", "operator", "peak_oil_bopd", "basis")


@query(
    "well_catalogue",
    f"""WITH {TELEMETRY_SQL}
SELECT well_id, field_name, strftime(min("timestamp"), '%Y-%m-%d') AS first_reading,
       strftime(max("timestamp"), '%Y-%m-%d') AS last_reading, count(*) AS total_readings FROM telemetry GROUP BY 1, 2""",
)
def well_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return stats.well_catalogue(telemetry(spark, folder)).withColumns(
        {c: F.date_format(c, DAY) for c in ("first_reading", "last_reading")}
    )


@query(
    "telemetry_quarantine",
    f"""WITH {TELEMETRY_SQL}
SELECT well_id, reading_id, 'water_cut_pct' AS violations FROM telemetry WHERE NOT water_cut_pct * 1.1 BETWEEN 0 AND 100""",
)
def telemetry_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    drifted = telemetry(spark, folder).withColumn("water_cut_pct", F.col("water_cut_pct") * 1.1)
    rules = {"water_cut_pct": F.col("water_cut_pct").between(0, 100), "bhp_psi": F.col("bhp_psi").isNotNull()}
    _, bad = split_valid(drifted, rules)
    return bad.select("well_id", "reading_id", F.array_join("violations", ",").alias("violations"))


_MARKERS_SQL = "alerts AS (SELECT 'E-' || event_id AS alert_id, user_id, ts FROM readings WHERE event_type = 'error')"


def error_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Every error event raises an alert on its series."""
    return readings(spark, folder).filter("event_type = 'error'").select(
        F.concat(F.lit("E-"), F.col("event_id")).alias("alert_id"), "user_id", "ts"
    )


def _summary_sql() -> str:
    def feature(i: int, f: str) -> str:
        trend = settled_sql("coalesce(({late} - early) / nullif(abs(early), 0) * 100, 0)", 1)
        return f"""SELECT alert_id, user_id, record_count, completeness, {i} AS feature_no, '{f}' AS feature,
  {settled_sql("mean", 2)} AS mean, {settled_sql("std", 2)} AS std, mn AS min, mx AS max,
  {trend.format(late="mean")} AS trend_pct, {trend.format(late="late")} AS trend_tail_pct
FROM (SELECT alert_id, user_id, n AS record_count, round_even(least(1.0, n / 72.0) * 1000, 0) / 1000 AS completeness, avg({f}) AS mean,
             stddev_pop({f}) AS std, min({f}) AS mn, max({f}) AS mx,
             avg({f}) FILTER (WHERE rn <= tenth) AS early, avg({f}) FILTER (WHERE rn > n - tenth) AS late FROM ranked GROUP BY 1, 2, 3)"""

    return f"""{READINGS_SQL}, {_MARKERS_SQL},
pairs AS (SELECT a.alert_id, a.user_id, r.ts, r.event_id, r.value, r.k FROM alerts a JOIN readings r
          ON a.user_id = r.user_id AND r.ts BETWEEN a.ts - INTERVAL 72 HOUR AND a.ts),
ranked AS (SELECT *, greatest(1, n // 10) AS tenth FROM (
  SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY alert_id) AS n FROM pairs)),
summary AS ({feature(0, "value")} UNION ALL {feature(1, "k")})"""


@query("window_summaries", f"WITH {_summary_sql()} SELECT * FROM summary")
def window_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return wt.summarise_before(
        error_alerts(spark, folder), readings(spark, folder), ["ts", "event_id"], ["value", "k"], 72, "user_id", "ts"
    )


@query(
    "window_summary_texts",
    f"""WITH {_summary_sql()},
t AS (SELECT alert_id, user_id, record_count, completeness, feature_no,
  '  ' || feature || ': mean=' || regexp_replace(printf('%.2f', mean), '(\\.\\d)0$', '\\1') || ', std=' || regexp_replace(printf('%.2f', std), '(\\.\\d)0$', '\\1')
  || ', range=[' || regexp_replace(printf('%.2f', min), '(\\.\\d)0$', '\\1') || ', ' || regexp_replace(printf('%.2f', max), '(\\.\\d)0$', '\\1') || '], trend='
  || CASE WHEN trend_pct > 2 THEN '▲' WHEN trend_pct < -2 THEN '▼' ELSE '→' END || printf('%.1f%%', abs(trend_pct)) AS line FROM summary)
SELECT alert_id, 'Telemetry summary for ' || user_id || ' over the last 72 hours (' || record_count || ' readings, '
  || printf('%.0f%%', round_even(completeness * 100, 0)) || ' complete):' || chr(10) || string_agg(line, chr(10) ORDER BY feature_no) AS summary_text
FROM t GROUP BY alert_id, user_id, record_count, completeness""",
)
def window_summary_texts(spark: SparkSession, folder: str) -> DataFrame:
    return wt.summary_text(window_summaries(spark, folder), ["alert_id"], well="user_id")


@query(
    "latest_readings",
    f"""WITH {READINGS_SQL}
SELECT CAST(user_id AS VARCHAR) AS well_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, arg_max(value, (ts, event_id)) AS value,
       arg_max(k, (ts, event_id)) AS k FROM readings GROUP BY user_id""",
)
def latest_readings(spark: SparkSession, folder: str) -> DataFrame:
    renamed = readings(spark, folder).select(
        F.col("user_id").cast("string").alias("well_id"), F.col("ts").alias("timestamp"), "event_id", "value", "k"
    )
    latest = wt.latest_reading(renamed, ["timestamp", "event_id"], ["value", "k"])
    return latest.select("well_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"), "value", "k")


@query(
    "readings_as_of",
    f"""WITH {READINGS_SQL},
asked AS (SELECT o_orderkey AS alert_id, o_custkey % (SELECT max(user_id) + 1 FROM readings) AS user_id,
                 TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * (o_orderkey * 37 % 2592000) AS at FROM orders),
j AS (SELECT a.alert_id, r.event_id, row_number() OVER (PARTITION BY a.alert_id ORDER BY r.ts DESC, r.event_id DESC) AS back
      FROM asked a LEFT JOIN readings r ON r.user_id = a.user_id AND r.ts <= a.at)
SELECT alert_id, event_id FROM j WHERE back = 1""",
)
def readings_as_of(spark: SparkSession, folder: str) -> DataFrame:
    users = readings(spark, folder).agg((F.max("user_id") + 1).alias("users"))
    asked = table(spark, folder, "orders").withColumn("users", users.scalar()).select(
        F.col("o_orderkey").alias("alert_id"),
        (F.col("o_custkey") % F.col("users")).alias("user_id"),
        F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.col("o_orderkey") * 37 % 2592000).alias("timestamp"),
    )
    found = wt.reading_as_of(asked, readings(spark, folder), ["ts", "event_id"], [], "user_id")
    return found.select("alert_id", F.col("as_of.event_id").alias("event_id"))


@query(
    "well_status_texts",
    f"""WITH {READINGS_SQL},
latest AS (SELECT user_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value, arg_max(k, (ts, event_id)) AS k FROM readings GROUP BY 1),
c AS (SELECT user_id, CASE WHEN value > 30 THEN 'HIGH' ELSE 'LOW' END AS severity, count(*) AS n FROM readings
      WHERE event_type = 'error' AND ts > (SELECT max(ts) FROM readings) - INTERVAL 7 DAY GROUP BY 1, 2),
t AS (SELECT user_id, string_agg(n || ' ' || severity, ', ' ORDER BY severity) AS parts FROM c GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS well_id, 'Well ' || user_id || ' last reading at ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ': oil=' || value || ' BOPD, WC=' || k
  || '%, GOR=N/A scf/bbl, BHP=N/A psi.' || coalesce(' Recent alerts (7d): ' || parts || '.', '') AS summary_text
FROM latest LEFT JOIN t USING (user_id)""",
)
def well_status_texts(spark: SparkSession, folder: str) -> DataFrame:
    source = readings(spark, folder).select(
        F.col("user_id").cast("string").alias("well_id"), F.col("ts").alias("timestamp"), "event_id", "event_type",
        F.col("value").alias("oil_rate_bopd"), F.col("k").alias("water_cut_pct"),
        F.lit(None).cast("double").alias("gas_oil_ratio"), F.lit(None).cast("double").alias("bhp_psi"),
    )
    columns = ["oil_rate_bopd", "water_cut_pct", "gas_oil_ratio", "bhp_psi"]
    newest = source.agg(F.max("timestamp").alias("now"))
    alerts = (
        source.filter("event_type = 'error'")
        .withColumn("severity", F.when(F.col("oil_rate_bopd") > 30, "HIGH").otherwise("LOW"))
        .withColumn("now", newest.scalar())
    )
    counts = wt.recent_alert_counts(alerts, F.col("now"))
    latest = wt.latest_reading(source, ["timestamp", "event_id"], columns)
    return wt.well_status(latest, counts).select("well_id", "summary_text")

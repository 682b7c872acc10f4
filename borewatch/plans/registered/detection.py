"""Windows, detectors and forests over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borewatch.functions import severity as sev
from borewatch.operators import cusum, detect, forest, rolling
from borewatch.operators.ordering import POS, KeyedSeries
from borewatch.plans.catalogue import query
from borewatch.plans.roles import (
    EVENT_ORDER,
    READINGS_SQL,
    TELEMETRY_ORDER,
    TELEMETRY_SQL,
    readings,
    settled_sql,
    telemetry,
)
from borewatch.schema import FEATURES
from borewatch.session import cut_lineage, ensure_checkpoint_dir

PAIR = ["value", "k"]


def _events(spark: SparkSession, folder: str, halo: int = 0) -> KeyedSeries:
    return KeyedSeries.build(readings(spark, folder), ["user_id"], EVENT_ORDER, halo)


def _wells(spark: SparkSession, folder: str, halo: int = 0) -> KeyedSeries:
    return KeyedSeries.build(telemetry(spark, folder), ["well_id"], TELEMETRY_ORDER, halo)


def _rounded(names: list[str], digits: int = 6) -> list:
    return [F.round(n, digits).alias(n) for n in names]


def z_sql(features: list[str], key: str, order: str, n: int, version: int, source: str) -> str:
    """CTE `z`: ordinals, moments over the n rows before, and scores."""
    frame = f"(PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    moments = ", ".join(f"avg({f}) OVER {frame} AS mu_{f}, stddev_samp({f}) OVER {frame} AS sd_{f}" for f in features)
    flat = "CASE WHEN abs({f} - mu_{f}) < 1e-6 THEN 0.0 ELSE 12.0 END" if version == 1 else "0.0"
    scores = ", ".join(
        f"CASE WHEN pos <= {n} THEN 0.0 WHEN sd_{f} > 1e-9 THEN abs({f} - mu_{f}) / sd_{f} "
        f"ELSE {flat.format(f=f)} END AS z_{f}"
        for f in features
    )
    return (
        f"m AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS pos, {moments} FROM {source}), "
        f"z AS MATERIALIZED (SELECT *, {scores} FROM m)"
    )


_EVENT_Z2 = z_sql(PAIR, "user_id", "ts, event_id", 30, 2, "readings")
_WELL_ORDER = '"timestamp", reading_id'


@query(
    "drift_alerts",
    f"""WITH {READINGS_SQL}, {_EVENT_Z2},
p AS (SELECT *, sum(z_value - 0.5) OVER w AS p_value FROM z WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
c AS (SELECT *, p_value - least(0.0, min(p_value) OVER (PARTITION BY user_id ORDER BY pos)) AS cusum FROM p)
SELECT event_id, user_id, pos, round(z_value, 6) AS z_value, round(z_k, 6) AS z_k, round(cusum, 6) AS cusum,
       z_value >= 3 OR z_k >= 3 AS step_triggered, cusum > 4 AS drift_triggered,
       CASE WHEN greatest(greatest(z_value, z_k) / 3, cusum / 8) >= 0.9 THEN 'CRITICAL'
            WHEN greatest(greatest(z_value, z_k) / 3, cusum / 8) >= 0.65 THEN 'HIGH'
            WHEN greatest(greatest(z_value, z_k) / 3, cusum / 8) >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM c WHERE z_value >= 3 OR z_k >= 3 OR cusum > 4""",
)
def drift_alerts(spark: SparkSession, folder: str) -> DataFrame:
    scored = rolling.rolling_z(_events(spark, folder, 30), PAIR, 2)
    charted = cusum.cusum_chart(scored, "z_value", "cusum").rows()
    step = (F.col("z_value") >= 3) | (F.col("z_k") >= 3)
    drift = F.col("cusum") > cusum.DECISION
    largest = F.greatest("z_value", "z_k")
    return charted.filter(step | drift).select(
        "event_id",
        "user_id",
        F.col(POS).alias("pos"),
        *_rounded(["z_value", "z_k", "cusum"]),
        step.alias("step_triggered"),
        drift.alias("drift_triggered"),
        sev.severity_v2(largest, F.lit(0.0), F.col("cusum"), F.lit(3.0)).alias("severity"),
    )


@query(
    "rolling_z_v1",
    f"""WITH {TELEMETRY_SQL}, {z_sql(FEATURES, "well_id", _WELL_ORDER, 24, 1, "telemetry")}
SELECT well_id, reading_id, pos, {", ".join(f"round(z_{f}, 6) AS z_{f}" for f in FEATURES)} FROM z""",
)
def rolling_z_v1(spark: SparkSession, folder: str) -> DataFrame:
    scored = rolling.rolling_z(_wells(spark, folder, 24), FEATURES, 1).rows()
    return scored.select("well_id", "reading_id", F.col(POS).alias("pos"), *_rounded([f"z_{f}" for f in FEATURES]))


@query(
    "rolling_z_v2",
    f"""WITH {READINGS_SQL}, {_EVENT_Z2}
SELECT event_id, user_id, pos, round(z_value, 6) AS z_value, round(z_k, 6) AS z_k FROM z""",
)
def rolling_z_v2(spark: SparkSession, folder: str) -> DataFrame:
    scored = rolling.rolling_z(_events(spark, folder, 30), PAIR, 2).rows()
    return scored.select("event_id", "user_id", F.col(POS).alias("pos"), *_rounded(["z_value", "z_k"]))


@query(
    "trailing_baselines",
    f"""WITH {READINGS_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM readings)
SELECT event_id,
  round(coalesce(CASE WHEN pos > 25 THEN avg(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 23 PRECEDING AND 1 PRECEDING)
       ELSE avg(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) END, value), 6) AS base_v1,
  round(coalesce(avg(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 31 PRECEDING AND 2 PRECEDING), value), 6) AS base_v2
FROM o""",
)
def trailing_baselines(spark: SparkSession, folder: str) -> DataFrame:
    series = rolling.baseline_v1(_events(spark, folder, 32), ["value"])
    series = series.transform(lambda df: df.withColumnRenamed("base_value", "base_v1"))
    both = rolling.baseline_v2(series, ["value"]).rows()
    return both.select(
        "event_id", F.round("base_v1", 6).alias("base_v1"), F.round("base_value", 6).alias("base_v2")
    )


@query(
    "two_sided_cusum",
    f"""WITH {READINGS_SQL},
m AS (SELECT *, row_number() OVER w AS pos, avg(value) OVER f AS mu, stddev_samp(value) OVER f AS sd FROM readings
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
             f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, CASE WHEN pos > 30 AND sd > 1e-9 THEN (value - mu) / sd ELSE 0.0 END AS z FROM m),
p AS (SELECT *, sum(z - 0.5) OVER w AS pu, sum(-z - 0.5) OVER w AS pd FROM z WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT event_id, round(pu - least(0.0, min(pu) OVER w), 6) AS s_pos, round(pd - least(0.0, min(pd) OVER w), 6) AS s_neg
FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos)""",
)
def two_sided_cusum(spark: SparkSession, folder: str) -> DataFrame:
    series = _events(spark, folder, 30)
    before = series.trailing(-30, -1)
    mean, deviation = F.avg("value").over(before), F.stddev_samp("value").over(before)
    signed = series.transform(
        lambda df: df.withColumn("_mu", mean).withColumn("_sd", deviation).withColumn(
            "z",
            F.when((F.col(POS) > 30) & (F.col("_sd") > rolling.FLAT_SIGMA), (F.col("value") - F.col("_mu")) / F.col("_sd"))
            .otherwise(F.lit(0.0)),
        )
    )
    return cusum.two_sided_cusum(signed, "z", "s_pos", "s_neg").rows().select("event_id", *_rounded(["s_pos", "s_neg"]))


@query(
    "persistence_streaks",
    f"""WITH {READINGS_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, value > 20 AS flag FROM readings),
g AS (SELECT *, coalesce(max(CASE WHEN NOT flag THEN pos END) OVER (PARTITION BY user_id ORDER BY pos), 0) AS clear FROM o)
SELECT event_id, user_id, CAST(CASE WHEN flag THEN pos - clear ELSE 0 END AS BIGINT) AS streak FROM g""",
)
def persistence_streaks(spark: SparkSession, folder: str) -> DataFrame:
    streaks = cusum.with_streaks(_events(spark, folder, 1), F.col("value") > 20)
    return streaks.rows().select("event_id", "user_id", "streak")


@query(
    "alert_bursts",
    f"""WITH {READINGS_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM readings),
d AS (SELECT user_id, pos, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS island FROM o WHERE value > 20)
SELECT user_id, min(pos) AS burst_start, max(pos) + 1 AS burst_end, count(*) AS "rows" FROM d GROUP BY user_id, island""",
)
def alert_bursts(spark: SparkSession, folder: str) -> DataFrame:
    return cusum.bursts(_events(spark, folder, 1), F.col("value") > 20)


@query(
    "telemetry_gaps",
    f"""WITH {READINGS_SQL},
l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM readings),
g AS (SELECT *, (epoch_us(ts) - epoch_us(prev)) / 3600e6 AS h FROM l WHERE (epoch_us(ts) - epoch_us(prev)) / 3600e6 > 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY prev, ts) AS gap_no FROM g)
SELECT user_id, CAST(gap_no AS INTEGER) AS gap_no, strftime(prev, '%Y-%m-%d %H:%M:%S') AS gap_from,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS gap_to, round_even(h * 10, 0) / 10 AS duration_hours
FROM r WHERE gap_no <= 10""",
)
def telemetry_gaps(spark: SparkSession, folder: str) -> DataFrame:
    gaps = rolling.find_gaps(_events(spark, folder, 1), "ts")
    return gaps.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("gap_from", "gap_to")})


def calibration_sql(features: list[str], source: str = "telemetry", last: str = "n") -> str:
    frame = f"(PARTITION BY well_id ORDER BY {_WELL_ORDER} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"
    moments = ", ".join(f"avg({f}) OVER {frame} AS mu_{f}, stddev_pop({f}) OVER {frame} AS sd_{f}" for f in features)
    zs = {f: f"CASE WHEN sd_{f} > 1e-6 THEN abs({f} - mu_{f}) / sd_{f} END" for f in features}
    thresholds = ", ".join(
        f"CASE WHEN count({z}) >= 20 THEN least(greatest(quantile_cont({z}, 0.95), 2.5), 6.0) ELSE 3.0 END AS threshold_{f}"
        for f, z in zs.items()
    )
    return (
        f"cm AS (SELECT *, {moments} FROM {source}), "
        f"thresholds AS MATERIALIZED (SELECT well_id, {thresholds} FROM cm "
        f"WHERE pos > greatest({last} - 500, 0) + 30 AND pos <= {last} GROUP BY well_id)"
    )


_ORDINAL_SQL = f"""ordinal AS (
  SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY {_WELL_ORDER}) AS pos,
         count(*) OVER (PARTITION BY well_id) AS n FROM telemetry)"""


@query(
    "calibrated_thresholds",
    f"""WITH {TELEMETRY_SQL}, {_ORDINAL_SQL}, {calibration_sql(FEATURES, "ordinal")}
SELECT well_id, {", ".join(f"round(threshold_{f}, 6) AS threshold_{f}" for f in FEATURES)} FROM thresholds""",
)
def calibrated_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    names = [f"threshold_{f}" for f in FEATURES]
    return detect.calibrate(_wells(spark, folder, 30), FEATURES).select("well_id", *_rounded(names))


def _flat_alerts(alerts: DataFrame) -> DataFrame:
    """Alert rows with arrays and maps as text."""

    def text(column: str) -> F.Column:
        pairs = F.transform(F.map_entries(column), lambda e: F.format_string("%s=%.1f", e["key"], e["value"]))
        return F.array_join(pairs, ",")

    return alerts.withColumns(
        {
            "affected_features": F.array_join("affected_features", ","),
            "deviation_pct": text("deviation_pct"),
            "alert_id": F.col("alert_id"),
        }
    )


def _deviation_sql(condition: str, base: str, skip_zero: bool) -> str:
    parts = []
    for f in FEATURES:
        scale = f"abs(base_{f})" if skip_zero else f"greatest(abs(base_{f}), 1e-6)"
        keep = f" AND base_{f} <> 0" if skip_zero else ""
        number = settled_sql(f"100 * ({f} - base_{f}) / {scale}", 1)
        parts.append(f"CASE WHEN {condition.format(f=f)}{keep} THEN printf('%s=%.1f', '{f}', {number}) END")
    return f"coalesce(concat_ws(',', {', '.join(parts)}), '')"


def _affected_sql(condition: str) -> str:
    parts = ", ".join(f"CASE WHEN {condition.format(f=f)} THEN '{f}' END" for f in FEATURES)
    return f"coalesce(concat_ws(',', {parts}), '')"


def _greatest(prefix: str) -> str:
    return "greatest(" + ", ".join(f"{prefix}_{f}" for f in FEATURES) + ")"


def _base_v1_sql() -> str:
    def mean(f: str, rows: int) -> str:
        return f"avg({f}) OVER (PARTITION BY well_id ORDER BY pos ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"

    return ", ".join(
        f"coalesce(CASE WHEN pos > 25 THEN {mean(f, 23)} ELSE {mean(f, 24)} END, {f}) AS base_{f}" for f in FEATURES
    )


@query(
    "detect_v1_statistical",
    f"""WITH {TELEMETRY_SQL}, {z_sql(FEATURES, "well_id", _WELL_ORDER, 24, 1, "telemetry")},
b AS (SELECT *, {_greatest("z")} AS max_z, {_base_v1_sql()} FROM z)
SELECT well_id, pos AS ordinal, reading_id,
       CASE WHEN max_z / 6 >= 0.85 OR max_z >= 5 THEN 'CRITICAL' WHEN max_z / 6 >= 0.65 OR max_z >= 3.5 THEN 'HIGH'
            WHEN max_z / 6 >= 0.45 OR max_z >= 2.5 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       round_even(least(1.0, max_z / 6) * 10000, 0) / 10000 AS anomaly_score,
       {_affected_sql("z_{f} >= 2")} AS affected_features, {_deviation_sql("z_{f} >= 2", "base", True)} AS deviation_pct
FROM b WHERE max_z >= 2""",
)
def detect_v1_statistical(spark: SparkSession, folder: str) -> DataFrame:
    series = detect.v1_series(telemetry(spark, folder), order=TELEMETRY_ORDER, use_forest=False)
    diagnosed = detect.diagnose_v1(series, use_forest=False)
    flat = _flat_alerts(detect.alerts_v1(diagnosed, extra=("reading_id",)))
    return flat.select(
        "well_id", "ordinal", "reading_id", "severity", "anomaly_score", "affected_features", "deviation_pct"
    )


@query("detect_v1_forest")
def detect_v1_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Random trees are checked by ranking quality in the tests, not by SQL."""
    alerts = detect.detect_v1(telemetry(spark, folder), order=TELEMETRY_ORDER)
    return _flat_alerts(alerts).select(
        "alert_id", "well_id", "ordinal", "severity", "anomaly_score", "affected_features", "description"
    )


def fold_sql(source: str, key: str, features: list[str]) -> str:
    """Recursive CTE `fold` over `source` (key, pos, z_<f>, raw_flag), one row per reading."""
    new = ", ".join(f"greatest(0.0, f.s_{f} + z.z_{f} - 0.5) AS n_{f}" for f in features)
    keep = ", ".join(f"CASE WHEN alert THEN 0.0 ELSE n_{f} END, n_{f}" for f in features)
    names = ", ".join(f"s_{f}, c_{f}" for f in features)
    zeros = ", ".join("CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)" for _ in features)
    top = "greatest(" + ", ".join(f"n_{f}" for f in features) + ")" if len(features) > 1 else f"n_{features[0]}"
    carried = ", ".join(f"n_{f}" for f in features)
    return f"""fold({key}, pos, {names}, streak, silent, alert, drift) AS (
  SELECT {key}, min(pos) - 1, {zeros}, 0, 0, false, false FROM {source} GROUP BY {key}
  UNION ALL
  SELECT {key}, pos, {keep}, CASE WHEN alert THEN 0 ELSE streak END,
         CASE WHEN alert THEN 7 WHEN was_silent THEN silent - 1 ELSE 0 END, alert, drift
  FROM (SELECT *, NOT was_silent AND streak >= 2 AS alert
        FROM (SELECT {key}, pos, {carried}, silent, silent > 0 AS was_silent, {top} > 4 AS drift,
                     CASE WHEN silent > 0 THEN 0 WHEN raw_flag OR {top} > 4 THEN streak + 1 ELSE 0 END AS streak
              FROM (SELECT z.{key}, z.pos, {new}, f.silent, f.streak, z.raw_flag
                    FROM fold f JOIN {source} z ON z.{key} = f.{key} AND z.pos = f.pos + 1))))"""


_BASE_V2_SQL = ", ".join(
    f"coalesce(avg({f}) OVER (PARTITION BY well_id ORDER BY pos ROWS BETWEEN 31 PRECEDING AND 2 PRECEDING), {f}) AS base_{f}"
    for f in FEATURES
)


def _alerts_v2_sql() -> str:
    combined = f"greatest({_greatest('z')} / threshold_oil_rate_bopd, {_greatest('c')} / 8)"
    loss = "greatest(0.0, base_oil_rate_bopd - oil_rate_bopd)"
    water = (
        "greatest(0.0, water_cut_pct - base_water_cut_pct) / 100 * "
        "(base_oil_rate_bopd / greatest(0.01, 1 - base_water_cut_pct / 100))"
    )
    return f"""SELECT well_id, pos AS ordinal, reading_id,
  CASE WHEN {combined} >= 0.9 THEN 'CRITICAL' WHEN {combined} >= 0.65 THEN 'HIGH' WHEN {combined} >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN z_water_cut_pct > 2.5 AND water_cut_pct > 40 THEN 'water_breakthrough' WHEN z_gas_oil_ratio > 2.5 THEN 'gor_spike'
       WHEN z_bhp_psi > 2.5 AND bhp_psi < 2500 THEN 'bhp_depletion' WHEN z_wh_temp_f > 3 THEN 'thermal_excursion'
       ELSE 'multi_feature_correlated' END AS anomaly_type,
  round_even(least(1.0, {_greatest('z')} / {_greatest('threshold')}) * 10000, 0) / 10000 AS anomaly_score,
  {_affected_sql("z_{f} >= threshold_{f} * 0.8")} AS affected_features,
  {_deviation_sql("z_{f} >= threshold_{f} * 0.8", "base", False)} AS deviation_pct,
  drift AS cusum_triggered, step AS step_change_triggered, 2 AS consecutive_days,
  {settled_sql(f"{loss} * 80 + {water} * 4.5", 2)} AS revenue_at_risk_usd_per_day,
  {settled_sql(loss, 1)} AS oil_loss_bopd, {settled_sql(water, 1)} AS water_excess_bbl_per_day
FROM fold JOIN live USING (well_id, pos) WHERE alert"""


def v2_sql(train: bool) -> str:
    zs = z_sql(FEATURES, "well_id", _WELL_ORDER, 30, 2, "telemetry")
    step = " OR ".join(f"z_{f} >= threshold_{f}" for f in FEATURES)
    if train:
        marked = "marked AS (SELECT *, CAST(floor(n * 0.7) AS BIGINT) AS train_rows FROM ordinal)"
        source = f"{_ORDINAL_SQL}, {marked}, {calibration_sql(FEATURES, 'marked', 'train_rows')}, "
        threshold_join = "JOIN thresholds USING (well_id)"
        columns = ", ".join(f"threshold_{f}" for f in FEATURES)
        where = "WHERE pos > floor(n * 0.7)"
    else:
        source, threshold_join, where = "", "", ""
        columns = ", ".join(f"3.0::DOUBLE AS threshold_{f}" for f in FEATURES)
    return f"""WITH RECURSIVE {TELEMETRY_SQL}, {source}{zs},
live AS MATERIALIZED (SELECT *, {step} AS step, {step} AS raw_flag FROM (
  SELECT z.*, {columns}, {_BASE_V2_SQL}, count(*) OVER (PARTITION BY well_id) AS n FROM z {threshold_join}) {where}),
{fold_sql("live", "well_id", FEATURES)}
{_alerts_v2_sql()}"""


def flat_v2(alerts: DataFrame) -> DataFrame:
    return (
        _flat_alerts(alerts)
        .withColumn("revenue_at_risk_usd_per_day", F.col("economic_impact.revenue_at_risk_usd_per_day"))
        .withColumn("oil_loss_bopd", F.col("economic_impact.oil_loss_bopd"))
        .withColumn("water_excess_bbl_per_day", F.col("economic_impact.water_excess_bbl_per_day"))
        .select(
            "well_id", "ordinal", "reading_id", "severity", "anomaly_type", "anomaly_score", "affected_features",
            "deviation_pct", "cusum_triggered", "step_change_triggered", "consecutive_days",
            "revenue_at_risk_usd_per_day", "oil_loss_bopd", "water_excess_bbl_per_day",
        )
    )


def with_train_mark(series: KeyedSeries, share: float = 0.7, train_rows: str | None = None) -> KeyedSeries:
    """Mark the leading share of each key's rows as training rows; `train_rows` names a column for their number."""
    sizes = series.rows().groupBy(*series.keys).agg(F.floor(F.count(F.lit(1)) * share).alias("_cut"))
    return series.transform(
        lambda df: df.join(sizes, series.keys).withColumn("is_train", F.col(POS) <= F.col("_cut"))
        .withColumnsRenamed({"_cut": train_rows} if train_rows else {}).drop("_cut")
    )


def v2_series(spark: SparkSession, folder: str, halo: int, block_rows: int = detect.FOLD_BLOCK_ROWS) -> KeyedSeries:
    return KeyedSeries.build(telemetry(spark, folder), ["well_id"], TELEMETRY_ORDER, halo, block_rows)


@query("detect_v2_cold", v2_sql(train=False))
def detect_v2_cold(spark: SparkSession, folder: str) -> DataFrame:
    folded = detect.fold_series_v2(v2_series(spark, folder, 32))
    return flat_v2(detect.alerts_v2(folded, extra=("reading_id",)))


@query("detect_v2_trained", v2_sql(train=True))
def detect_v2_trained(spark: SparkSession, folder: str) -> DataFrame:
    series = with_train_mark(v2_series(spark, folder, 32), train_rows="train_rows")
    folded = detect.fold_series_v2(series, is_train="is_train", use_forest=False, train_rows="train_rows")
    return flat_v2(detect.alerts_v2(folded, extra=("reading_id",)))


@query("detect_v2_forest")
def detect_v2_forest(spark: SparkSession, folder: str) -> DataFrame:
    series = with_train_mark(v2_series(spark, folder, 560, detect.FOREST_BLOCK_ROWS), train_rows="train_rows")
    alerts = detect.alerts_v2(detect.fold_series_v2(series, is_train="is_train", train_rows="train_rows"))
    return _flat_alerts(alerts).select(
        "alert_id", "well_id", "ordinal", "severity", "anomaly_type", "anomaly_score", "affected_features", "description"
    )


@query(
    "scored_readings",
    f"""WITH RECURSIVE {TELEMETRY_SQL}, {z_sql(FEATURES, "well_id", _WELL_ORDER, 30, 2, "telemetry")},
live AS MATERIALIZED (SELECT *, {_greatest("z")} >= 3 AS raw_flag FROM z),
{fold_sql("live", "well_id", FEATURES)}
SELECT live.well_id, live.pos AS ordinal, alert AS is_anomaly,
       CASE WHEN alert THEN round_even(least(1.0, {_greatest('z')} / 3) * 10000, 0) / 10000 ELSE 0.0 END AS anomaly_score,
       CASE WHEN alert THEN 2 ELSE 0 END AS consecutive_days, alert AND drift AS cusum_triggered
FROM fold JOIN live USING (well_id, pos)""",
)
def scored_readings(spark: SparkSession, folder: str) -> DataFrame:
    series = v2_series(spark, folder, 32)
    alerts = detect.alerts_v2(detect.fold_series_v2(series))
    every = series.rows().select("well_id", F.col(POS).alias("ordinal"))
    return detect.predict(every, alerts, ["well_id", "ordinal"]).select(
        "well_id", "ordinal", "is_anomaly", "anomaly_score", "consecutive_days", "cusum_triggered"
    )


def stored_training(spark: SparkSession, folder: str, forests: bool) -> tuple[KeyedSeries, DataFrame, DataFrame | None]:
    """Readings with their training mark, and the thresholds and forests of the training rows, stored and read back."""
    base = f"{ensure_checkpoint_dir(spark)}/models/{uuid.uuid4().hex}"
    series = with_train_mark(v2_series(spark, folder, 32))
    trained = KeyedSeries.build(series.rows(keep_position=False).filter("is_train"), ["well_id"], TELEMETRY_ORDER, 32)
    detect.calibrate(trained).write.parquet(f"{base}/thresholds")
    thresholds = spark.read.parquet(f"{base}/thresholds")
    if not forests:
        return series, thresholds, None
    models = forest.fit_models(trained, FEATURES, forest.V2_FOREST)
    # a reader takes thousands of rows of a file at a time, whatever their size
    models.write.option("maxRecordsPerFile", forest.MODELS_A_FILE).parquet(f"{base}/forests")
    return series, thresholds, spark.read.parquet(f"{base}/forests")


@query(
    "scored_readings_trained",
    v2_sql(train=True).rsplit(_alerts_v2_sql(), 1)[0]
    + f"""SELECT r.well_id, r.pos AS ordinal, a.pos IS NOT NULL AS is_anomaly,
  CASE WHEN a.pos IS NOT NULL THEN round_even(least(1.0, {_greatest('z')} / {_greatest('threshold')}) * 10000, 0) / 10000 ELSE 0.0 END AS anomaly_score,
  CASE WHEN a.pos IS NOT NULL THEN 2 ELSE 0 END AS consecutive_days, a.pos IS NOT NULL AND a.drift AS cusum_triggered
FROM (SELECT well_id, pos FROM z) r LEFT JOIN (SELECT * FROM fold JOIN live USING (well_id, pos) WHERE alert) a USING (well_id, pos)""",
)
def scored_readings_trained(spark: SparkSession, folder: str) -> DataFrame:
    """Every reading scored with stored thresholds; training readings raise no alerts."""
    series, thresholds, _ = stored_training(spark, folder, False)
    alerts = detect.alerts_v2(detect.fold_series_v2(series, is_train="is_train", thresholds=thresholds))
    every = series.rows().select("well_id", F.col(POS).alias("ordinal"))
    return detect.predict(every, alerts, ["well_id", "ordinal"]).select(
        "well_id", "ordinal", "is_anomaly", "anomaly_score", "consecutive_days", "cusum_triggered"
    )


@query(
    "forest_ranking",
    f"""WITH {TELEMETRY_SQL}, {_ORDINAL_SQL}, t AS (SELECT well_id, n, floor(n * 0.7) AS cut, pos, reading_id % 9 = 0 AS planted FROM ordinal)
SELECT well_id, count(*) AS live, count(*) FILTER (WHERE planted) AS planted, count(*) FILTER (WHERE planted) AS planted_first
FROM t WHERE pos > cut AND cut >= 90 GROUP BY well_id""",
)
def forest_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Ranking quality of stored forests: readings planted far outside the training range behind it, and how many of them
    the forest of their well puts before all others."""
    series, _, models = stored_training(spark, folder, True)
    tops = series.rows().filter("is_train").groupBy("well_id").agg(
        F.count(F.lit(1)).alias("trained"), *[F.max(f).alias(f"top_{f}") for f in FEATURES]
    )
    live = series.rows().filter("not is_train").join(tops.filter("trained >= 90"), "well_id")
    planted = F.col("reading_id") % 9 == 0
    live = live.withColumn("planted", planted).withColumns(
        {f: F.when(planted, 4 * F.col(f"top_{f}") + 100).otherwise(F.least(F.col(f), F.col(f"top_{f}"))) for f in FEATURES}
    ).select("well_id", POS, "planted", *FEATURES)
    scored = forest.score_stored(live, models, ["well_id"], POS, FEATURES, forest.V2_FOREST)
    # read twice: no reading goes down its trees again
    scored = cut_lineage(scored.select("well_id", "planted", "if_score"))
    others = scored.groupBy("well_id").agg(F.max(F.when(~F.col("planted"), F.col("if_score"))).alias("_most"))
    first = F.col("planted") & (F.col("if_score") > F.coalesce("_most", F.lit(-1.0)))
    return scored.join(others, "well_id").groupBy("well_id").agg(
        F.count(F.lit(1)).alias("live"), F.count_if("planted").alias("planted"), F.count_if(first).alias("planted_first")
    )

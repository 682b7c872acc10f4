"""The two detectors over a table of readings.

Everything that depends on input rows only (Z-scores, forest scores, baselines, thresholds) is
window or grouped work.  Version 1 has no feedback and needs nothing else.  In version 2 an
alert resets the drift sums and starts a silent period; `rearm` turns that into a chain of
successors over the Z-scores and flags and returns alert positions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borewatch.functions import severity as sev
from borewatch.functions.economics import OIL_PRICE, economic_impact
from borewatch.operators import forest as iforest
from borewatch.operators.cusum import DECISION, SLACK
from borewatch.operators.ordering import DEFAULT_BLOCK_ROWS, HALO, POS, KeyedSeries, join_null_safe
from borewatch.operators.passes import Batches, doubles, whole_groups
from borewatch.operators.rearm import Rule, alerts_of, rearming_alerts
from borewatch.operators.rolling import V1_WINDOW, V2_WINDOW, Frame, baseline_v1, moments, scores_and_baselines
from borewatch.schema import FEATURES
from borewatch.session import cut_lineage

# Rows of one key a Python task handles at a time when forests are grown.
FOREST_BLOCK_ROWS = 50_000
# Rows of one key the fold handles at a time.
FOLD_BLOCK_ROWS = 250_000

CALIBRATION_ROWS = 500
REFRACTORY_ROWS = 7


def v1_series(
    df: DataFrame,
    key: str = "well_id",
    order: list[str] | None = None,
    use_forest: bool = True,
    block_rows: int | None = None,
) -> KeyedSeries:
    """Readings in blocks with the halo version 1 needs."""
    halo = 168 + 72 if use_forest else V1_WINDOW
    rows = block_rows or (FOREST_BLOCK_ROWS if use_forest else DEFAULT_BLOCK_ROWS)
    return KeyedSeries.build(df, [key], order or ["timestamp"], halo, rows)


def diagnose_v1(
    series: KeyedSeries,
    features: list[str] = FEATURES,
    use_forest: bool = True,
    retrain: Column | int = 72,
    history: Column | int = 168,
    scored: bool = False,
) -> KeyedSeries:
    """Add Z-scores (unless `scored`), baselines, forest score, max_z, and whether the reading is anomalous."""
    grown = None
    if use_forest:
        epochs = iforest.epochs_v1(retrain=retrain, history=history)
        series = series.transform(lambda df: df.withColumns(epochs))
        grown = iforest.forest_pass(series.keys, features, iforest.V1_FOREST)
    scored = baseline_v1(series, features, grown) if scored else scores_and_baselines(series, features, 1, first=grown)
    if not use_forest:
        scored = scored.transform(lambda df: df.withColumn("if_score", F.lit(0.0)))
    z = [F.col(f"z_{f}") for f in features]
    return scored.transform(
        lambda df: df.withColumn("max_z", sev.max_of(z)).withColumn(
            "is_anomaly", (F.col("max_z") >= sev.Z_LOW) | (F.col("if_score") >= sev.FOREST_FLOOR_V1)
        )
    )


def alerts_v1(
    diagnosed: KeyedSeries,
    features: list[str] = FEATURES,
    key: str = "well_id",
    ts: str = "timestamp",
    field: str = "field_name",
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Anomalous readings as alert rows (the ALERT schema plus the row ordinal and the columns named in `extra`)."""
    forest, max_z = F.col("if_score"), F.col("max_z")
    well = F.col(key).cast("string")
    staged = (
        diagnosed.rows()
        .filter("is_anomaly")
        .withColumn("severity", sev.severity_v1(max_z, forest))
        .withColumn("affected_features", sev.affected_v1(features))
        .withColumn("baseline_values", sev.rounded_map(features, F.col("affected_features"), "base_"))
        .withColumn("current_values", sev.rounded_map(features, F.col("affected_features")))
        .withColumn("deviation_pct", sev.deviation_v1(features, F.col("affected_features")))
    )
    field_name = F.col(field) if field in staged.columns else F.lit("Unknown")
    return staged.select(
        sev.alert_id(well, F.col(ts), "v1").alias("alert_id"),
        F.col(ts).alias("timestamp"),
        well.alias("well_id"),
        field_name.alias("field_name"),
        "severity",
        sev.round_tie_even(sev.score_v1(max_z, forest), 4).alias("anomaly_score"),
        "affected_features",
        "baseline_values",
        "current_values",
        "deviation_pct",
        sev.description_v1(
            well, F.col("severity"), F.col("affected_features"), F.col("deviation_pct"), F.col("current_values")
        ).alias("description"),
        F.col(POS).alias("ordinal"),
        *extra,
    )


def detect_v1(
    df: DataFrame,
    key: str = "well_id",
    ts: str = "timestamp",
    order: list[str] | None = None,
    features: list[str] = FEATURES,
    use_forest: bool = True,
    block_rows: int | None = None,
) -> DataFrame:
    """Readings -> version 1 alerts."""
    series = v1_series(df, key, order or [ts], use_forest, block_rows)
    return alerts_v1(diagnose_v1(series, features, use_forest), features, key, ts)


def calibrate(
    series: KeyedSeries,
    features: list[str] = FEATURES,
    train_rows: str | None = None,
    target_fpr: float = 0.05,
    window: int = V2_WINDOW,
    last_rows: int | None = CALIBRATION_ROWS,
) -> DataFrame:
    """Per key threshold_<feature>: a clipped quantile of the training Z-scores.

    Only the last 500 training rows count (`last_rows`, None: all of them), scored against the `window` rows before them
    with the population deviation.  Fewer than 20 scores leave the default of 3.
    """
    if train_rows is None:
        train_rows = "_last"
        ends = series.rows().groupBy(*series.keys).agg(F.max(POS).alias(train_rows))
        series = series.transform(lambda df: df.join(ends, series.keys))
    last = F.col(train_rows)
    first_scored = (F.greatest(last - last_rows, F.lit(0)) if last_rows else F.lit(0)) + window
    # the frames of the first scored rows begin `window` rows earlier
    needed = series.transform(lambda df: df.filter((F.col(POS) > first_scored - window) & (F.col(POS) <= last)))
    needed = needed.transform(lambda df: df.select(*dict.fromkeys([*series.group, POS, HALO, train_rows, *features])))
    moved = moments(needed, features, [Frame(-window, -1, "_mu", "_sd", sample=False)])
    scored = moved.rows().filter((F.col(POS) > first_scored) & (F.col(POS) <= last))
    z = {f: F.when(F.col(f"_sd_{f}") > 1e-6, F.abs(F.col(f) - F.col(f"_mu_{f}")) / F.col(f"_sd_{f}")) for f in features}
    scores = scored.select(*series.keys, *[z[f].alias(f"_z_{f}") for f in features])
    counts, quantiles = [f"_n_{f}" for f in features], [f"_q_{f}" for f in features]
    if series.split:
        told = scores.groupBy(*series.keys).agg(
            *[F.count(f"_z_{f}").alias(c) for f, c in zip(features, counts)],
            *[F.percentile(f"_z_{f}", 1.0 - target_fpr).alias(q) for f, q in zip(features, quantiles)],
        )
    else:
        told = _quantiles_in_order(scores, series.keys, [f"_z_{f}" for f in features], 1.0 - target_fpr, counts, quantiles)
    thresholds = []
    for f, count, quantile in zip(features, counts, quantiles):
        clipped = F.least(F.greatest(F.col(quantile), F.lit(sev.THRESHOLD_FLOOR)), F.lit(sev.THRESHOLD_CEILING))
        thresholds.append(F.when(F.col(count) >= 20, clipped).otherwise(F.lit(sev.DEFAULT_THRESHOLD)).alias(f"threshold_{f}"))
    return told.select(*series.keys, *thresholds)


def _quantiles_in_order(
    rows: DataFrame, keys: list[str], values: list[str], share: float, counts: list[str], quantiles: list[str]
) -> DataFrame:
    """Per key, whose rows follow each other, the number of values and their quantile, as `count` and `percentile` give them."""
    schema = T.StructType([rows.schema[k] for k in keys])
    for name in counts:
        schema.add(name, T.LongType())
    for name in quantiles:
        schema.add(name, T.DoubleType())

    def quantile(known: np.ndarray) -> float:
        place = (len(known) - 1) * share
        low, high = int(np.floor(place)), int(np.ceil(place))
        # NaN is the greatest
        a, b = np.partition(known, (low, high))[[low, high]]
        return float(a if a == b or low == high else (high - place) * a + (place - low) * b)

    def run(batches: Batches) -> Batches:
        for table, groups in whole_groups(batches, keys):
            columns = [table.column(v).combine_chunks() for v in values]
            there = [c.is_valid().to_numpy(zero_copy_only=False) for c in columns]
            known = [c.to_numpy(zero_copy_only=False) for c in columns]
            found = [[k[a:b][t[a:b]] for a, b in groups] for k, t in zip(known, there)]
            out = table.select(keys).take([a for a, _ in groups]).combine_chunks()
            for name, sets in zip(counts, found):
                out = out.append_column(name, pa.array([len(x) for x in sets], pa.int64()))
            for name, sets in zip(quantiles, found):
                out = out.append_column(name, pa.array([quantile(x) if len(x) else None for x in sets], pa.float64()))
            yield from out.to_batches()

    return rows.mapInArrow(run, schema)


def diagnose_v2(
    series: KeyedSeries,
    thresholds: DataFrame | None,
    features: list[str] = FEATURES,
    train_rows: str | None = None,
    use_forest: bool = True,
    retrain: int = 60,
    min_consecutive: int = 2,
    models: DataFrame | None = None,
) -> KeyedSeries:
    """Add Z-scores, baselines, thresholds, forest score and the two stateless trigger flags.

    With `models`, a table of stored forests (`forest.fit_models`), nothing is trained: readings are scored by these.
    """
    names = [f"threshold_{f}" for f in features]
    if thresholds is not None and not series.split:
        # before the rows are put in their order, which a join may change
        series = series.transform(lambda df: df.join(thresholds, series.keys, "left"))
    grown = None
    if models is None and use_forest and train_rows:
        epochs = iforest.epochs_v2(F.col(train_rows), retrain=retrain)
        series = series.transform(lambda df: df.withColumns(epochs))
        grown = iforest.forest_pass(series.keys, features, iforest.V2_FOREST)
    scored = scores_and_baselines(series, features, 2, min_consecutive, grown)
    if models is not None:
        scored = scored.transform(
            lambda df: iforest.score_stored(df, models, series.keys, POS, features, iforest.V2_FOREST)
        )
    elif grown is None:
        scored = scored.transform(lambda df: df.withColumn("if_score", F.lit(0.0)))
    if thresholds is not None and series.split:
        scored = scored.transform(lambda df: df.join(thresholds, series.keys, "left"))
    if thresholds is not None:
        defaults = {n: F.coalesce(F.col(n), F.lit(sev.DEFAULT_THRESHOLD)) for n in names}
    else:
        defaults = {n: F.lit(sev.DEFAULT_THRESHOLD) for n in names}
    step = sev.any_of([F.col(f"z_{f}") >= F.col(f"threshold_{f}") for f in features])
    return scored.transform(
        lambda df: df.withColumns(defaults)
        .withColumn("step_triggered", step)
        .withColumn("raw_flag", F.col("step_triggered") | (F.col("if_score") >= sev.FOREST_FLOOR_V2))
    )


def fold_v2(
    rows: DataFrame,
    keys: list[str],
    features: list[str],
    split: bool,
    min_consecutive: int = 2,
    refractory: int = REFRACTORY_ROWS,
    slack: float = SLACK,
    decision: float = DECISION,
) -> DataFrame:
    """Rows in order -> the rows that alert, with cusum_<feature>, cusum_triggered, consecutive_days.

    Drift sums move on every row; the silent period is checked before the streak; an alert
    resets both.  Only keys, positions, Z-scores and flags leave the JVM, and only alerts come back.
    """
    frozen = cut_lineage(rows)
    rule = Rule(min_consecutive, refractory, slack, decision)
    alerts = rearming_alerts(frozen, keys, features, split, rule)
    return join_null_safe(frozen, alerts, [*keys, POS]).withColumn("consecutive_days", F.lit(min_consecutive))


def fold_in_order(
    rows: DataFrame,
    keys: list[str],
    features: list[str],
    min_consecutive: int = 2,
    refractory: int = REFRACTORY_ROWS,
    slack: float = SLACK,
    decision: float = DECISION,
) -> DataFrame:
    """As `fold_v2`, for rows of whole keys that still stand in their order: only those that alert are stored."""
    rule = Rule(min_consecutive, refractory, slack, decision)
    names = [f"cusum_{f}" for f in features]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    schema.add("cusum_triggered", T.BooleanType())

    def run(batches: Batches) -> Batches:
        for table, groups in whole_groups(batches, keys):
            z = doubles(table, [f"z_{f}" for f in features])
            flags = table.column("raw_flag").fill_null(False).to_numpy().astype(bool)
            position = table.column(POS).to_numpy()
            found, sums = [], []
            for a, b in groups:
                if (np.diff(position[a:b]) <= 0).any():
                    raise ValueError("the rows of a key are not in their order")
                alerts, drift = alerts_of(z[a:b], flags[a:b], rule)
                found.append(a + alerts)
                sums.append(drift)
            kept, drift = np.concatenate(found), np.concatenate(sums)
            if not len(kept):
                continue
            out = table.take(kept)
            for i, name in enumerate(names):
                out = out.append_column(name, pa.array(drift[:, i]))
            out = out.append_column("cusum_triggered", pa.array(drift.max(axis=1) > decision))
            yield from out.combine_chunks().to_batches()

    return cut_lineage(rows.mapInArrow(run, schema).withColumn("consecutive_days", F.lit(min_consecutive)))


def fold_rows(
    scores: list[list[float]],
    flags: list[bool],
    start: list[float],
    min_consecutive: int = 2,
    refractory: int = REFRACTORY_ROWS,
    slack: float = SLACK,
    decision: float = DECISION,
) -> tuple[list[tuple[int, list[float], bool]], list[float]]:
    """One pass over the few rows of a well that a trigger brings; `start` holds the drift sums, streak and silent rows left."""
    sums, streak, silent = list(start[:-2]), int(start[-2]), int(start[-1])
    found = []
    for i, (row, flag) in enumerate(zip(scores, flags)):
        sums = [max(0.0, s + z - slack) for s, z in zip(sums, row)]
        drift = max(sums) > decision
        if silent > 0:
            silent, streak = silent - 1, 0
            continue
        streak = streak + 1 if flag or drift else 0
        if streak >= min_consecutive:
            found.append((i, sums, drift))
            sums, streak, silent = [0.0] * len(sums), 0, refractory
    return found, [*sums, float(streak), float(silent)]


def alerts_v2(
    folded: DataFrame,
    features: list[str] = FEATURES,
    key: str = "well_id",
    ts: str = "timestamp",
    field: str = "field_name",
    price: float = OIL_PRICE,
    fix_collapse: bool = False,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Alerting rows -> adaptive alert rows (the ADAPTIVE_ALERT schema plus the row ordinal and the columns in `extra`)."""
    max_z = sev.max_of([F.col(f"z_{f}") for f in features])
    drift = sev.max_of([F.col(f"cusum_{f}") for f in features])
    ceiling = sev.max_of([F.col(f"threshold_{f}") for f in features])
    oil_threshold = F.col("threshold_oil_rate_bopd") if "oil_rate_bopd" in features else F.lit(3.0)
    well = F.col(key).cast("string")
    affected = F.col("affected_features")

    def per_feature(prefix: str) -> Column:
        return F.create_map(*[c for f in features for c in (F.lit(f), F.col(f"{prefix}_{f}"))])

    staged = (
        folded.withColumn("severity", sev.severity_v2(max_z, F.col("if_score"), drift, oil_threshold))
        .withColumn("anomaly_type", sev.anomaly_type(fix_collapse))
        .withColumn("affected_features", sev.affected_v2(features))
        .withColumn("deviation_pct", sev.deviation_v2(features, affected))
        .withColumn("economic_impact", economic_impact(price))
    )
    field_name = F.col(field) if field in staged.columns else F.lit("VOLVE")
    return staged.select(
        sev.alert_id(well, F.col(ts), "v2").alias("alert_id"),
        F.col(ts).alias("timestamp"),
        well.alias("well_id"),
        field_name.alias("field_name"),
        "severity",
        sev.round_tie_even(sev.score_v2(max_z, F.col("if_score"), ceiling), 4).alias("anomaly_score"),
        affected,
        sev.rounded_map(features, affected, "base_").alias("baseline_values"),
        sev.rounded_map(features, affected).alias("current_values"),
        "deviation_pct",
        sev.description_v2(
            well, F.col("severity"), F.col("anomaly_type"), affected, F.col("deviation_pct"),
            F.col("cusum_triggered"), F.col("economic_impact.details"),
        ).alias("description"),
        "anomaly_type",
        "cusum_triggered",
        F.col("step_triggered").alias("step_change_triggered"),
        "consecutive_days",
        "economic_impact",
        per_feature("z").alias("per_feature_zscore"),
        per_feature("cusum").alias("per_feature_cusum"),
        F.col(POS).alias("ordinal"),
        *extra,
    )


def detect_v2(
    df: DataFrame,
    key: str = "well_id",
    ts: str = "timestamp",
    order: list[str] | None = None,
    features: list[str] = FEATURES,
    is_train: str | None = None,
    use_forest: bool = True,
    min_consecutive: int = 2,
    block_rows: int | None = None,
    price: float = OIL_PRICE,
    fix_collapse: bool = False,
) -> DataFrame:
    """Readings -> version 2 alerts.

    `is_train` names a boolean column true on the leading rows of a key that only warm up the
    detector: they calibrate the thresholds, train the forest and raise no alerts.  Without it
    the detector starts cold, with default thresholds and no forest.
    """
    with_forest = use_forest and is_train is not None
    halo = 500 + 60 if with_forest else V2_WINDOW + min_consecutive
    rows = block_rows or (FOREST_BLOCK_ROWS if with_forest else FOLD_BLOCK_ROWS)
    series = KeyedSeries.build(df, [key], order or [ts], halo, rows)
    return alerts_v2(
        fold_series_v2(series, features, is_train, use_forest, min_consecutive), features, key, ts,
        price=price, fix_collapse=fix_collapse,
    )


def fold_series_v2(
    series: KeyedSeries,
    features: list[str] = FEATURES,
    is_train: str | None = None,
    use_forest: bool = True,
    min_consecutive: int = 2,
    train_rows: str | None = None,
    thresholds: DataFrame | None = None,
    models: DataFrame | None = None,
) -> DataFrame:
    """Thresholds, diagnostics and fold over ordered readings; returns the alerting rows.

    `train_rows` names a column with the number of training rows of the key, if there is one.  Stored `thresholds`
    (keys and threshold_<feature>) and `models` take the place of calibration and training (D5).
    """
    if is_train is not None and thresholds is None:
        if train_rows is None:
            train_rows = "train_rows"
            # sizes, calibration and windows each read these rows
            series = series.transform(cut_lineage)
            sizes = series.rows().groupBy(*series.keys).agg(F.count_if(F.col(is_train)).alias(train_rows))
            series = series.transform(lambda df: df.join(sizes, series.keys))
        thresholds = calibrate(series, features, train_rows)
    diagnosed = diagnose_v2(
        series, thresholds, features, train_rows, use_forest, min_consecutive=min_consecutive, models=models
    )
    live = diagnosed.rows()
    if is_train is not None:
        live = live.filter(~F.col(is_train))
    if series.split or models is not None:
        return fold_v2(live, series.keys, features, series.split, min_consecutive)
    return fold_in_order(live, series.keys, features, min_consecutive)


def predict(df: DataFrame, alerts: DataFrame, keys: list[str]) -> DataFrame:
    """Every reading with the seven score columns; readings without an alert are "normal" (D5)."""
    scores = alerts.select(
        *keys,
        "anomaly_score",
        "anomaly_type",
        F.col("severity"),
        F.col("economic_impact.revenue_at_risk_usd_per_day").alias("economic_impact_usd"),
        "cusum_triggered",
        "consecutive_days",
        F.lit(True).alias("is_anomaly"),
    )
    return df.join(scores, keys, "left").fillna(
        {
            "anomaly_score": 0.0,
            "anomaly_type": "normal",
            "severity": "normal",
            "economic_impact_usd": 0.0,
            "cusum_triggered": False,
            "consecutive_days": 0,
            "is_anomaly": False,
        }
    )

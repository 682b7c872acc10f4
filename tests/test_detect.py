import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from borewatch.functions import severity as sev
from borewatch.operators import detect
from borewatch.operators.forest import V1_FOREST, V2_FOREST, fit_forest, fit_models, load_forest, score_stored
from borewatch.operators.ordering import POS, KeyedSeries
from borewatch.schema import FEATURES
from tests.series import BASE, START, cold_v2, noisy, z_scores


def constant_then(spark, **probe):
    rows = [(START + dt.timedelta(hours=i), "W", "Draugen", *BASE) for i in range(60)]
    last = dict(zip(FEATURES, BASE)) | probe
    rows.append((START + dt.timedelta(hours=60), "W", "Draugen", *last.values()))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["timestamp", "well_id", "field_name", *FEATURES]))


@pytest.mark.parametrize(
    "probe, feature, hint",
    [
        ({"water_cut_pct": 95.0, "oil_rate_bopd": 400.0}, "water_cut_pct", "water breakthrough"),
        ({"bhp_psi": 800.0, "oil_rate_bopd": 200.0}, "bhp_psi", "pump"),
    ],
)
def test_v1_flags_a_jump_out_of_a_constant_series(spark, probe, feature, hint):
    alerts = detect.detect_v1(constant_then(spark, **probe)).filter("ordinal = 61").collect()
    assert len(alerts) == 1
    assert alerts[0]["severity"] in ("HIGH", "CRITICAL")
    assert feature in alerts[0]["affected_features"]
    assert hint in alerts[0]["description"]
    assert 0 <= alerts[0]["anomaly_score"] <= 1


def test_v2_ignores_a_constant_series(spark):
    assert detect.detect_v2(constant_then(spark, water_cut_pct=95.0)).count() == 0


def test_v1_scores_equal_the_row_by_row_form(spark):
    frame = noisy(2, 120)
    diagnosed = detect.diagnose_v1(detect.v1_series(spark.createDataFrame(frame), use_forest=False), use_forest=False)
    got = diagnosed.rows().orderBy("well_id", POS).toPandas()
    for well, part in frame.groupby("well_id"):
        want = z_scores(part[FEATURES].to_numpy(), 24, 1)
        mine = got[got["well_id"] == well][[f"z_{f}" for f in FEATURES]].to_numpy()
        assert np.allclose(mine, want, atol=1e-8)


@pytest.mark.parametrize("block_rows", [None, 64])
def test_v2_fold_equals_the_row_by_row_form(spark, block_rows):
    """Also when wells are cut into blocks that start from guessed states."""
    frame = noisy(3, 400, shift_at=250)
    alerts = detect.detect_v2(spark.createDataFrame(frame), block_rows=block_rows).select("well_id", "ordinal").collect()
    for well, part in frame.groupby("well_id"):
        want = [i + 1 for i in cold_v2(part[FEATURES].to_numpy())]
        assert sorted(r["ordinal"] for r in alerts if r["well_id"] == well) == want
        assert want and min(np.diff(want)) >= 9  # silent rows and a fresh streak lie between


def test_blocks_do_not_change_trained_alerts(spark):
    frame = noisy(2, 700, shift_at=600)
    frame["is_train"] = frame.groupby("well_id").cumcount() < 400
    df = spark.createDataFrame(frame)
    columns = ["well_id", "ordinal", "severity", "anomaly_type", "anomaly_score", "description"]
    whole = detect.detect_v2(df, is_train="is_train").select(*columns).collect()
    cut = detect.detect_v2(df, is_train="is_train", block_rows=600).select(*columns).collect()
    assert sorted(whole) == sorted(cut) and whole
    assert min(r["ordinal"] for r in whole) > 400
    one = detect.detect_v1(df, block_rows=300).select(*columns[:3]).collect()
    assert sorted(one) == sorted(detect.detect_v1(df).select(*columns[:3]).collect())


def test_calibration_equals_numpy(spark):
    frame = noisy(1, 620)
    series = KeyedSeries.build(spark.createDataFrame(frame), ["well_id"], ["timestamp"], 30)
    got = detect.calibrate(series).first()
    tail = frame[FEATURES].to_numpy()[-500:]
    for f, name in enumerate(FEATURES):
        x = tail[:, f]
        z = [abs(x[i] - x[i - 30 : i].mean()) / x[i - 30 : i].std() for i in range(30, 500)]
        assert got[f"threshold_{name}"] == pytest.approx(np.clip(np.quantile(z, 0.95), 2.5, 6.0), abs=1e-9)
    short = KeyedSeries.build(spark.createDataFrame(frame.head(45)), ["well_id"], ["timestamp"], 30)
    assert set(detect.calibrate(short).first().asDict().values()) == {"W-0", 3.0}


def test_forest_ranks_outliers_first():
    rng = np.random.default_rng(3)
    normal = rng.normal(size=(400, 6))
    odd = rng.normal(size=(40, 6)) + rng.choice([-6, 6], size=(40, 6))
    for spec in (V1_FOREST, V2_FOREST):
        forest = fit_forest(normal, spec, 1)
        a, b = forest.score(normal, spec), forest.score(odd, spec)
        assert (b[:, None] > a[None, :]).mean() > 0.98
        assert a.min() >= 0 and b.max() <= 1
        assert abs((forest.samples(normal) < forest.offset).mean() - spec.contamination) < 0.01
        again = fit_forest(normal, spec, 1)
        assert np.array_equal(again.score(odd, spec), b)


def test_saved_forests_score_like_fresh_ones(spark):
    frame = noisy(2, 150)
    series = KeyedSeries.build(spark.createDataFrame(frame), ["well_id"], ["timestamp"])
    models = fit_models(series, FEATURES, V2_FOREST).toPandas()
    assert len(models) == 2
    import zlib

    for _, row in models.iterrows():
        values = frame[frame["well_id"] == row["well_id"]][FEATURES].to_numpy()
        fresh = fit_forest(values, V2_FOREST, zlib.crc32(row["well_id"].encode()), 150)
        assert np.array_equal(load_forest(row).score(values, V2_FOREST), fresh.score(values, V2_FOREST))


def test_stored_forests_score_in_the_jvm_like_fresh_ones(spark, tmp_path):
    frame = noisy(3, 300, shift_at=200)
    frame.loc[5, FEATURES[0]] = None
    df = spark.createDataFrame(frame)
    series = KeyedSeries.build(df.filter("well_id <> 'W-2'"), ["well_id"], ["timestamp"])
    fit_models(series, FEATURES, V2_FOREST).write.parquet(f"{tmp_path}/models")
    models = spark.read.parquet(f"{tmp_path}/models")
    rows = KeyedSeries.build(df, ["well_id"], ["timestamp"]).rows()
    got = score_stored(rows, models, ["well_id"], POS, FEATURES, V2_FOREST).toPandas()
    assert len(got) == 900 and set(got.columns) == {*rows.columns, "if_score"}
    for _, row in models.toPandas().iterrows():
        part = got[got["well_id"] == row["well_id"]].sort_values(POS)
        want = load_forest(row).score(np.nan_to_num(part[FEATURES].to_numpy(dtype=float)), V2_FOREST)
        assert np.allclose(part["if_score"], want, atol=1e-12) and want.max() > 0.5
    assert (got[got["well_id"] == "W-2"]["if_score"] == 0).all()


def test_detection_from_stored_thresholds_and_forests(spark, tmp_path):
    frame = noisy(2, 420, shift_at=380)
    frame["is_train"] = frame.groupby("well_id").cumcount() < 365
    df = spark.createDataFrame(frame)
    columns = ["well_id", "ordinal", "severity", "anomaly_score", "description"]
    # 55 live rows: the batch form has not trained again yet
    fresh = detect.detect_v2(df, is_train="is_train").select(*columns).collect()
    series = KeyedSeries.build(df, ["well_id"], ["timestamp"], 32)
    trained = KeyedSeries.build(df.filter("is_train"), ["well_id"], ["timestamp"], 32)
    detect.calibrate(trained).write.parquet(f"{tmp_path}/thresholds")
    fit_models(trained, FEATURES, V2_FOREST).write.parquet(f"{tmp_path}/models")
    stored = detect.fold_series_v2(
        series, is_train="is_train", thresholds=spark.read.parquet(f"{tmp_path}/thresholds"),
        models=spark.read.parquet(f"{tmp_path}/models"),
    )
    assert sorted(detect.alerts_v2(stored).select(*columns).collect()) == sorted(fresh) and fresh


def test_predict_keeps_normal_rows(spark):
    df = spark.createDataFrame(noisy(2, 300, shift_at=200))
    series = KeyedSeries.build(df, ["well_id"], ["timestamp"], 32)
    alerts = detect.alerts_v2(detect.fold_series_v2(series))
    scored = detect.predict(series.rows().select("well_id", F.col(POS).alias("ordinal")), alerts, ["well_id", "ordinal"])
    assert scored.count() == 600
    assert scored.filter("is_anomaly").count() == alerts.count() > 0
    assert {r[0] for r in scored.filter("not is_anomaly").select("anomaly_type").distinct().collect()} == {"normal"}


def test_anomaly_types_and_the_unreachable_collapse(spark):
    rows = [
        ("water", 3.0, 50.0, 0.0, 3000.0, 0.0, 2500.0, 0.0, 0.0),
        ("dry", 3.0, 30.0, 0.0, 3000.0, 0.0, 2500.0, 0.0, 0.0),
        ("gor", 0.0, 30.0, 2.6, 3000.0, 0.0, 2500.0, 0.0, 0.0),
        ("bhp", 0.0, 30.0, 0.0, 2400.0, 2.6, 2500.0, 0.0, 0.0),
        ("oil", 0.0, 30.0, 0.0, 3000.0, 0.0, 900.0, 4.0, 0.0),
        ("hot", 0.0, 30.0, 0.0, 3000.0, 0.0, 2500.0, 0.0, 3.1),
    ]
    ddl = (
        "name STRING, z_water_cut_pct DOUBLE, water_cut_pct DOUBLE, z_gas_oil_ratio DOUBLE, bhp_psi DOUBLE, "
        "z_bhp_psi DOUBLE, oil_rate_bopd DOUBLE, z_oil_rate_bopd DOUBLE, z_wh_temp_f DOUBLE"
    )
    df = spark.createDataFrame(rows, ddl).withColumn("base_oil_rate_bopd", F.lit(2500.0))
    kinds = {r[0]: r[1:] for r in df.select("name", sev.anomaly_type(), sev.anomaly_type(True)).collect()}
    other = "multi_feature_correlated"
    assert kinds == {
        "water": ("water_breakthrough",) * 2, "dry": (other,) * 2, "gor": ("gor_spike",) * 2,
        "bhp": ("bhp_depletion",) * 2, "oil": (other, "oil_rate_collapse"), "hot": ("thermal_excursion",) * 2,
    }


def test_leaves_found_while_growing_are_those_of_a_walk():
    values = np.random.default_rng(8).normal(size=(300, 6)).round(1)
    forest = fit_forest(values, V2_FOREST, 3)
    x = (values - forest.mean) / forest.scale
    want = np.empty((V2_FOREST.trees, len(x)))
    for tree in range(V2_FOREST.trees):
        for i, reading in enumerate(x):
            node = 0
            while forest.feature[tree, node] >= 0:
                node = 2 * node + 1 + int(reading[forest.feature[tree, node]] > forest.threshold[tree, node])
            want[tree, i] = forest.path[tree, node]
    rows = np.broadcast_to(np.arange(len(x)), want.shape)
    assert np.array_equal(forest.paths(x, rows), want)
    assert forest.offset == np.percentile(forest.decision(want), 100 * V2_FOREST.contamination)


def test_stored_models_come_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    from borewatch.operators import forest
    from borewatch.plans.registered import detection

    monkeypatch.setattr(forest, "MODELS_A_FILE", 1)
    one = noisy(200, 1)
    wells = [one.assign(well_id=f"W-{i}", reading_id=np.arange(len(one)) + 1000 * i) for i in range(3)]
    frame = pd.concat(wells)
    monkeypatch.setattr(detection, "telemetry", lambda *_: spark.createDataFrame(frame))
    _, _, models = detection.stored_training(spark, str(tmp_path), True)
    held = models.groupBy(F.input_file_name()).count().collect()
    assert len(held) == 3 and {r["count"] for r in held} == {1}

"""A stream in several triggers must raise the alerts of the batch form."""

import json
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from borewatch.operators import detect, forest
from borewatch.operators.ordering import POS
from borewatch.sources import topics
from borewatch.streaming import blocks, detector, jobs
from borewatch.schema import FEATURES
from tests.series import noisy


@pytest.mark.parametrize("version", [1, 2])
def test_stream_equals_batch(spark, tmp_path, version):
    frame = noisy(3, 180, shift_at=140)
    source = tmp_path / "in"
    source.mkdir()
    times = sorted(frame["timestamp"].unique())
    import os

    for n, start in enumerate(range(0, len(times), 50)):
        part = frame[frame["timestamp"].isin(times[start : start + 50])].sample(frac=1.0, random_state=n)
        lines = [json.dumps(r | {"timestamp": r["timestamp"].isoformat()}) for r in part.to_dict("records")]
        if n == 1:
            lines += ["{broken", json.dumps({"timestamp": "2024-01-05T00:00:00", "well_id": "W-0", "bhp_psi": None})]
        path = source / f"{n}.json"
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    stream = topics.usable(topics.decode(topics.read_message_files(spark, str(source), 1)))
    run = detector.detect_stream_v1 if version == 1 else detector.detect_stream_v2
    alerts = jobs.run_to_end(run(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    df = spark.createDataFrame(frame)
    batch = detect.detect_v1(df) if version == 1 else detect.detect_v2(df)
    columns = ["alert_id", "well_id", "ordinal", "severity", "anomaly_score", "description"]
    assert sorted(alerts.select(*columns).collect()) == sorted(batch.select(*columns).collect())
    assert alerts.count() > 5


def test_copies_are_dropped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"alert_id": i % 3, "timestamp": f"2024-01-01T0{i}:00:00"}) for i in range(6)))
    stream = spark.readStream.schema("alert_id STRING, timestamp TIMESTAMP").json(str(tmp_path / "in"))
    once = jobs.run_to_end(detector.deduplicated(stream, "1 day"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert once.select(F.count_distinct("alert_id"), F.count("*")).first() == (3, 3)


def test_late_rows_are_marked_and_kept(spark, tmp_path):
    base, source = f"{tmp_path}/late", f"{tmp_path}/in"
    batches = [[("a", 10), ("b", 20)], [("c", 12), ("d", 13), ("e", None)], [("f", 40)], [("g", 13), ("h", 33)]]
    for batch in batches:
        rows = [(i, None if h is None else f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00") for i, h in batch]
        frame = spark.createDataFrame(rows, "id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        frame.write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame.schema).parquet(source)
        out = jobs.quarantine_late(stream, "ts", "8 hours", f"{base}/out", f"{base}/state")
    found = {r["id"]: r["late"] for r in out.collect()}
    # limits: none, 12, 12, 32
    assert found == {"a": False, "b": False, "c": False, "d": False, "e": False, "f": False, "g": True, "h": False}


def test_stored_thresholds_and_training_rows(spark, tmp_path):
    frame = noisy(2, 200, shift_at=170)
    frame["n"] = frame.groupby("well_id").cumcount()
    df = spark.createDataFrame(frame).withColumn("is_train", F.col("n") < 140)
    series = detect.KeyedSeries.build(df, ["well_id"], ["timestamp"], 32)
    sizes = df.groupBy("well_id").agg(F.count_if("is_train").alias("train_rows"))
    known = detect.calibrate(series.transform(lambda rows: rows.join(sizes, "well_id")), train_rows="train_rows")
    known.write.parquet(f"{tmp_path}/thresholds")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    thresholds = spark.read.parquet(f"{tmp_path}/thresholds")
    live = detector.detect_stream_v2(stream, thresholds=thresholds, is_train="is_train", carry=("n",))
    alerts = jobs.run_to_end(live, f"{tmp_path}/out", f"{tmp_path}/state")
    batch = detect.alerts_v2(detect.fold_series_v2(series, is_train="is_train", use_forest=False), extra=("n",))
    columns = ["alert_id", "ordinal", "n", "severity", "anomaly_score", "description"]
    assert sorted(alerts.select(*columns).collect()) == sorted(batch.select(*columns).collect())
    assert alerts.count() > 0


def test_trained_stream_equals_batch_across_a_restart(spark, tmp_path):
    """Forests in the state, grown again on the cadence of the batch form; the first run ends in the middle."""
    frame = noisy(2, 330, shift_at=250)
    frame["is_train"] = frame.groupby("well_id").cumcount() < 150
    frame["n"] = frame.groupby("well_id").cumcount()
    df = spark.createDataFrame(frame)
    series = detect.KeyedSeries.build(df, ["well_id"], ["timestamp"], 560)
    detector.trained_state(series, FEATURES, "is_train").write.parquet(f"{tmp_path}/trained")
    trained = spark.read.parquet(f"{tmp_path}/trained")
    live = df.filter("not is_train").drop("is_train", "n")
    live.filter("timestamp < '2024-01-10 12:00:00'").write.parquet(f"{tmp_path}/in")
    for last in (False, True):
        stream = spark.readStream.schema(live.schema).parquet(f"{tmp_path}/in")
        found = detector.detect_stream_v2_trained(stream, trained)
        alerts = jobs.run_to_end(found, f"{tmp_path}/out", f"{tmp_path}/state")
        if not last:
            live.filter("timestamp >= '2024-01-10 12:00:00'").write.mode("append").parquet(f"{tmp_path}/in")
    batch = detect.alerts_v2(detect.fold_series_v2(series, is_train="is_train"))
    columns = ["alert_id", "well_id", "ordinal", "severity", "anomaly_score", "description"]
    assert sorted(alerts.select(*columns).collect()) == sorted(batch.select(*columns).collect())
    assert alerts.count() > 5


@pytest.mark.parametrize("use_forest", [False, True])
def test_a_hot_well_is_cut_into_blocks(spark, tmp_path, use_forest):
    """Nine tenths of the rows are one well's; triggers and blocks change no alert, nor does a batch that runs again."""
    rows = 900 if use_forest else 1500
    hot = noisy(1, rows, seed=3, shift_at=rows - 100)
    others = noisy(3, rows // 30, seed=4)
    others["well_id"] = "o" + others["well_id"]
    frame = pd.concat([hot, others], ignore_index=True)
    df = spark.createDataFrame(frame)
    times = sorted(frame["timestamp"].unique())
    for n, start in enumerate(range(0, len(times), 400)):
        some = frame[frame["timestamp"].isin(times[start : start + 400])]
        spark.createDataFrame(some).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    alerts = blocks.detect_in_blocks(stream, f"{tmp_path}/out", f"{tmp_path}/state", use_forest=use_forest, block_rows=250)
    columns = ["alert_id", "ordinal", "severity", "anomaly_score", "description"]
    want = sorted(detect.detect_v1(df, use_forest=use_forest).select(*columns).collect())
    assert sorted(alerts.select(*columns).collect()) == want and len(want) > 20
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "alerts").iterdir() if "=" in p.name)
    assert last >= 2
    again = blocks.diagnose_batches(df.schema, f"{tmp_path}/out", "well_id", ["timestamp"], FEATURES, "timestamp", use_forest, (), 250)
    final = frame[frame["timestamp"].isin(times[400 * last :])]
    again(spark.createDataFrame(final), last)
    read = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out/alerts")
    assert sorted(read.select(*columns).collect()) == want


def test_a_trigger_stores_its_last_forest_once():
    """Readings that pass the cadence several times grow several forests, and one enters the state, as bytes."""
    rng = np.random.default_rng(4)
    every = pd.DataFrame(rng.normal(size=(330, len(FEATURES))), columns=FEATURES)
    every[POS] = np.arange(1, 331)
    processor = detector.TrainedDetectorV2("well_id", ["timestamp"], FEATURES, [])

    class State:
        held = None
        updates = 0

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held, self.updates = value, self.updates + 1

    processor.forest, processor.forest_fields = State(), ["fit_at", *forest.PACKED, "depth", "normaliser", "offset"]
    scores = processor._forest_scores("W-0", every, 150, 150)
    row = dict(zip(processor.forest_fields, processor.forest.held))
    assert processor.forest.updates == 1 and row["fit_at"] == 330 and all(isinstance(row[n], bytes) for n in forest.PACKED)
    values = every[FEATURES].to_numpy()
    last = forest.fit_forest(values, forest.V2_FOREST, zlib.crc32(b"W-0"), 330)
    assert np.array_equal(forest.unpack_forest(row).score(values, forest.V2_FOREST), last.score(values, forest.V2_FOREST))
    before = forest.fit_forest(values[:270], forest.V2_FOREST, zlib.crc32(b"W-0"), 270)
    assert np.array_equal(scores[119:179], before.score(values[269:329], forest.V2_FOREST))

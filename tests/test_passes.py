import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from borewatch.operators import detect, passes
from borewatch.operators.ordering import POS, KeyedSeries
from borewatch.plans import benchmark
from borewatch.plans.registered.detection import with_train_mark
from borewatch.schema import FEATURES
from tests.series import noisy


@pytest.fixture
def stored(monkeypatch):
    """Rows of each checkpoint that is made."""
    from pyspark.sql.classic.dataframe import DataFrame

    found, checkpoint = [], DataFrame.checkpoint

    def counted(self, eager=True):
        out = checkpoint(self, eager)
        found.append(out.count())
        return out

    monkeypatch.setattr(DataFrame, "checkpoint", counted)
    return found


def test_groups_come_whole_whatever_the_batches(monkeypatch):
    monkeypatch.setattr(passes, "ROWS_AT_ONCE", 4)
    keys = ["a"] * 3 + [None] * 9 + ["b"] + ["c"] * 2
    rows = pa.table({"key": pa.array(keys), "n": list(range(len(keys)))})
    for size in (1, 2, 5, 100):
        found = []
        for table, groups in passes.whole_groups(iter(rows.to_batches(max_chunksize=size)), ["key"]):
            found += [table.column("n").to_pylist()[a:b] for a, b in groups]
        assert found == [[0, 1, 2], list(range(3, 12)), [12], [13, 14]]


def test_forests_and_folds_store_alerts_only(spark, stored):
    """Detection on marked rows stores the rows that alert, not all readings, and version 1 with its forest none."""
    df = spark.createDataFrame(noisy(2, 700, shift_at=600))
    series = with_train_mark(KeyedSeries.build(df, ["well_id"], ["timestamp"], 560), train_rows="train_rows")
    alerts = detect.fold_series_v2(series, is_train="is_train", train_rows="train_rows")
    assert stored == [alerts.count()] and 0 < stored[0] < 100
    assert alerts.select(F.max("if_score")).first()[0] > 0
    del stored[:]
    assert detect.detect_v1(df).count() > 0 and not stored


def test_marked_sizes_change_no_alert(spark):
    frame = noisy(2, 700, shift_at=600)
    frame.loc[[3, 450, 630], FEATURES[0]] = None
    df = spark.createDataFrame(frame)
    series = with_train_mark(KeyedSeries.build(df, ["well_id"], ["timestamp"], 560), train_rows="train_rows")
    columns = ["well_id", "ordinal", "severity", "anomaly_score", "description"]
    got = detect.alerts_v2(detect.fold_series_v2(series, is_train="is_train", train_rows="train_rows")).select(*columns)
    cut = detect.detect_v2(series.rows(keep_position=False).drop("train_rows"), is_train="is_train", block_rows=600).select(*columns)
    assert sorted(got.collect()) == sorted(cut.collect()) and got.count()


def test_quantiles_in_order_are_those_of_percentile(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"key": ["a"] * 40 + ["b"] * 3 + [None] * 25 + ["d"] * 2, "x": rng.normal(size=70)})
    df = spark.createDataFrame(frame).withColumn("n", F.monotonically_increasing_id())
    value = F.when(F.col("n") % 7 == 3, None).when(F.col("key") == "d", None).when(F.col("n") == 50, float("nan"))
    df = df.withColumn("x", F.when(F.coalesce(F.col("n") % 7 == 3, F.lit(False)) | (F.col("key") == "d"), None).otherwise(F.coalesce(value, "x")))
    for share in (0.0, 0.5, 0.95, 1.0):
        want = df.groupBy("key").agg(F.count("x").alias("c"), F.percentile("x", share).alias("q")).collect()
        rows = df.coalesce(1).sortWithinPartitions("n").select("key", "x")
        got = detect._quantiles_in_order(rows, ["key"], ["x"], share, ["c"], ["q"]).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 4


def test_a_fold_out_of_order_is_refused(spark):
    frame = pd.DataFrame({"well": "W", POS: [1, 3, 2], "z_x": 0.0, "raw_flag": False})
    with pytest.raises(Exception, match="not in their order"):
        detect.fold_in_order(spark.createDataFrame(frame).coalesce(1), ["well"], ["x"])


def test_a_benchmark_stores_its_readings_once(spark, stored):
    """The split rows are stored as files and injected where they are read; checkpoints hold events and alerts."""
    frame = noisy(2, 700)
    frame["is_producing"] = True
    rows = benchmark.compare_versions(benchmark.producing(spark.createDataFrame(frame))).collect()
    assert len(rows) == 2 and stored and max(stored) < 100

"""A key cut into blocks must give the rows an uncut key gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from borewatch.operators import cusum, metrics, rolling
from borewatch.operators.ordering import BLOCK, HALO, POS, KeyedSeries
from borewatch.schema import FEATURES
from tests.series import noisy


@pytest.fixture(scope="module")
def readings(spark):
    frame = noisy(3, 200)
    # One well holds most rows.
    extra = noisy(1, 900, seed=2)
    extra["well_id"] = "W-hot"
    import pandas as pd

    return spark.createDataFrame(pd.concat([frame, extra])).repartition(4).cache()


def both(readings, halo):
    whole = KeyedSeries.build(readings, ["well_id"], ["timestamp"], halo)
    cut = KeyedSeries.build(readings, ["well_id"], ["timestamp"], halo, block_rows=64)
    assert not whole.split and cut.split
    return whole, cut


def same(a, b, columns):
    def rows(series):
        df = series.rows() if isinstance(series, KeyedSeries) else series
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())

    assert rows(a) == rows(b)


def test_ordinals_and_blocks(readings):
    whole, cut = both(readings, 30)
    same(whole, cut, ["well_id", "timestamp", POS])
    sizes = cut.df.groupBy("well_id", BLOCK).count().agg(F.max("count")).first()[0]
    assert sizes <= 64 + 30
    hot = cut.df.filter("well_id = 'W-hot'")
    assert hot.select(BLOCK).distinct().count() == 15
    assert hot.filter(F.col(HALO)).count() == 30 * 14


def test_trailing_frames(readings):
    for version in (1, 2):
        a, b = (rolling.rolling_z(s, FEATURES, version) for s in both(readings, 30))
        same(a, b, ["well_id", POS, *[f"z_{f}" for f in FEATURES]])


def test_halo_is_checked(readings):
    cut = KeyedSeries.build(readings, ["well_id"], ["timestamp"], 10, block_rows=64)
    with pytest.raises(ValueError):
        cut.trailing(-30, -1)
    with pytest.raises(ValueError):
        KeyedSeries.build(readings, ["well_id"], ["timestamp"], 10).trailing(-30, -1)
    with pytest.raises(ValueError):
        cusum.bursts(KeyedSeries.build(readings, ["well_id"], ["timestamp"]), F.lit(True))
    with pytest.raises(ValueError):
        KeyedSeries.build(readings, ["well_id"], ["timestamp"], halo=100, block_rows=50)


def test_running_values(readings):
    whole, cut = both(readings, 1)
    for how in ("sum", "min", "max"):
        a, b = (s.running(F.col("bhp_psi"), "r", how) for s in (whole, cut))
        same(a, b, ["well_id", POS, "r"])


def test_cusum_streaks_bursts_gaps(readings):
    whole, cut = both(readings, 30)
    flag = F.col("water_cut_pct") > 15.1
    a, b = (cusum.cusum_chart(rolling.rolling_z(s, ["bhp_psi"], 2), "z_bhp_psi", "s") for s in (whole, cut))
    same(a, b, ["well_id", POS, "s"])
    a, b = (cusum.with_streaks(s, flag) for s in (whole, cut))
    same(a, b, ["well_id", POS, "streak"])
    a, b = (cusum.bursts(s, flag) for s in (whole, cut))
    same(a, b, ["well_id", "burst_start", "burst_end", "rows"])
    thinned = readings.filter(F.hour("timestamp") % 5 != 0)
    a, b = (rolling.find_gaps(s, "timestamp", 1.5, None) for s in both(thinned, 1))
    same(a, b, ["well_id", "gap_from", "duration_hours"])


def test_cusum_equals_the_recursion(readings):
    chart = cusum.cusum_chart(
        rolling.rolling_z(KeyedSeries.build(readings, ["well_id"], ["timestamp"], 30), ["bhp_psi"], 2), "z_bhp_psi", "s"
    )
    rows = chart.rows().filter("well_id = 'W-hot'").orderBy(POS).select("z_bhp_psi", "s").collect()
    state = 0.0
    for row in rows:
        state = max(0.0, state + row["z_bhp_psi"] - 0.5)
        assert row["s"] == pytest.approx(state, abs=1e-6)


def test_rows_without_a_key_are_cut_too(readings):
    nameless = readings.withColumn("well_id", F.when(F.col("well_id") != "W-hot", F.col("well_id")))
    whole, cut = both(nameless, 30)
    assert cut.df.filter("well_id IS NULL").select(BLOCK).distinct().count() == 15
    a, b = (s.running(F.lit(1), "n") for s in (whole, cut))
    same(a, b, ["n", POS])
    a, b = (rolling.rolling_z(s, FEATURES, 1) for s in (whole, cut))
    same(a.transform(lambda df: df.withColumn("well_id", F.coalesce("well_id", F.lit("-")))), b.transform(lambda df: df.withColumn("well_id", F.coalesce("well_id", F.lit("-")))), ["well_id", POS, *[f"z_{f}" for f in FEATURES]])


def test_area_does_not_depend_on_blocks(spark):
    rows = spark.range(500).select(
        (F.col("id") % 2).cast("string").alias("k"), (F.xxhash64("id") % 200).alias("s"), (F.xxhash64("id", F.lit(1)) % 3 == 0).alias("y")
    )
    a, b = (sorted(metrics.roc_auc(rows, "s", F.col("y"), ["k"], **o).collect()) for o in ({}, {"block_rows": 16}))
    assert a == b and len(a) == 2


def test_moments_equal_window_aggregates_over_nulls_and_batches(spark):
    rng = np.random.default_rng(4)
    rows = [
        (key, i, None if rng.random() < 0.2 else float(rng.normal()), float(rng.normal()) if i % 5 else float("nan"))
        for key, n in (("a", 1), ("b", 70), (None, 40), ("c", 9)) for i in range(n)
    ]
    df = spark.createDataFrame(rows, "k STRING, i INT, x DOUBLE, y DOUBLE")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for series in (KeyedSeries.build(df, ["k"], ["i"], 12), KeyedSeries.build(df, ["k"], ["i"], 12, 20)):
            for first, last, sample in ((-12, -1, True), (-11, -3, False)):
                over = series.trailing(first, last)
                deviation = F.stddev_samp if sample else F.stddev_pop
                want = {f"m_{c}": F.avg(c).over(over) for c in "xy"} | {f"s_{c}": deviation(c).over(over) for c in "xy"}
                names = ["k", "_pos", *want]
                moved = rolling.moments(series, ["x", "y"], [rolling.Frame(first, last, "m", "s", sample)])
                got = sorted(map(str, moved.rows().select(*names).collect()))
                assert got == sorted(map(str, series.transform(lambda d: d.withColumns(want)).rows().select(*names).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

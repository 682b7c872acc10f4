"""Window summaries against pandas: ties, nulls, empty windows, wells cut into blocks of rows."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from borewatch.operators import windows_of_time as wt

START = dt.datetime(2024, 1, 1)
FEATURES = ["a", "b"]


def rounded(x, digits):
    if x is None or np.isnan(x):
        return None
    return np.rint(np.rint(x * 1e9) / 1e9 * 10**digits) / 10**digits


def by_hand(frame, alerts, hours):
    out = {}
    for alert_id, well, at in alerts:
        part = frame[(frame["well_id"] == well) & (frame["timestamp"] <= at) & (frame["timestamp"] >= at - dt.timedelta(hours=hours))]
        part = part.sort_values(["timestamp", "n"])
        k = len(part)
        if not k:
            continue
        tenth = max(1, k // 10)
        for f in FEATURES:
            x = part[f].astype(float)
            some = x.dropna()
            early, late = x.head(tenth).sum() / tenth, x.tail(tenth).sum() / tenth
            mean = some.mean() if len(some) else float("nan")

            def trend(v):
                return rounded((v - early) / abs(early) * 100, 1) if early != 0 and not np.isnan(v) else 0.0

            out[alert_id, f] = (
                k, rounded(mean, 2), rounded(some.std(ddof=0) if len(some) else float("nan"), 2),
                rounded(some.min() if len(some) else float("nan"), 2), rounded(some.max() if len(some) else float("nan"), 2),
                trend(mean), trend(late),
            )
    return out


@pytest.mark.parametrize("block_rows", [None, 70])
def test_summaries_equal_pandas(spark, block_rows):
    rng = random.Random(7)
    rows, n = [], 0
    for well, count in (("hot", 700), ("w1", 40), ("w2", 3)):
        for _ in range(count):
            n += 1
            at = START + dt.timedelta(hours=rng.randrange(0, 400 if well == "hot" else 300))
            rows.append((at, well, n, 1e6 + rng.random() if rng.random() > 0.1 else None, 5.0 if well == "w1" else rng.gauss(0, 3)))
    frame = pd.DataFrame(rows, columns=["timestamp", "well_id", "n", *FEATURES])
    alerts = [(f"x{i}", rng.choice(["hot", "hot", "w1", "w2", "none"]), START + dt.timedelta(hours=rng.randrange(0, 480))) for i in range(120)]
    alerts += [("at", "hot", frame["timestamp"][3].to_pydatetime()), ("late", "w1", START + dt.timedelta(days=90))]
    ddl = "timestamp TIMESTAMP, well_id STRING, n LONG, a DOUBLE, b DOUBLE"
    telemetry = spark.createDataFrame([tuple(None if x != x else x for x in r) for r in rows], ddl).repartition(3)
    asked = spark.createDataFrame(alerts, "alert_id STRING, well_id STRING, timestamp TIMESTAMP")
    options = {"block_rows": block_rows} if block_rows else {}
    out = wt.summarise_before(asked, telemetry, ["timestamp", "n"], FEATURES, 72, **options).collect()
    got = {(r["alert_id"], r["feature"]): (r["record_count"], r["mean"], r["std"], r["min"], r["max"], r["trend_pct"], r["trend_tail_pct"]) for r in out}
    want = by_hand(frame, alerts, 72)
    assert set(got) == set(want) and len(out) == len(got)
    for key, values in want.items():
        assert got[key] == pytest.approx(values, abs=1e-9), key


def test_no_alerts_and_no_readings(spark):
    telemetry = spark.createDataFrame([(START, "w", 1, 1.0, 2.0)], "timestamp TIMESTAMP, well_id STRING, n LONG, a DOUBLE, b DOUBLE")
    alerts = spark.createDataFrame([("x", "w", START)], "alert_id STRING, well_id STRING, timestamp TIMESTAMP")
    assert wt.summarise_before(alerts.limit(0), telemetry, ["timestamp", "n"], FEATURES).count() == 0
    assert wt.summarise_before(alerts, telemetry.limit(0), ["timestamp", "n"], FEATURES).count() == 0
    assert wt.summarise_before(alerts, telemetry, ["timestamp", "n"], FEATURES).count() == 2

"""Quantiles by rank selection against numpy."""

import numpy as np
import pytest

from borewatch.operators.quantiles import exact_quantiles

SHARES, NAMES = [0.0, 0.5, 0.95, 0.99, 1.0], ["p0", "p50", "p95", "p99", "p100"]


def groups():
    rng = np.random.default_rng(5)
    return {
        "even": rng.random(900), "tails": np.exp(rng.normal(0, 40, 700)) * rng.choice([-1, 1], 700),
        "ties": rng.choice([1.0, 2.0, 2.0, 3.0], 800), "one": np.array([4.5]), "two": np.array([1.0, 2.0]),
        "same": np.full(500, 7.0), "tiny": 1.0 + rng.random(600) * 1e-13, None: rng.normal(size=300),
        "ends": np.concatenate([[-np.inf] * 3, rng.normal(size=400), [np.inf] * 40]),
    }


@pytest.mark.parametrize("few, parts", [(4096, 512), (30, 24)])
def test_quantiles_equal_numpy(spark, few, parts):
    rows = [(k, float(x)) for k, xs in groups().items() for x in xs]
    rows += [("even", None), ("even", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    got = {r["k"]: [r[n] for n in NAMES] for r in exact_quantiles(df, "x", ["k"], SHARES, NAMES, few, parts).collect()}
    assert set(got) == {*groups(), "empty"} and got["empty"] == [None] * 5
    for k, xs in groups().items():
        with np.errstate(invalid="ignore"):
            want = np.quantile(xs, SHARES) if k != "ends" else np.quantile(xs, SHARES, method="lower")
        assert got[k] == pytest.approx(want.tolist(), rel=1e-12, abs=0), k


def test_quantiles_of_the_whole_table_and_of_nothing(spark):
    df = spark.range(10_001).selectExpr("id % 7 as k", "cast(id as double) as x")
    assert exact_quantiles(df, "x", [], [0.5, 0.25], ["m", "q"], 500).collect() == [(5000.0, 2500.0)]
    assert exact_quantiles(df.limit(0), "x", ["k"], [0.5], ["m"]).count() == 0

"""Drift chart without re-arming (W9), streaks (W8) and bursts (W6) as window sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borewatch.operators.ordering import POS, KeyedSeries

SLACK = 0.5
DECISION = 4.0


def cusum_chart(series: KeyedSeries, score: str, out: str, slack: float = SLACK) -> KeyedSeries:
    """S_t = max(0, S_{t-1} + z_t - k) for every row, without a sequential pass.

    With P the running sum of (z - k), S equals P minus the smaller of 0 and the running
    minimum of P.
    """
    summed = series.running(F.col(score) - F.lit(slack), "_p", "sum")
    lowest = summed.running(F.col("_p"), "_low", "min")
    chart = F.col("_p") - F.least(F.lit(0.0), F.col("_low"))
    return lowest.transform(lambda df: df.withColumn(out, chart).drop("_p", "_low"))


def two_sided_cusum(series: KeyedSeries, score: str, up: str, down: str, slack: float = SLACK) -> KeyedSeries:
    """Both arms for a signed score.  Fed with |z| the lower arm is zero throughout."""
    mirrored = series.transform(lambda df: df.withColumn("_neg", -F.col(score)))
    both = cusum_chart(cusum_chart(mirrored, score, up, slack), "_neg", down, slack)
    return both.transform(lambda df: df.drop("_neg"))


def with_streaks(series: KeyedSeries, flag: Column, out: str = "streak") -> KeyedSeries:
    """Number of consecutive flagged rows ending at the current one.

    It is the distance to the last unflagged row, whose position is a running maximum.
    """
    marked = series.transform(lambda df: df.withColumn("_flag", F.coalesce(flag, F.lit(False))))
    last_clear = marked.running(F.when(~F.col("_flag"), F.col(POS)), "_clear", "max")
    length = F.when(F.col("_flag"), F.col(POS) - F.coalesce(F.col("_clear"), F.lit(0))).otherwise(F.lit(0))
    return last_clear.transform(lambda df: df.withColumn(out, length.cast("long")).drop("_flag", "_clear"))


def bursts(series: KeyedSeries, flag: Column) -> DataFrame:
    """Runs of consecutive flagged rows per key: burst_start, burst_end (exclusive), rows."""
    series.demand(1)
    window = series.window()
    marked = series.transform(
        lambda df: df.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn(
            "_starts",
            (F.col("_flag") & ~F.coalesce(F.lag("_flag").over(window), F.lit(False))).cast("int"),
        )
    )
    numbered = marked.running(F.col("_starts"), "_burst", "sum")
    return (
        numbered.rows()
        .filter("_flag")
        .groupBy(*series.keys, "_burst")
        .agg(
            F.min(POS).alias("burst_start"),
            (F.max(POS) + 1).alias("burst_end"),
            F.count(F.lit(1)).alias("rows"),
        )
        .drop("_burst")
    )

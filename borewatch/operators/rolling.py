"""Trailing-window diagnostics: rolling Z-scores and baselines (W1-W4), gaps.

A frame that slides is worked out anew for every row, some hundred additions a row for six features.  Spark partitions
and orders the rows; the additions run over a batch of rows at a time, one place of the frame after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borewatch.operators.ordering import POS, KeyedSeries
from borewatch.operators.passes import Pass
from borewatch.session import ship_package

V1_WINDOW = 24
V2_WINDOW = 30
# Score given by version 1 to a value that leaves a constant window.
FLAT_WINDOW_SCORE = 12.0
# Two sums of equal values may differ in the last bits: below this a deviation is zero.
FLAT_SIGMA = 1e-9


@dataclass(frozen=True)
class Frame:
    """Rows from `first` to `last` places relative to the current one (both < 0), whose mean and deviation are wanted."""

    first: int
    last: int
    mean: str | None = None
    deviation: str | None = None
    sample: bool = True


def moments(series: KeyedSeries, features: list[str], frames: list[Frame], first: Pass | None = None) -> KeyedSeries:
    """Add <mean>_<feature> and <deviation>_<feature> of each frame, null where the frame has no value (one, for a sample).

    Values are added oldest first; nulls are left out.  A task keeps one batch and the longest frame before it.  `first`
    runs over the same rows in their order, and leaves the columns it needed behind.
    """
    for frame in frames:
        series.demand(-frame.first)
    longest = max(-frame.first for frame in frames)
    ship_package(series.df.sparkSession)
    # partitions and orders the rows, and tells where a block begins
    placed = series.df.withColumn(_SEEN, F.row_number().over(series.window()))
    spent = {_SEEN, *(first.needed if first else [])}
    kept = [f for f in series.df.schema.fields if f.name not in spent]
    schema = T.StructType([*kept, *(first.fields if first else [])])
    for frame in frames:
        for name in (frame.mean, frame.deviation):
            for f in features if name else []:
                schema = schema.add(f"{name}_{f}", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, there = np.zeros((longest, len(features))), np.zeros((longest, len(features)), dtype=bool)
        for batch in first.run(batches) if first else batches:
            columns = [batch.column(f).cast(pa.float64()) for f in features]
            new = [c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns]
            values = np.concatenate([values[len(values) - longest :], np.stack(new, axis=1)])
            valid = [c.is_valid().to_numpy(zero_copy_only=False) for c in columns]
            there = np.concatenate([there[len(there) - longest :], np.stack(valid, axis=1)])
            seen = batch.column(_SEEN).to_numpy()
            out = [batch.column(n) for n in batch.schema.names if n not in spent]
            with np.errstate(all="ignore"):
                for frame in frames:
                    out += _frame_moments(frame, values, there, seen, longest)
            yield pa.RecordBatch.from_arrays(out, schema.names)

    return series.transform(lambda df: placed.mapInArrow(run, schema))


_SEEN = "_seen"


def _frame_moments(frame: Frame, values: np.ndarray, there: np.ndarray, seen: np.ndarray, longest: int) -> list[pa.Array]:
    """Means, then deviations, of a frame for the rows behind the first `longest`; `seen` counts the rows of their block."""
    rows = len(seen)
    total = np.zeros((rows, values.shape[1]))
    count, centre, square = total.copy(), total.copy(), total.copy()
    for back in range(-frame.first, -frame.last - 1, -1):
        at = slice(longest - back, longest - back + rows)
        inside = there[at] & (seen > back)[:, None]
        value = np.where(inside, values[at], 0.0)
        total += value
        count += inside
        if frame.deviation:
            # running mean and sum of squares; a value that isn't there changes neither
            delta = np.where(inside, value - centre, 0.0)
            step = delta / np.maximum(count, 1.0)
            centre += step
            square += delta * (delta - step)
    out = []
    if frame.mean:
        mean, none = total / count, count == 0
        out += [pa.array(mean[:, i], mask=none[:, i]) for i in range(values.shape[1])]
    if frame.deviation:
        freedom = count - 1 if frame.sample else count
        deviation, none = np.sqrt(square / freedom), freedom <= 0
        out += [pa.array(deviation[:, i], mask=none[:, i]) for i in range(values.shape[1])]
    return out


def rolling_z(
    series: KeyedSeries, features: list[str], version: int = 1, window: int | None = None, also: list[Frame] | None = None,
    first: Pass | None = None,
) -> KeyedSeries:
    """Add z_<feature>: |x - mean| / sample std of the `window` rows before the current one.

    Zero until that many rows exist.  On a constant window version 1 gives 12 to a value that
    moved by 1e-6 or more and 0 otherwise; version 2 gives 0.  Frames in `also` are worked out on the way.
    """
    n = window or (V1_WINDOW if version == 1 else V2_WINDOW)
    moved = moments(series, features, [Frame(-n, -1, "_mu", "_sd"), *(also or [])], first)
    scores = {f"z_{f}": F.when(F.col(POS) > n, _score(f, version)).otherwise(F.lit(0.0)) for f in features}
    return moved.transform(lambda df: df.withColumns(scores).drop(*[f"{p}_{f}" for p in ("_mu", "_sd") for f in features]))


def scores_and_baselines(
    series: KeyedSeries, features: list[str], version: int, streak: int = 2, first: Pass | None = None
) -> KeyedSeries:
    """`rolling_z`, then `baseline_v1` or `baseline_v2`, in one pass over the rows."""
    frames = _FRAMES_V1 if version == 1 else _frames_v2(V2_WINDOW, streak)
    scored = rolling_z(series, features, version, also=frames, first=first)
    return (_baselines_v1 if version == 1 else _baselines_v2)(scored, features)


def _score(feature: str, version: int) -> Column:
    gap = F.abs(F.col(feature) - F.col(f"_mu_{feature}"))
    sigma = F.col(f"_sd_{feature}")
    if version == 1:
        flat = F.when(gap < 1e-6, F.lit(0.0)).otherwise(F.lit(FLAT_WINDOW_SCORE))
    else:
        flat = F.lit(0.0)
    return F.when(sigma > FLAT_SIGMA, gap / sigma).otherwise(flat)


_FRAMES_V1 = [Frame(-23, -1, "_recent"), Frame(-24, -1, "_prior")]


def baseline_v1(series: KeyedSeries, features: list[str], first: Pass | None = None) -> KeyedSeries:
    """Add base_<feature>: mean of the 23 rows before, or of all (at most 24) before row 26."""
    return _baselines_v1(moments(series, features, _FRAMES_V1, first), features)


def _baselines_v1(moved: KeyedSeries, features: list[str]) -> KeyedSeries:
    exprs = {
        f"base_{f}": F.coalesce(
            F.when(F.col(POS) > 25, F.col(f"_recent_{f}")).otherwise(F.col(f"_prior_{f}")), F.col(f)
        )
        for f in features
    }
    return moved.transform(
        lambda df: df.withColumns(exprs).drop(*[f"{p}_{f}" for p in ("_recent", "_prior") for f in features])
    )


def _frames_v2(window: int, streak: int) -> list[Frame]:
    return [Frame(1 - window - streak, -streak, "_before")]


def baseline_v2(series: KeyedSeries, features: list[str], window: int = V2_WINDOW, streak: int = 2) -> KeyedSeries:
    """Add base_<feature>: mean of the `window` rows that end `streak` rows before the current one.

    The streak of an alert always equals its minimum, so the frame is fixed.
    """
    return _baselines_v2(moments(series, features, _frames_v2(window, streak)), features)


def _baselines_v2(moved: KeyedSeries, features: list[str]) -> KeyedSeries:
    exprs = {f"base_{f}": F.coalesce(F.col(f"_before_{f}"), F.col(f)) for f in features}
    return moved.transform(lambda df: df.withColumns(exprs).drop(*[f"_before_{f}" for f in features]))


def short_window_z(series: KeyedSeries, features: list[str], window: Column, longest: int = V1_WINDOW) -> KeyedSeries:
    """Version 1 scores where the window length is a column (at most `longest`), as for short histories."""
    before = series.trailing(-longest, -1)

    def add(df: DataFrame) -> DataFrame:
        df = df.withColumn("_w", window).withColumns({f"_h_{f}": F.collect_list(f).over(before) for f in features})
        for f in features:
            tail = F.slice(f"_h_{f}", -F.least(F.col("_w"), F.size(f"_h_{f}")), F.col("_w"))
            df = df.withColumn(f"_h_{f}", F.when(F.col(POS) > F.col("_w"), tail))
            mean = F.aggregate(f"_h_{f}", F.lit(0.0), lambda a, x: a + x) / F.col("_w")
            df = df.withColumn(f"_mu_{f}", mean)
            mu = F.col(f"_mu_{f}")
            square = F.aggregate(f"_h_{f}", F.lit(0.0), lambda a, x: a + (x - mu) * (x - mu))
            df = df.withColumn(f"_sd_{f}", F.sqrt(square / (F.col("_w") - 1)))
            df = df.withColumn(f"z_{f}", F.when(F.col(POS) > F.col("_w"), _score(f, 1)).otherwise(F.lit(0.0)))
        return df.drop("_w", *[f"{p}_{f}" for p in ("_h", "_mu", "_sd") for f in features])

    return series.transform(add)


def find_gaps(series: KeyedSeries, ts: str, gap_hours: float = 2.0, keep: int | None = 10) -> DataFrame:
    """Pauses between consecutive readings longer than `gap_hours`; the first `keep` per key."""
    series.demand(1)
    window = series.window()
    previous = series.transform(
        lambda df: df.withColumn("gap_from", F.lag(ts).over(window))
    ).rows()
    hours = (F.unix_micros(ts) - F.unix_micros("gap_from")) / F.lit(3600e6)
    gaps = (
        previous.withColumn("duration_hours", hours)
        .filter(F.col("duration_hours") > gap_hours)
        .select(*series.keys, "gap_from", F.col(ts).alias("gap_to"), F.rint(F.col("duration_hours") * 10).alias("_t"))
        .select(*series.keys, "gap_from", "gap_to", (F.col("_t") / 10).alias("duration_hours"))
    )
    if keep is None:
        return gaps
    # A row_number filter is pushed below the shuffle as a per-task limit.
    first = Window.partitionBy(*series.keys).orderBy("gap_from", "gap_to")
    return gaps.withColumn("gap_no", F.row_number().over(first)).filter(F.col("gap_no") <= keep)

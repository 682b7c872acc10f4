"""Seeded telemetry and plain-Python forms of the detectors to compare with."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

from borewatch.schema import FEATURES

START = dt.datetime(2024, 1, 1)
BASE = [2500.0, 15.0, 650.0, 3200.0, 145.0, 48.0]


def noisy(wells: int, rows: int, seed: int = 1, shift_at: int | None = None) -> pd.DataFrame:
    """Readings around fixed levels; from `shift_at` on the water cut climbs and oil falls."""
    rng = np.random.default_rng(seed)
    frames = []
    for w in range(wells):
        values = np.array(BASE) * (1 + 0.02 * rng.standard_normal((rows, len(BASE))))
        spikes = rng.random(rows) < 0.03
        values[spikes, rng.integers(0, 6, spikes.sum())] *= 1.4
        if shift_at is not None:
            ramp = np.clip(np.arange(rows) - shift_at, 0, None)
            values[:, 1] += ramp * 0.4
            values[:, 0] -= ramp * 9.0
        frame = pd.DataFrame(values, columns=FEATURES)
        frame.insert(0, "timestamp", [START + dt.timedelta(hours=i) for i in range(rows)])
        frame.insert(1, "well_id", f"W-{w}")
        frame.insert(2, "field_name", "Draugen")
        frames.append(frame)
    return pd.concat(frames, ignore_index=True)


def z_scores(values: np.ndarray, window: int, version: int) -> np.ndarray:
    """Scores row by row from the rows before."""
    out = np.zeros_like(values)
    for i in range(window, len(values)):
        before = values[i - window : i]
        mean, deviation = before.mean(axis=0), before.std(axis=0, ddof=1)
        for f in range(values.shape[1]):
            gap = abs(values[i, f] - mean[f])
            if deviation[f] > 1e-9:
                out[i, f] = gap / deviation[f]
            elif version == 1 and gap >= 1e-6:
                out[i, f] = 12.0
    return out


def cold_v2(values: np.ndarray, threshold: float = 3.0) -> list[int]:
    """Positions (from 0) at which version 2 alerts from a cold start."""
    z = z_scores(values, 30, 2)
    sums, streak, silent, found = np.zeros(values.shape[1]), 0, 0, []
    for i, row in enumerate(z):
        sums = np.maximum(0, sums + row - 0.5)
        raw = (row >= threshold).any() or (sums > 4).any()
        if silent:
            silent, streak = silent - 1, 0
            continue
        streak = streak + 1 if raw else 0
        if streak >= 2:
            found.append(i)
            sums, streak, silent = np.zeros(values.shape[1]), 0, 7
    return found

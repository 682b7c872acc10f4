"""Severity, type, score and deviation of one anomalous reading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Z thresholds of version 1.
Z_LOW = 2.0
Z_MEDIUM = 2.5
Z_HIGH = 3.5
Z_CRITICAL = 5.0

# Threshold defaults and clip range of version 2.
DEFAULT_THRESHOLD = 3.0
THRESHOLD_FLOOR = 2.5
THRESHOLD_CEILING = 6.0

# Forest scores from which a reading counts as anomalous on its own.
FOREST_FLOOR_V1 = 0.35
FOREST_FLOOR_V2 = 0.50


def max_of(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def round_tie_even(column: Column, digits: int) -> Column:
    """Round half to even on the scaled value, as array libraries do; stays inside codegen."""
    if digits == 0:
        return F.rint(column)
    scale = F.lit(float(10**digits))
    return F.rint(column * scale) / scale


def round_settled(column: Column, digits: int) -> Column:
    """Round a value that came from a sum or mean.

    The order of a distributed sum varies, and with it the last bits; settling nine decimals
    first keeps them from deciding a tie.
    """
    return round_tie_even(F.rint(column * 1e9) / 1e9, digits)


def severity_v1(max_z: Column, forest: Column) -> Column:
    combined = F.greatest(max_z / 6.0, forest)
    return (
        F.when((combined >= 0.85) | (max_z >= Z_CRITICAL), "CRITICAL")
        .when((combined >= 0.65) | (max_z >= Z_HIGH), "HIGH")
        .when((combined >= 0.45) | (max_z >= Z_MEDIUM), "MEDIUM")
        .otherwise("LOW")
    )


def severity_v2(max_z: Column, forest: Column, drift: Column, oil_threshold: Column) -> Column:
    combined = F.greatest(max_z / oil_threshold, forest, drift / 8.0)
    return (
        F.when(combined >= 0.90, "CRITICAL")
        .when(combined >= 0.65, "HIGH")
        .when(combined >= 0.40, "MEDIUM")
        .otherwise("LOW")
    )


def score_v1(max_z: Column, forest: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(forest, max_z / 6.0))


def score_v2(max_z: Column, forest: Column, largest_threshold: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(forest, max_z / largest_threshold))


def anomaly_type(fix_collapse: bool = False) -> Column:
    """Six classes from z_<feature> and the readings.

    As published the collapse test compares the rate with 0.6 times itself and cannot hold for
    a rate >= 0; `fix_collapse` compares it with 0.6 times the baseline instead.
    """
    oil_reference = F.col("base_oil_rate_bopd") if fix_collapse else F.col("oil_rate_bopd")
    return (
        F.when((F.col("z_water_cut_pct") > 2.5) & (F.col("water_cut_pct") > 40), "water_breakthrough")
        .when(F.col("z_gas_oil_ratio") > 2.5, "gor_spike")
        .when((F.col("z_bhp_psi") > 2.5) & (F.col("bhp_psi") < 2500), "bhp_depletion")
        .when(
            (F.col("z_oil_rate_bopd") > 2.5) & (F.col("oil_rate_bopd") < oil_reference * 0.6),
            "oil_rate_collapse",
        )
        .when(F.col("z_wh_temp_f") > 3.0, "thermal_excursion")
        .otherwise("multi_feature_correlated")
    )


def affected_v1(features: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(f"z_{f}") >= Z_LOW, F.lit(f)) for f in features]))


def affected_v2(features: list[str]) -> Column:
    return F.array_compact(
        F.array(*[F.when(F.col(f"z_{f}") >= F.col(f"threshold_{f}") * 0.8, F.lit(f)) for f in features])
    )


def _feature_map(features: list[str], affected: Column, value, keep=None) -> Column:
    """Map feature -> value over the affected features, in canonical order."""
    entries = [
        F.when(
            F.array_contains(affected, f) & (keep(f) if keep else F.lit(True)),
            F.struct(F.lit(f).alias("key"), value(f).alias("value")),
        )
        for f in features
    ]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def deviation_v1(features: list[str], affected: Column) -> Column:
    """Percent off the baseline; features with a zero baseline are left out."""

    def percent(f: str) -> Column:
        base = F.col(f"base_{f}")
        return round_settled(100 * F.try_divide(F.col(f) - base, F.abs(base)), 1)

    return _feature_map(features, affected, percent, keep=lambda f: F.col(f"base_{f}") != 0)


def deviation_v2(features: list[str], affected: Column) -> Column:
    """Percent off the baseline, whose size is floored at 1e-6."""

    def percent(f: str) -> Column:
        base = F.col(f"base_{f}")
        return round_settled(100 * (F.col(f) - base) / F.greatest(F.abs(base), F.lit(1e-6)), 1)

    return _feature_map(features, affected, percent)


def rounded_map(features: list[str], affected: Column, prefix: str = "") -> Column:
    return _feature_map(features, affected, lambda f: round_settled(F.col(f"{prefix}{f}"), 2))


def feature_phrases(affected: Column, deviation: Column) -> Column:
    """ "water cut pct (+12.5%), bhp psi (-3.0%)" """
    return F.array_join(
        F.transform(
            affected,
            lambda f: F.format_string(
                "%s (%+.1f%%)", F.replace(f, F.lit("_"), F.lit(" ")), F.coalesce(deviation[f], F.lit(0.0))
            ),
        ),
        ", ",
    )


def description_v1(well: Column, severity: Column, affected: Column, deviation: Column, current: Column) -> Column:
    def hit(feature: str) -> Column:
        return F.array_contains(affected, feature)

    def change(feature: str) -> Column:
        return F.coalesce(deviation[feature], F.lit(0.0))

    falling_oil = hit("oil_rate_bopd") & (change("oil_rate_bopd") < -20)
    low_pressure = F.coalesce(current["bhp_psi"], F.lit(3000.0)) < 2500
    hints = F.array_compact(
        F.array(
            F.when(
                hit("water_cut_pct") & (change("water_cut_pct") > 0),
                F.lit("possible water breakthrough or coning"),
            ),
            F.when(falling_oil & low_pressure, F.lit("possible pump failure or liquid loading")),
            F.when(falling_oil & ~low_pressure, F.lit("possible choke restriction or separator upset")),
            F.when(
                hit("gas_oil_ratio") & (change("gas_oil_ratio") > 50),
                F.lit("possible gas coning or separator malfunction"),
            ),
            F.when(
                hit("bhp_psi") & (change("bhp_psi") < -15),
                F.lit("possible reservoir pressure depletion or pump issue"),
            ),
        )
    )
    causes = F.when(
        F.size(hints) > 0, F.concat(F.lit(" Possible causes: "), F.array_join(hints, "; "), F.lit("."))
    ).otherwise(F.lit(""))
    return F.concat(
        severity, F.lit(" anomaly on "), well, F.lit(": abnormal "), feature_phrases(affected, deviation),
        F.lit("."), causes,
    )


def description_v2(
    well: Column, severity: Column, kind: Column, affected: Column, deviation: Column, drift: Column, details: Column
) -> Column:
    return F.concat(
        severity, F.lit(" "), kind, F.lit(" on "), well, F.lit(": "), feature_phrases(affected, deviation),
        F.lit(". "), F.when(drift, F.lit("CUSUM gradual drift confirmed. ")).otherwise(F.lit("")),
        F.lit("Economic impact: "), details, F.lit("."),
    )


def alert_id(well: Column, timestamp: Column, detector: str) -> Column:
    """A repeatable id, so that a replayed reading yields the same alert."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(detector), well, F.unix_micros(timestamp)), 256), 1, 32)

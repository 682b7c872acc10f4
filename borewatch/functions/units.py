"""Unit conversions of production records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from borewatch.functions.severity import round_tie_even

# Conversion factors.
SM3_TO_BBL = 6.28981
BAR_TO_PSI = 14.5038
SM3_TO_SCF = 35.315


def oil_bopd(oil: Column) -> Column:
    return round_tie_even(oil * SM3_TO_BBL, 1)


def water_cut(oil: Column, water: Column) -> Column:
    """Percent of the liquid; 0 without liquid."""
    liquid = oil + water
    return F.when(liquid > 0, round_tie_even(water / liquid * 100, 1)).otherwise(F.lit(0.0))


def gas_oil_ratio(gas: Column, oil: Column) -> Column:
    """Standard cubic feet per barrel; 0 without oil."""
    return F.when(oil > 0, round_tie_even(gas * SM3_TO_SCF / (oil * SM3_TO_BBL), 0)).otherwise(F.lit(0.0))


def psi(bar: Column) -> Column:
    return round_tie_even(bar * BAR_TO_PSI, 0)


def fahrenheit(celsius: Column) -> Column:
    return round_tie_even(celsius * 9 / 5 + 32, 1)


def choke_64ths(percent: Column) -> Column:
    return round_tie_even(percent * 0.64, 0)


def is_producing(oil: Column) -> Column:
    return oil > 0


def month_start(year: Column, month: Column) -> Column:
    """First day of a month, null where year and month make no date."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lit("01"))
    return F.try_to_date(text, "yyyy-MM-dd")


def days_in_month(start: Column) -> Column:
    """30 where the date is invalid."""
    return F.coalesce(F.day(F.last_day(start)), F.lit(30))


def monthly_rates() -> dict[str, Column]:
    """Daily rates, water cut and gas-oil ratio from the monthly volumes and days_in_month."""
    oil, gas, water = (
        F.col(c) for c in ("oil_net_mill_sm3", "gas_net_bill_sm3", "produced_water_mill_sm3")
    )
    days = F.col("days_in_month")
    oil_rate = F.rint(oil * 1_000_000 * SM3_TO_BBL / days)
    water_rate = F.rint(water * 1_000_000 * SM3_TO_BBL / days)
    cut = round_tie_even(F.try_divide(water_rate, oil_rate + water_rate) * 100, 1)
    ratio = F.rint(F.try_divide(gas * 1e9 * SM3_TO_SCF, oil * 1e6 * SM3_TO_BBL))
    return {
        "oil_bopd": oil_rate,
        "water_bwpd": water_rate,
        "water_cut_pct": F.coalesce(cut, F.lit(0.0)),
        "gor_scf_bbl": F.coalesce(ratio, F.lit(0.0)),
    }

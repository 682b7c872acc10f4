"""Statistics of production tables: wells, fields, months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from borewatch.functions.fixed import FIELDS, FIELDS_DDL, PUBLISHED_DDL, PUBLISHED_STATISTICS
from borewatch.functions.severity import round_settled
from borewatch.schema import fixed_table


def last_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows per key; the limit is applied before the shuffle as well."""
    latest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_back", F.row_number().over(latest)).filter(F.col("_back") <= n).drop("_back")


def first_max(row: Column, value: str, order: list[str]) -> Column:
    """The row with the largest value; among equals the earliest (A5)."""
    return F.min_by(row, F.struct((-F.col(value)).alias("v"), *order))


def well_statistics(df: DataFrame) -> DataFrame:
    """Producing days, peaks, means and date range per well (A1)."""
    day = "yyyy-MM-dd"
    return (
        df.filter("is_producing")
        .groupBy("well_id")
        .agg(
            F.count(F.lit(1)).alias("producing_days"),
            F.max("oil_rate_bopd").alias("peak_oil_bopd"),
            F.avg("oil_rate_bopd").alias("avg_oil_bopd"),
            F.max("water_cut_pct").alias("peak_water_cut_pct"),
            F.avg("water_cut_pct").alias("avg_water_cut_pct"),
            F.avg("gas_oil_ratio").alias("avg_gor_scf_bbl"),
            F.coalesce(F.avg(F.when(F.col("bhp_psi") > 0, F.col("bhp_psi"))), F.lit(0.0)).alias("avg_bhp_psi"),
            F.concat(
                F.date_format(F.min("timestamp"), day), F.lit(" → "), F.date_format(F.max("timestamp"), day)
            ).alias("date_range"),
        )
    )


def peak_days(df: DataFrame, order: list[str]) -> DataFrame:
    """Per well the day of peak oil and the day of peak water cut (A5)."""
    row = F.struct("timestamp", "oil_rate_bopd", "water_cut_pct", "gas_oil_ratio")
    return (
        df.filter("is_producing")
        .groupBy("well_id")
        .agg(
            first_max(row, "oil_rate_bopd", order).alias("peak_oil"),
            first_max(row, "water_cut_pct", order).alias("peak_cut"),
        )
    )


def monthly_means(df: DataFrame, months: int | None = 48) -> DataFrame:
    """Days, mean oil rate and mean water cut per well and month; the last `months` months (A4)."""
    table = (
        df.withColumn("month", F.date_trunc("month", "timestamp"))
        .groupBy("well_id", "month")
        .agg(
            F.count("oil_rate_bopd").alias("days"),
            F.avg("oil_rate_bopd").alias("oil_bopd_mean"),
            F.avg("water_cut_pct").alias("wct_mean"),
        )
    )
    return table if months is None else last_rows(table, ["well_id"], ["month"], months)


def field_statistics(monthly: DataFrame) -> DataFrame:
    """Totals, first peak, mean and late water cut, gas-oil ratio and year span per field (A2)."""
    late = (
        last_rows(monthly, ["field_name"], ["year", "month"], 24)
        .groupBy("field_name")
        .agg(F.avg("water_cut_pct").alias("_late"))
    )
    total = F.sum("oil_net_mill_sm3") * 1e6 * 6.28981 / 1000
    peak = F.max("oil_bopd")
    year_of_peak = F.min_by("year", F.struct((-F.col("oil_bopd")).alias("v"), "year", "month"))
    whole = (
        monthly.groupBy("field_name")
        .agg(
            round_settled(total, 0).alias("total_oil_thousand_bbl"),
            F.when(peak > 0, F.rint(peak)).otherwise(F.lit(0.0)).alias("peak_oil_bopd"),
            F.when(peak > 0, year_of_peak).otherwise(F.lit(0)).alias("peak_year"),
            round_settled(F.avg("water_cut_pct"), 1).alias("avg_water_cut_pct"),
            round_settled(F.avg("gor_scf_bbl"), 0).alias("avg_gor_scf_bbl"),
            F.concat_ws("-", F.min("year").cast("string"), F.max("year").cast("string")).alias("production_years"),
            F.count(F.lit(1)).alias("months_of_data"),
        )
    )
    return whole.join(late, "field_name").withColumn(
        "late_field_water_cut_pct", round_settled(F.col("_late"), 1)
    ).drop("_late")


def period_context(monthly: DataFrame, field: str, year: int, month: int, bounded: bool = False) -> DataFrame:
    """The month of a field next to its baseline since the same month a year earlier (A3).

    As published the baseline has a lower bound only; `bounded` stops it before the month.
    """
    index = F.col("year") * 12 + F.col("month")
    asked = year * 12 + month
    is_current = index == asked
    in_baseline = index >= asked - 12
    if bounded:
        in_baseline = in_baseline & (index < asked)

    def current(name: str) -> Column:
        return F.max(F.when(is_current, F.col(name)))

    def mean(name: str) -> Column:
        return F.avg(F.when(in_baseline, F.col(name)))

    return (
        monthly.filter(F.upper("field_name") == field.upper())
        .groupBy("field_name")
        .agg(
            F.format_string("%d-%02d", F.lit(year), F.lit(month)).alias("period"),
            *[current(c).alias(f"current_{c}") for c in ("oil_bopd", "water_cut_pct", "gor_scf_bbl", "water_bwpd")],
            *[mean(c).alias(f"avg_{c}_12m") for c in ("oil_bopd", "water_cut_pct", "gor_scf_bbl")],
            F.max(F.when(in_baseline, F.col("oil_bopd"))).alias("max_oil_bopd_12m"),
        )
    )


def every_period_context(monthly: DataFrame, bounded: bool = False) -> DataFrame:
    """`period_context` for every month of every field at once, as one window per field.

    Months are one row each, so the window is as long as the calendar, not the data.
    """
    index = F.col("year") * 12 + F.col("month")
    frame = Window.partitionBy("field_name").orderBy("_index").rangeBetween(
        -12, -1 if bounded else Window.unboundedFollowing
    )
    return (
        monthly.withColumn("_index", index)
        .withColumns(
            {
                "avg_oil_bopd_12m": F.avg("oil_bopd").over(frame),
                "avg_water_cut_pct_12m": F.avg("water_cut_pct").over(frame),
                "avg_gor_scf_bbl_12m": F.avg("gor_scf_bbl").over(frame),
                "max_oil_bopd_12m": F.max("oil_bopd").over(frame),
            }
        )
        .drop("_index")
    )


def well_catalogue(telemetry: DataFrame) -> DataFrame:
    """First and last reading and their number per well and field, in order."""
    return (
        telemetry.groupBy("well_id", "field_name")
        .agg(
            F.min("timestamp").alias("first_reading"),
            F.max("timestamp").alias("last_reading"),
            F.count(F.lit(1)).alias("total_readings"),
        )
        .orderBy("field_name", "well_id")
    )


def field_dimension(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, FIELDS, FIELDS_DDL)


def published_statistics(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, PUBLISHED_STATISTICS, PUBLISHED_DDL)


def with_field_facts(names: DataFrame, measured: DataFrame) -> DataFrame:
    """Field names with their dimension row and statistics: measured ones, else published ones."""
    spark = names.sparkSession
    numbers = [c for c in published_statistics(spark).columns if c != "field_name"]
    known = F.broadcast(
        field_dimension(spark).join(
            published_statistics(spark).withColumnsRenamed({c: f"_p_{c}" for c in numbers}), "field_name", "left"
        ).withColumnRenamed("field_name", "_known")
    )
    ours = measured.select(F.col("field_name").alias("_ours"), *[F.col(c).alias(f"_m_{c}") for c in numbers])
    return (
        names.join(known, F.upper("field_name") == F.upper("_known"), "left")
        .join(ours, F.upper("field_name") == F.upper("_ours"), "left")
        .select(
            "field_name", "npdid", "block", "operator", "on_stream", "shut_in",
            *[F.coalesce(f"_m_{c}", f"_p_{c}").alias(c) for c in numbers],
            F.when(F.col("_ours").isNotNull(), "measured").when(F.col("_known").isNotNull(), "published").alias("basis"),
        )
    )

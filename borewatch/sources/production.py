"""Production records: daily and monthly scans (S1-S3), and the table cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from borewatch.functions import units
from borewatch.functions.fixed import DAILY_COLUMNS, FIELD_MONTHLY_COLUMNS, WELLBORE_MONTHLY_COLUMNS



def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """The daily file as landed (CSV with a header, every column text; or parquet)."""
    if path.rstrip("/").endswith(".csv"):
        schema = ", ".join(f"{c} STRING" for c in DAILY_COLUMNS)
        return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return spark.read.parquet(path).select(*DAILY_COLUMNS)


def normalise_daily(
    raw: DataFrame, producers_only: bool = True, min_on_stream_hrs: float = 1.0, missing_as_null: bool = False
) -> DataFrame:
    """Raw daily records -> telemetry.

    Records without date or well, of other flow kinds, or off stream are dropped; unreadable
    numbers become 0 and negative ones are clipped.  A missing temperature therefore reads as
    32 F; `missing_as_null` keeps it null instead.
    """

    def number(name: str) -> Column:
        return F.expr(f"try_cast({name} AS DOUBLE)")

    def volume(name: str) -> Column:
        return F.greatest(F.coalesce(number(name), F.lit(0.0)), F.lit(0.0))

    def gauge(name: str, convert) -> Column:
        value = convert(volume(name))
        return F.when(number(name).isNotNull(), value) if missing_as_null else value

    kept = raw.withColumn("_day", F.expr("try_cast(DATEPRD AS TIMESTAMP)")).filter(
        F.col("_day").isNotNull() & F.col("NPD_WELL_BORE_NAME").isNotNull()
    )
    if producers_only:
        kept = kept.filter(F.col("FLOW_KIND") == "production")
    kept = kept.filter(number("ON_STREAM_HRS") >= min_on_stream_hrs)
    oil, water, gas = volume("BORE_OIL_VOL"), volume("BORE_WAT_VOL"), volume("BORE_GAS_VOL")
    return kept.select(
        F.col("_day").alias("timestamp"),
        F.trim("NPD_WELL_BORE_NAME").alias("well_id"),
        F.coalesce("NPD_FIELD_NAME", F.lit("VOLVE")).alias("field_name"),
        number("ON_STREAM_HRS").alias("on_stream_hrs"),
        units.oil_bopd(oil).alias("oil_rate_bopd"),
        units.water_cut(oil, water).alias("water_cut_pct"),
        units.gas_oil_ratio(gas, oil).alias("gas_oil_ratio"),
        gauge("AVG_DOWNHOLE_PRESSURE", units.psi).alias("bhp_psi"),
        gauge("AVG_WHT_P", units.fahrenheit).alias("wh_temp_f"),
        gauge("AVG_CHOKE_SIZE_P", units.choke_64ths).alias("choke_64ths"),
        units.is_producing(oil).alias("is_producing"),
    )


def read_monthly(spark: SparkSession, path: str) -> DataFrame:
    """The monthly file as landed: semicolons, a header, every column text."""
    return spark.read.option("sep", ";").option("header", True).csv(path)


def normalise_monthly(
    raw: DataFrame,
    fields: list[str] | None = None,
    start_year: int = 2005,
    end_year: int = 2024,
    columns: dict[str, str] = FIELD_MONTHLY_COLUMNS,
) -> DataFrame:
    """Raw monthly records -> renamed, filtered, with daily rates."""
    df = raw.withColumnsRenamed({k: v for k, v in columns.items() if k in raw.columns})
    if "field_name" not in df.columns:
        raise ValueError("the monthly file has no field name column")
    df = df.withColumns({c: F.expr(f"try_cast({c} AS INT)") for c in ("year", "month")})
    df = df.filter(F.col("year").between(start_year, end_year))
    if fields:
        df = df.filter(F.upper("field_name").isin([f.strip().upper() for f in fields]))
    volumes = [c for c in df.columns if c.endswith("_sm3")]
    df = df.withColumns({c: F.coalesce(F.expr(f"try_cast({c} AS DOUBLE)"), F.lit(0.0)) for c in volumes})
    df = df.withColumn("date", units.month_start(F.col("year"), F.col("month")))
    df = df.withColumn("days_in_month", units.days_in_month(F.col("date")))
    if {"oil_net_mill_sm3", "gas_net_bill_sm3", "produced_water_mill_sm3"} <= set(df.columns):
        df = df.withColumns(units.monthly_rates())
    return df


def normalise_wellbore_monthly(raw: DataFrame, start_year: int = 2005, end_year: int = 2024) -> DataFrame:
    """The wellbore-level file under its own column map (S3)."""
    renamed = raw.withColumnRenamed("prfPrdWaterNetMillSm3", "prfPrdProducedWaterInFieldMillSm3")
    columns = {**WELLBORE_MONTHLY_COLUMNS, "prfPrdProducedWaterInFieldMillSm3": "produced_water_mill_sm3"}
    rated = normalise_monthly(renamed, None, start_year, end_year, columns)
    return rated.withColumnRenamed("produced_water_mill_sm3", "water_net_mill_sm3")


def save_cache(frames: dict[str, DataFrame], folder: str) -> None:
    """Write frames as parquet tables under one folder."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_cache(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame] | None:
    """The tables of a cache, or None if any is missing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        marker = hadoop(f"{folder}/{name}/_SUCCESS")
        if not marker.getFileSystem(configuration).exists(marker):
            return None
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def production_data(
    spark: SparkSession,
    raw_path: str,
    cache_folder: str,
    fields: list[str] | None = None,
    start_year: int = 2005,
    end_year: int = 2024,
    refresh: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Monthly rates and field statistics, from the cache unless absent or `refresh` is set."""
    from borewatch.operators.production_stats import field_statistics

    names = ["monthly", "statistics"]
    cached = None if refresh else load_cache(spark, cache_folder, names)
    if cached is None:
        monthly = normalise_monthly(read_monthly(spark, raw_path), fields, start_year, end_year)
        save_cache({"monthly": monthly, "statistics": field_statistics(monthly)}, cache_folder)
        cached = load_cache(spark, cache_folder, names)
    return cached["monthly"], cached["statistics"]

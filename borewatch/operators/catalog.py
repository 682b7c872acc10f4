"""Model versions: ranking, lookup, rollback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from borewatch.functions import decisions as dec

PRODUCTION, STAGING, ARCHIVED = "Production", "Staging", "Archived"


def latest_versions(versions: DataFrame) -> DataFrame:
    """Newest version per model and stage."""
    order = Window.partitionBy("model_name", "stage").orderBy(F.desc("version"))
    return versions.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def model_for_wells(wells: DataFrame, versions: DataFrame, fallback_to_staging: bool = True, prefix: str = dec.MODEL_PREFIX) -> DataFrame:
    """Per well its production model, else the staging one."""
    stages = [PRODUCTION, STAGING] if fallback_to_staging else [PRODUCTION]
    rank = F.when(F.col("stage") == PRODUCTION, 0).otherwise(1)
    usable = latest_versions(versions.filter(F.col("stage").isin(stages)))
    best = usable.groupBy("model_name").agg(F.min_by(F.struct("stage", "version"), rank).alias("_m"))
    named = wells.select("well_id", dec.model_name(F.col("well_id"), prefix).alias("model_name"))
    return named.join(best, "model_name", "left").select(
        "well_id",
        F.when(
            F.col("_m").isNotNull(),
            F.concat(F.lit("models:/"), F.col("model_name"), F.lit("/"), F.col("_m.version").cast("string")),
        ).alias("model_uri"),
        F.col("_m.stage").alias("stage"),
    )


def rollback_plan(versions: DataFrame) -> DataFrame:
    """Per model the stage changes of a rollback: production archived, the version before promoted.

    A model without production version, or without another one to promote, keeps its candidates
    null.
    """
    current = (
        versions.filter(F.col("stage") == PRODUCTION).groupBy("model_name").agg(F.max("version").alias("archive_version"))
    )
    others = (
        versions.join(current, "model_name")
        .filter((F.col("version") != F.col("archive_version")) & (F.col("stage") != ARCHIVED))
        .groupBy("model_name")
        .agg(F.max("version").alias("promote_version"))
    )
    return current.join(others, "model_name", "left").withColumn(
        "restored_uri",
        F.concat(F.lit("models:/"), F.col("model_name"), F.lit("/"), F.col("promote_version").cast("string")),
    )


def apply_rollback(versions: DataFrame) -> DataFrame:
    """The version table after `rollback_plan`."""
    plan = rollback_plan(versions)
    stage = (
        F.when(F.col("version") == F.col("archive_version"), ARCHIVED)
        .when(F.col("version") == F.col("promote_version"), PRODUCTION)
        .otherwise(F.col("stage"))
    )
    return versions.join(plan, "model_name", "left").withColumn("stage", stage).select(*versions.columns)


def judge(metrics: DataFrame) -> DataFrame:
    """Model metrics with gate_passed, justification and the stage they earn."""
    args = F.col("event_recall"), F.col("day_fpr"), F.col("data_granularity")
    return (
        metrics.withColumn("gate_passed", dec.meets_gate(*args))
        .withColumn("justification", dec.promotion_justification(*args))
        .withColumn("stage", F.when(F.col("gate_passed"), PRODUCTION).otherwise(STAGING))
    )

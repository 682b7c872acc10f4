"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "borewatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster the master, memory and shuffle parallelism come from spark-submit;
    only semantics (UTC) and adaptive execution are fixed here.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Without it workers find the package only where it is installed or on their path.  The worker
    that prepares a stateful stream runs beside the driver and reads no shipped files, so it is
    given the path as well.
    """
    context = spark.sparkContext
    if getattr(context, "_borewatch_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="borewatch-package-")) / "borewatch.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    paths = [context.environment.get("PYTHONPATH"), str(root.parent)]
    context.environment["PYTHONPATH"] = os.pathsep.join(p for p in paths if p)
    context._borewatch_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder checkpoint() writes to: the session's own, else a temporary one in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="borewatch-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise to the shared checkpoint folder, so that later reads see fixed rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_once(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet below the checkpoint folder and read them back.

    For tables that a loop joins with each other: a checkpoint keeps the estimated size of its plan, which such a loop
    would multiply from round to round, while files have the size they have.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a scan that has fewer partitions than the cluster has slots.

    For work that costs far more per row than moving the row, such as patterns over long texts.
    Inputs with enough splits, as large ones have, pass through unchanged.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df

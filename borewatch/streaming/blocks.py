"""Detection on a stream whose wells are cut into blocks of rows.

State of a well in one task holds as long as a trigger brings few rows of it.  Here a trigger is a small table: its rows
are numbered on from where the well stood, cut into blocks, and every block is diagnosed in a task of its own, with the
tail of the block before it.  Between triggers the tail of every well, the last rows that a window can reach, is handed on
as a table.  So a well with nearly all rows of a trigger is spread like any other table, and alerts are those of the batch
form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borewatch.operators import detect
from borewatch.operators.ordering import DEFAULT_BLOCK_ROWS, POS, KeyedSeries, join_null_safe
from borewatch.operators.rolling import V1_WINDOW
from borewatch.schema import FEATURES
from borewatch.session import cut_lineage

AT, NEW = "_at", "_new"


def diagnose_batches(
    schema: T.StructType,
    folder: str,
    key: str,
    order: list[str],
    features: list[str],
    ts: str,
    use_forest: bool = False,
    extra: tuple[str, ...] = (),
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: version 1 alerts of the batch into `folder`/alerts, under its id.

    The tail a batch leaves goes into one of two places in turn, so a batch that runs again finds the tail it found
    before.  The folder belongs to one checkpoint folder, as batch ids do.
    """
    halo = 168 + 72 if use_forest else V1_WINDOW
    columns = [f.name for f in schema.fields]
    tail_schema = T.StructType([*schema.fields, T.StructField(AT, T.LongType())])

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        tail = _tail(spark, folder, batch_id, tail_schema)
        size = max(block_rows, halo)
        numbered = KeyedSeries.build(batch.select(*columns), [key], order, block_rows=size)
        seen = tail.groupBy(key).agg(F.max(AT).alias("_seen"))
        rows = join_null_safe(numbered.rows(), seen, [key], "left").select(
            *columns, (F.coalesce("_seen", F.lit(0)) + F.col(POS)).cast("long").alias(AT), F.lit(True).alias(NEW)
        )
        # read by the diagnosis and by the tail
        rows = cut_lineage(tail.withColumn(NEW, F.lit(False)).unionByName(rows))
        series = KeyedSeries.from_ordinals(rows, [key], AT, True, halo, size)
        diagnosed = detect.diagnose_v1(series, features, use_forest).transform(lambda df: df.filter(NEW))
        detect.alerts_v1(diagnosed, features, key, ts, extra=extra).write.mode("overwrite").parquet(f"{folder}/alerts/batch={batch_id}")
        ends = rows.groupBy(key).agg(F.max(AT).alias("_end"))
        kept = join_null_safe(rows, ends, [key]).filter(F.col(AT) > F.col("_end") - halo).select(*columns, AT)
        kept.write.mode("overwrite").parquet(f"{folder}/tail-{batch_id % 2}/batch={batch_id}")

    return run


def _tail(spark: SparkSession, folder: str, batch_id: int, schema: T.StructType) -> DataFrame:
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    last = batch_id - 1
    return spark.read.schema(schema).parquet(f"{folder}/tail-{last % 2}/batch={last}")


def detect_in_blocks(
    stream: DataFrame,
    folder: str,
    checkpoint: str,
    key: str = "well_id",
    ts: str = "timestamp",
    order: list[str] | None = None,
    features: list[str] = FEATURES,
    use_forest: bool = False,
    extra: tuple[str, ...] = (),
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """Run what is available through the detector and return all alerts so far.

    Readings of one trigger are put into order; across triggers arrival counts.  What a trigger brings is bounded by
    the source (`maxFilesPerTrigger`, `maxBytesPerTrigger`), what a task holds by `block_rows`.
    """
    run = diagnose_batches(stream.schema, folder, key, order or [ts], features, ts, use_forest, extra, block_rows)
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.option("recursiveFileLookup", "true").parquet(f"{folder}/alerts")

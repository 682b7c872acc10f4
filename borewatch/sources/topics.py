"""Telemetry and alert topics: decoding, encoding, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from borewatch.schema import FEATURES, TELEMETRY_MESSAGE

# Topic names.
TELEMETRY_TOPIC = "well.telemetry"
ALERT_TOPIC = "well.anomalies"
ESCALATION_TOPIC = "agent.escalations"


def read_topic(spark: SparkSession, servers: str, topic: str = TELEMETRY_TOPIC, starting: str = "latest") -> DataFrame:
    """A Kafka topic as a stream; needs the Kafka package on the class path.

    Offsets live in the checkpoint of the query, which takes the place of a consumer group.
    """
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .load()
    )


def read_message_files(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Landed messages, one JSON object per line, as a stream with the `value` column of a topic."""
    reader = spark.readStream.schema("value STRING")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(folder)


def decode(messages: DataFrame) -> DataFrame:
    """Messages -> telemetry columns, `raw`, and `problem` (null where usable).

    A feature that is absent reads as 0, a null one is a problem; an absent well is "unknown".
    """
    raw = F.col("value").cast("string")
    parsed = F.from_json(raw, TELEMETRY_MESSAGE + ", _broken STRING", {"columnNameOfCorruptRecord": "_broken"})
    keys = F.json_object_keys("raw")
    staged = messages.select(raw.alias("raw"), parsed.alias("m")).withColumn("_keys", F.when(F.col("m._broken").isNull(), keys))

    def feature(name: str) -> Column:
        return F.when(F.array_contains("_keys", name), F.col(f"m.{name}")).otherwise(F.lit(0.0))

    ts = F.expr("try_cast(m.timestamp AS TIMESTAMP)")
    nulls = F.array_compact(F.array(*[F.when(feature(f).isNull(), F.lit(f)) for f in FEATURES]))
    problem = (
        F.when(F.col("_keys").isNull() | F.col("m").isNull(), F.lit("malformed message"))
        .when(ts.isNull(), F.lit("unreadable timestamp"))
        .when(F.size(nulls) > 0, F.concat(F.lit("null feature: "), F.array_join(nulls, ", ")))
    )
    return staged.select(
        ts.alias("timestamp"),
        F.coalesce("m.well_id", F.lit("unknown")).alias("well_id"),
        F.coalesce("m.field_name", F.lit("Unknown")).alias("field_name"),
        *[feature(f).alias(f) for f in FEATURES],
        "raw",
        problem.alias("problem"),
    )


def usable(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("problem").isNull()).drop("raw", "problem")


def quarantined(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("problem").isNotNull()).select("raw", "problem")


def encode(df: DataFrame, key: str = "well_id") -> DataFrame:
    """Rows -> key and JSON value; keyed, so that a well stays in one partition."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_topic(stream: DataFrame, servers: str, topic: str, checkpoint: str, key: str = "well_id") -> DataStreamWriter:
    return (
        encode(stream, key)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )


def send_frame(df: DataFrame, servers: str, topic: str = TELEMETRY_TOPIC) -> None:
    """Telemetry rows of a table to the topic."""
    encode(df).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def write_folder(stream: DataFrame, folder: str, checkpoint: str, file_format: str = "parquet") -> DataStreamWriter:
    return stream.writeStream.format(file_format).option("path", folder).option("checkpointLocation", checkpoint)

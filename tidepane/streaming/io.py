"""Topic-keyed streams in and out: files or Kafka, with the same rows as in batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

from tidepane.session import staging_path

MESSAGE_SCHEMA = "subject STRING, ts TIMESTAMP, value DOUBLE"


def read_stream(
    spark: SparkSession,
    source: str,
    schema: StructType | str | None = None,
    topics: Sequence[str] | None = None,
    fmt: str = "parquet",
    **options,
) -> DataFrame:
    """A stream of rows with a ``topic`` column.

    For files ``source`` is a folder, and ``topics`` keeps the rows of some topics. For Kafka it is
    the server list, ``topics`` are subscribed, and the JSON values are read with ``schema``.
    """
    if fmt == "kafka":
        raw = (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", source)
            .option("subscribe", ",".join(topics or ()))
            .options(**options)
            .load()
        )
        body = F.from_json(F.col("value").cast("string"), schema or MESSAGE_SCHEMA)
        return raw.select("topic", body.alias("_m")).select("topic", "_m.*")
    reader = spark.readStream.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    rows = reader.load(source)
    if topics is not None:
        rows = rows.filter(F.col("topic").isin(list(topics)))
    return rows


def write_stream(
    df: DataFrame,
    target: str,
    mode: str = "append",
    fmt: str = "parquet",
    checkpoint: str | None = None,
    available_now: bool = False,
    every: str = "10 seconds",
    **options,
) -> StreamingQuery:
    """Start writing a stream to files (``target`` is a folder) or to a Kafka topic.

    The file and Kafka sinks restart from the checkpoint folder, on shared storage.
    """
    checkpoint = checkpoint or staging_path(df.sparkSession, "stream-checkpoint")
    if fmt == "kafka":
        key = F.col("topic").cast("string") if "topic" in df.columns else F.lit(None).cast("string")
        df = df.select(key.alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))
        writer = df.writeStream.format("kafka").option("topic", target)
    else:
        writer = df.writeStream.format(fmt).option("path", target)
    writer = writer.options(**options).option("checkpointLocation", checkpoint).outputMode(mode)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def write_batches(
    df: DataFrame, target: str, mode: str = "update", checkpoint: str | None = None,
    available_now: bool = False, every: str = "10 seconds",
) -> StreamingQuery:
    """Write each micro-batch to ``target/batch=<id>``; a repeated batch overwrites itself.

    For update and complete mode, which the file sink does not take.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    checkpoint = checkpoint or staging_path(df.sparkSession, "stream-checkpoint")
    writer = df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode(mode)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all data present and return what it wrote, as a batch DataFrame."""
    spark = df.sparkSession
    target = staging_path(spark, "stream-output")
    schema = df.schema
    if mode == "append":
        query = write_stream(df, target, available_now=True)
    else:
        query = write_batches(df, target, mode, available_now=True)
        schema = StructType(schema.fields).add("batch", LongType())
    query.awaitTermination()
    return spark.read.schema(schema).parquet(target)

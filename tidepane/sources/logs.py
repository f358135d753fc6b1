"""Run logs: CSV readers and the result values written into log messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepane.operators.joins import attach

LOG_SCHEMA = "timestamp BIGINT, message STRING"
RESOURCE_SCHEMA = (
    "timestamp BIGINT, cpu_user DOUBLE, cpu_system DOUBLE, rss BIGINT, heapTotal BIGINT, "
    "heapUsed BIGINT, heapUsedMB DOUBLE, external BIGINT"
)


def _read_csv(spark: SparkSession, path: str, schema: str, header: bool) -> DataFrame:
    # Without column pruning every field is parsed, so a ragged row is found and dropped even if
    # the query needs one column only.
    return (
        spark.read.schema(schema)
        .option("header", header)
        .option("mode", "DROPMALFORMED")
        .option("columnPruning", False)
        .csv(path)
    )


def read_log_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``timestamp, message`` rows; rows with another number of fields are dropped."""
    return _read_csv(spark, path, LOG_SCHEMA, header)


def read_resource_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Resource samples; rows with another number of fields or non-numbers are dropped."""
    return _read_csv(spark, path, RESOURCE_SCHEMA, header)


# Signed and in exponent form too, so that negative results keep their sign.
_NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"


def _number_after(message: str | Column, prefix: str) -> Column:
    found = F.regexp_extract(message, prefix + _NUMBER, 1)
    return F.when(found != "", found).try_cast("double")


def unified_value(message: str) -> Column:
    """Value in a final-result message: ``unifiedResult``, else ``unifiedAverage``."""
    final = F.col(message).contains("Final aggregation results")
    return F.when(
        final,
        F.coalesce(
            _number_after(message, r'\\?"unifiedResult\\?":\s*'),
            _number_after(message, r'\\?"unifiedAverage\\?":\s*'),
        ),
    )


def published_unified(message: str) -> Column:
    # Fixed value: the prefix of these messages; what they name stands before the colon.
    return _number_after(message, r"Successfully published unified [^:]*:\s*")


def published_result(message: str) -> Column:
    return F.coalesce(
        _number_after(message, r"Successfully published result:\s*"),
        _number_after(message, r"Processing valid result:\s*"),
    )


def extract_results(
    log: DataFrame, kind: str, run: str = "run", message: str = "message"
) -> DataFrame:
    """Result values in log messages, with the other columns (run, position) kept.

    ``kind="approximation"`` takes final-result messages; a run without any falls back to its
    "Successfully published unified …" messages. ``kind="exact"`` takes published results.
    """
    if kind == "exact":
        found = log.withColumn("result", published_result(message))
        return found.filter(F.col("result").isNotNull())
    if kind != "approximation":
        raise ValueError("kind must be 'approximation' or 'exact'")
    found = log.withColumns(
        {"_final": unified_value(message), "_published": published_unified(message)}
    ).filter(F.col("_final").isNotNull() | F.col("_published").isNotNull())
    has_final = found.groupBy(run).agg(F.max(F.col("_final").isNotNull()).alias("_has_final"))
    return (
        attach(found, has_final, [run])
        .withColumn("result", F.when(F.col("_has_final"), F.col("_final")).otherwise(F.col("_published")))
        .filter(F.col("result").isNotNull())
        .drop("_final", "_published", "_has_final")
    )

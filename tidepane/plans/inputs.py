"""The given tables seen as sensor streams, in Spark and as the same SQL.

``events`` become observations: the event type is the topic, the event id the arrival order.
Sub-queries run ``[1 hour step 30 minutes]``, the registered query ``[2 hours step 1 hour]``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepane.operators.panes import pane_partials
from tidepane.operators.windows import sliding_agg
from tidepane.session import cut_lineage

SUB = ("1 hour", "30 minutes")
OUT = ("2 hours", "1 hour")
SCALE = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.concat(F.lit("obs"), F.col("event_id").cast("string")).alias("subject"),
        F.lit("events").alias("dataset"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("device"),
        F.lit("Measurement").alias("obs_type"),
        F.col("event_type").alias("property"),
        "ts",
        "value",
        F.col("event_type").alias("topic"),
        F.col("event_id").alias("arrival"),
    )


def shuffled(obs: DataFrame) -> DataFrame:
    """The same rows arriving out of order, by a fixed rule."""
    jitter = F.pmod(F.col("arrival") * 7919, F.lit(20)) * 3
    return obs.withColumn("arrival", (F.col("arrival") + jitter) * 100 + F.pmod("arrival", F.lit(100)))


def sub_results(spark: SparkSession, sf_dir: str, agg: str = "AVG") -> DataFrame:
    """Results of the sub-queries: ``(topic, w_start, w_end, value, n)``."""
    return sliding_agg(observations(spark, sf_dir), *SUB, agg, scale=SCALE)


def published(results: DataFrame) -> DataFrame:
    """Results saved once, as sub-queries publish them, for consumers that read them repeatedly."""
    return cut_lineage(results)


def shared_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partials from which both the sub-queries and the registered query are answered."""
    return published(pane_partials(observations(spark, sf_dir), [*SUB, *OUT], scale=SCALE))


def exact_results(spark: SparkSession, sf_dir: str, agg: str = "AVG") -> DataFrame:
    return sliding_agg(observations(spark, sf_dir), *OUT, agg, scale=SCALE)


# --- the same as SQL -------------------------------------------------------------------------

OBS = """obs AS (
  SELECT 'obs' || event_id AS subject, 'events' AS dataset, 'user' || user_id AS device,
         'Measurement' AS obs_type, event_type AS property, ts, value, event_type AS topic,
         event_id AS arrival, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS cents
  FROM events)"""

LATE = """late AS (
  SELECT * REPLACE ((arrival + (arrival * 7919) % 20 * 3) * 100 + arrival % 100 AS arrival)
  FROM obs)"""

HOUR = 3_600_000_000
MINUTE = 60_000_000

# Final value of each aggregate over obs rows, with exact sums.
SQL_AGG = {
    "AVG": "CAST(sum(cents) AS DOUBLE) / 100.0 / count(*)",
    "SUM": "CAST(sum(cents) AS DOUBLE) / 100.0",
    "COUNT": "CAST(count(*) AS DOUBLE)",
    "MIN": "min(value)",
    "MAX": "max(value)",
}


def sql_assigned(width_us: int, slide_us: int, name: str = "assigned", source: str = "obs") -> str:
    """One row per (row, window) of ``source``."""
    offset = (-width_us) % slide_us
    k = f"CAST(floor((us - {offset}) / {slide_us}.0) AS BIGINT) - i"
    fan_out = -(-width_us // slide_us)
    return f"""{name} AS (
  SELECT * FROM (
    SELECT *, make_timestamp(({k}) * {slide_us} + {offset}) AS w_start,
           make_timestamp(({k}) * {slide_us} + {offset} + {width_us}) AS w_end
    FROM {source}, range({fan_out}) r(i))
  WHERE ts < w_end)"""


def sql_windowed(agg: str, width_us: int, slide_us: int, name: str, source: str = "obs") -> str:
    return (
        sql_assigned(width_us, slide_us, f"{name}_in", source)
        + f""", {name} AS (
  SELECT topic, w_start, w_end, {SQL_AGG[agg]} AS value, count(*) AS n
  FROM {name}_in GROUP BY topic, w_start, w_end)"""
    )


def sql_sub(agg: str = "AVG") -> str:
    return sql_windowed(agg, HOUR, 30 * MINUTE, "sub")


def sql_exact(agg: str = "AVG") -> str:
    return sql_windowed(agg, 2 * HOUR, HOUR, "exact")


def with_sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body

"""Reshape series: order, re-timestamp, rescale, cut and disturb them."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepane.functions.timegrid import from_micros, micros, time_type
from tidepane.operators.joins import attach
from tidepane.operators.ordered import ordinal


def order_by_time(obs: DataFrame, ts: str = "ts", tie: Sequence[str] = ("subject",)) -> DataFrame:
    """All rows by time. Spark range-partitions first, so each task sorts its own time span."""
    return obs.orderBy(ts, *tie)


def retime(
    obs: DataFrame, start, hz: float, by: Sequence[str] = ("topic",), ts: str = "ts",
    tie: Sequence[str] = ("subject",), max_group_rows: int | None = None,
) -> DataFrame:
    """Replay times: the n-th row of a series is stamped ``start + (n - 1) / hz``."""
    dtype = time_type(obs, ts)
    step = round(1_000_000 / hz)
    numbered = ordinal(obs, by, [ts, *tie], "_n", max_group_rows)
    stamp = micros(F.lit(start).cast(dtype)) + (F.col("_n") - 1) * step
    return numbered.withColumn(ts, from_micros(stamp, dtype)).drop("_n")


def rescale(
    obs: DataFrame, lo: float, hi: float, by: Sequence[str] = ("topic",), value: str = "value"
) -> DataFrame:
    """Values stretched to ``[lo, hi]`` per series; a constant series gets the middle."""
    ranges = obs.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    share = F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), (lo + hi) / 2).otherwise(share * (hi - lo) + lo)
    return attach(obs, ranges, by).withColumn(value, scaled).drop("_lo", "_hi")


def prefixes(
    obs: DataFrame, sizes: Sequence[int] = (100, 500, 1000, 2000, 5000), by: Sequence[str] = ("topic",),
    ts: str = "ts", tie: Sequence[str] = ("subject",), max_group_rows: int | None = None,
) -> DataFrame:
    """The first N rows of each series for several N; sizes beyond a series are left out."""
    counts = obs.groupBy(*by).agg(F.count(F.lit(1)).alias("_count"))
    numbered = ordinal(obs, by, [ts, *tie], "n", max_group_rows).filter(F.col("n") <= max(sizes))
    fitting = F.filter(
        F.array(*[F.lit(s).cast("bigint") for s in sizes]),
        lambda s: (s >= F.col("n")) & (s <= F.col("_count")),
    )
    return attach(numbered, counts, by).withColumn("prefix", F.explode(fitting)).drop("_count")


def _uniform(key: Sequence[str], seed: int, stream: int):
    """Uniform in (0, 1] from 13 digits of a digest of the row key, the same on every run and partitioning.

    Any engine with MD5 gives the same number. Columns of the key are written as text and joined by ``|``.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed)), F.lit(str(stream)))
    digits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return (digits + 1) / F.lit(float(2**52))


def gaussian(key: Sequence[str], seed: int):
    """Standard normal by Box and Muller over two hashed uniforms."""
    radius = F.sqrt(-2 * F.log(_uniform(key, seed, 1)))
    return radius * F.cos(2 * pi * _uniform(key, seed, 2))


def add_noise(
    obs: DataFrame, sigma: float, seed: int = 0, key: Sequence[str] = ("subject",),
    value: str = "value", multiplicative: bool = False,
) -> DataFrame:
    """Gaussian noise of deviation ``sigma`` added to, or (``multiplicative``) scaled by, the value.

    Calls with different seeds draw apart; one level of several needs a seed of its own.
    """
    noise = gaussian(key, seed) * sigma
    noisy = F.col(value) * (1 + noise) if multiplicative else F.col(value) + noise
    return obs.withColumn(value, noisy)


def noise_levels(obs: DataFrame, by: Sequence[str] = ("topic",), value: str = "value") -> DataFrame:
    """Statistics per series and noise deviations of 5 % and 10 % of its spread."""
    stats = obs.groupBy(*by).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    return stats.withColumns(
        {
            "range": F.col("max") - F.col("min"),
            "low_noise": F.col("std") * 0.05,
            "medium_noise": F.col("std") * 0.10,
        }
    )

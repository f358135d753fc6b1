"""Trends and shapes of series, and resource usage over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepane.functions.grades import impact_band, trend_label
from tidepane.functions.timegrid import micros
from tidepane.operators.joins import attach
from tidepane.operators.ordered import first_n, ordinal, trailing_frames


def trend_slope(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str = "value",
    max_group_rows: int | None = None,
) -> DataFrame:
    """Least-squares slope over the position in the series, and its label."""
    numbered = ordinal(df.select(*by, *order, value), by, order, "_n", max_group_rows)
    slopes = numbered.groupBy(*by).agg(
        F.count(value).alias("points"), F.regr_slope(F.col(value), F.col("_n") - 1).alias("slope")
    )
    slopes = slopes.withColumn("slope", F.when(F.col("points") >= 2, F.col("slope")))
    return slopes.withColumn("trend", trend_label("slope"))


def trend_direction(df: DataFrame, by: Sequence[str], order: str, value: str = "value") -> DataFrame:
    """Whether the last value is above the first one; series of one point are left out."""
    ends = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(value, order).alias("first_value"),
        F.max_by(value, order).alias("last_value"),
    )
    rising = F.col("last_value") > F.col("first_value")
    return (
        ends.filter(F.col("_n") > 1)
        .withColumn("direction", F.when(rising, "increasing").otherwise("decreasing"))
        .drop("_n")
    )


def head_tail_trend(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str = "value", most: int = 10
) -> DataFrame:
    """Mean of the first and last tenth of a series (at most ten points each) and its change.

    Null for series with fewer than ten points.
    """
    valid = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, *order, value)
    sizes = valid.groupBy(*by).agg(
        F.least(F.lit(most), F.floor(F.count(F.lit(1)) * F.lit(0.1))).alias("_m")
    )

    def mean_of(ordering, name):
        kept = attach(first_n(valid, by, ordering, most, "_k"), sizes, by)
        return kept.groupBy(*by).agg(F.avg(F.when(F.col("_k") <= F.col("_m"), F.col(value))).alias(name))

    start = mean_of(list(order), "start_avg")
    end = mean_of([F.desc(c) for c in order], "end_avg")
    change = F.try_divide(F.col("end_avg") - F.col("start_avg"), F.col("start_avg")) * 100
    return (
        attach(start, end, by)
        .withColumn("change_pct", change)
        .withColumn(
            "trend",
            F.when(F.col("end_avg") > F.col("start_avg"), "Increasing").when(
                F.col("end_avg").isNotNull(), "Decreasing"
            ),
        )
    )


def rolling_stats(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str = "value",
    mean_rows: int = 50, std_rows: int = 100, max_group_rows: int | None = None,
) -> DataFrame:
    """Mean of the last 50 and sample deviation of the last 100 values; null until full."""
    frames = {
        "rolling_mean": (F.avg(value), mean_rows),
        "rolling_std": (F.stddev_samp(value), std_rows),
    }
    return trailing_frames(df, by, order, frames, max_group_rows)


def relative_seconds(df: DataFrame, by: Sequence[str], ts: str = "ts") -> DataFrame:
    """Adds ``rel_s``, seconds since the first row of the series."""
    firsts = df.groupBy(*by).agg(F.min(ts).alias("_first"))
    rel = (micros(ts) - micros("_first")) / F.lit(1_000_000)
    return attach(df, firsts, by).withColumn("rel_s", rel).drop("_first")


def bucket_means(
    a: DataFrame, b: DataFrame, by: Sequence[str], value: str = "value", width_s: int = 50, ts: str = "ts"
) -> DataFrame:
    """Means of two series per time bucket, where both have rows and both are still running."""
    def means(df, name):
        rel = relative_seconds(df, by, ts)
        bucket = F.floor(F.col("rel_s") / width_s).alias("bucket")
        ends = rel.groupBy(*by).agg(F.max("rel_s").alias(f"_end_{name}"))
        return rel.groupBy(*by, bucket).agg(F.avg(value).alias(name)).join(ends, list(by))

    both = means(a, "mean_a").join(means(b, "mean_b"), [*by, "bucket"])
    running = F.col("bucket") * width_s < F.least("_end_mean_a", "_end_mean_b")
    return both.filter(running).select(*by, "bucket", "mean_a", "mean_b")


def resource_compare(
    samples: DataFrame, metrics: Sequence[str], a: str, b: str, approach: str = "approach", ts: str = "timestamp"
) -> DataFrame:
    """Two approaches side by side, one row per metric.

    Improvement is how far the mean of ``a`` lies below that of ``b`` in percent, ``peak_diff_pct``
    how far its peak lies above; durations in seconds.
    """
    usage = samples.filter(F.col(approach).isin(a, b)).groupBy(approach).agg(
        ((F.max(ts) - F.min(ts)) / F.lit(1000)).alias("duration_s"),
        F.array(
            *[
                F.struct(F.lit(m).alias("metric"), F.avg(m).alias("avg"), F.max(m).cast("double").alias("max"))
                for m in metrics
            ]
        ).alias("_m"),
    )
    per_metric = usage.select(approach, "duration_s", F.explode("_m").alias("_m")).select(
        approach, "duration_s", "_m.*"
    )

    def side(name, column):
        return F.max(F.when(F.col(approach) == name, F.col(column)))

    out = per_metric.groupBy("metric").agg(
        side(a, "avg").alias("avg_a"), side(b, "avg").alias("avg_b"),
        side(a, "max").alias("max_a"), side(b, "max").alias("max_b"),
        side(a, "duration_s").alias("duration_a_s"), side(b, "duration_s").alias("duration_b_s"),
    )
    return out.withColumns(
        {
            "improvement_pct": F.try_divide(F.col("avg_b") - F.col("avg_a"), F.col("avg_b")) * 100,
            "peak_diff_pct": F.try_divide(F.col("max_a") - F.col("max_b"), F.col("max_b")) * 100,
        }
    )


def cpu_mem_summary(
    samples: DataFrame, by: Sequence[str], cpu: str = "cpu_usage", memory: str = "memory_usage"
) -> DataFrame:
    """Mean and maximum of CPU and memory over the rows that hold numbers; 0 without any."""
    def stat(fn, column):
        number = F.col(column).try_cast("double")
        return F.coalesce(fn(F.when(~F.isnan(number), number)), F.lit(0.0))

    return samples.groupBy(*by).agg(
        stat(F.avg, cpu).alias("avg_cpu"),
        stat(F.max, cpu).alias("max_cpu"),
        stat(F.avg, memory).alias("avg_memory"),
        stat(F.max, memory).alias("max_memory"),
        F.count(F.lit(1)).alias("samples"),
    )


def histogram(
    df: DataFrame, by: Sequence[str], value: str = "value", bins: int = 50
) -> DataFrame:
    """Counts and density in bins of equal width from minimum to maximum, empty bins included.

    The last bin includes its right border; a constant series gets one unit of width around it.
    """
    valid = df.filter(F.col(value).isNotNull()).select(*by, value)
    low, high = F.min(value), F.max(value)
    flat = low == high
    ranges = valid.groupBy(*by).agg(
        F.when(flat, low - 0.5).otherwise(low).alias("_lo"),
        F.when(flat, high + 0.5).otherwise(high).alias("_hi"),
        F.count(F.lit(1)).alias("_total"),
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))
    counts = (
        attach(valid, ranges, by).groupBy(*by, place.alias("bin")).agg(F.count(F.lit(1)).alias("_c"))
    )
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    filled = grid.join(counts, [*by, "bin"], "left").withColumn("count", F.coalesce("_c", F.lit(0)))
    return filled.select(
        *by,
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("left"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("right"),
        "count",
        (F.col("count") / (F.col("_total") * width)).alias("density"),
    )


def change_profile(
    df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str = "ts", value: str = "value",
    heads: Sequence[int] = (10, 50, 100), max_group_rows: int | None = None,
) -> DataFrame:
    """How a series changes: ends, extremes, early changes, and values at its quarters."""
    columns = dict.fromkeys([*by, *order, ts, value])
    numbered = ordinal(df.select(*columns), by, order, "_n", max_group_rows)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("points"))
    rows = attach(numbered, sizes, by)

    def at(position, name):
        return F.max(F.when(F.col("_n") == position, F.col(value))).alias(name)

    quarters = [
        at(F.floor(F.col("points") * F.lit(q)) + 1, f"value_{int(q * 100)}pct") for q in (0.25, 0.5, 0.75)
    ]
    span = (F.max(micros(ts)) - F.min(micros(ts))) / F.lit(1000)
    shape = rows.groupBy(*by).agg(
        F.max("points").alias("points"),
        at(1, "start_value"),
        at(F.col("points"), "end_value"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        span.alias("duration_ms"),
        *[at(n, f"_first_{n}") for n in heads],
        *quarters,
    )
    start = F.col("start_value")
    shape = shape.withColumn("change", F.col("end_value") - start)
    shape = shape.withColumns(
        {
            "change_pct": F.try_divide(F.col("change"), start) * 100,
            "mean_interval_ms": F.try_divide(F.col("duration_ms"), F.col("points") - 1),
            "change_per_s": F.try_divide(F.col("change"), F.col("duration_ms") / 1000),
            **{f"change_first_{n}": F.col(f"_first_{n}") - start for n in heads},
        }
    )
    return shape.drop(*[f"_first_{n}" for n in heads]).withColumn("impact", impact_band("change_pct"))

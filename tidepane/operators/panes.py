"""Shared panes: partial aggregates computed once, from which every window is answered."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepane.functions.aggregates import (
    check_aggregate,
    final,
    from_partials,
    merge_partials,
    partials,
)
from tidepane.functions.messages import is_result_triple, parse_result_value
from tidepane.functions.timegrid import (
    duration_us,
    explode_range,
    from_micros,
    interval,
    micros,
    pane_us,
    start_offset_us,
    time_type,
)


def pane_partials(
    obs: DataFrame,
    durations: Sequence[str | int],
    by: Sequence[str] = ("topic",),
    scale: int | None = None,
) -> DataFrame:
    """Count, sum, min and max per pane; the pane divides every width and slide in ``durations``.

    This is the only step that reads raw rows. Spark sums within each map task first, so a hot
    topic sends one row per pane and task.
    """
    width = interval(pane_us(*durations))
    return (
        obs.groupBy(F.window("ts", width).alias("_w"), *by)
        .agg(*partials("value", scale))
        .select(*by, F.col("_w.start").alias("p_start"), F.col("_w.end").alias("p_end"),
                "n", "sum", "min", "max")
    )


def to_windows(panes: DataFrame, width: str | int, slide: str | int) -> DataFrame:
    """One row per (pane, window that covers it)."""
    width_us, slide_us = duration_us(width), duration_us(slide)
    origin = start_offset_us(width_us, slide_us)
    dtype = time_type(panes, "p_start")
    at, end = micros("p_start"), micros("p_end")
    first = F.ceil((end - width_us - origin) / slide_us)
    last = F.floor((at - origin) / slide_us)
    starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array())
    start = F.col("_k") * slide_us + origin
    return (
        panes.withColumn("_k", F.explode(starts))
        .withColumns({"w_start": from_micros(start, dtype), "w_end": from_micros(start + width_us, dtype)})
        .drop("_k")
    )


#: Windows over one pane above which they are put together from running values of blocks instead of copies of panes.
DIRECT_WINDOWS = 8


def window_partials(
    panes: DataFrame, width: str | int, slide: str | int, by: Sequence[str], scale: int | None = None
) -> DataFrame:
    """``(*by, w_start, w_end, n, sum, min, max)`` of every window that has a pane.

    Few windows over a pane: each gets a copy. Many: the time line is cut into blocks as wide as a window. A window
    covers the end of a block and the beginning of the next one, so it is the running value backwards from the first
    one's end and forwards from the second one's beginning; nothing is taken off, so sums lose no digits and minima
    work like sums. A pane's running value serves all windows up to the next pane. So at most two rows for each window
    are made, however wide it is, and a group to be sorted is no longer than a window.
    """
    width_us, slide_us = duration_us(width), duration_us(slide)
    if width_us / slide_us <= DIRECT_WINDOWS:
        return to_windows(panes, width, slide).groupBy(*by, "w_start", "w_end").agg(*merge_partials(scale))
    unit = 1 if scale is None else float(10**scale)
    served = block_parts(panes, width, slide, by, scale)
    figures = served.groupBy(*by, "_k").agg(
        F.sum("n").alias("n"), (F.sum("_sum") / F.lit(unit) if scale is not None else F.sum("_sum")).alias("sum"),
        F.min("min").alias("min"), F.max("max").alias("max"),
    )
    dtype = time_type(panes, "p_start")
    start = F.col("_k") * slide_us + start_offset_us(width_us, slide_us)
    return figures.select(
        *by, from_micros(start, dtype).alias("w_start"), from_micros(start + width_us, dtype).alias("w_end"), "n", "sum", "min", "max"
    )


def block_parts(panes: DataFrame, width: str | int, slide: str | int, by: Sequence[str], scale: int | None = None) -> DataFrame:
    """``(*by, _k, n, _sum, min, max)``: the one or two parts of every window, ``_k`` its number on the grid of starts."""
    width_us, slide_us = duration_us(width), duration_us(slide)
    step = pane_us(width, slide)
    span, origin = width_us // step, start_offset_us(width_us, slide_us)
    addend = F.col("sum") if scale is None else F.round(F.col("sum") * float(10**scale)).cast("bigint")
    cell = F.floor(micros("p_start") / step)
    rows = panes.select(*by, "p_start", cell.alias("_i"), F.floor(cell / span).alias("_b"), "n", addend.alias("_sum"), "min", "max")
    block = Window.partitionBy(*by, "_b")
    ways = {"_ahead": block.orderBy("p_start"), "_back": block.orderBy(F.desc("p_start"))}
    sums = {"n": F.sum, "_sum": F.sum, "min": F.min, "max": F.max}
    rows = rows.withColumns(
        {f"{name}_{c}": f(c).over(way.rowsBetween(Window.unboundedPreceding, 0)) for name, way in ways.items() for c, f in sums.items()}
        | {"_before": F.lag("_i").over(ways["_ahead"]), "_after": F.lead("_i").over(ways["_ahead"])}
    )
    first = F.col("_b") * span
    both = rows.withColumn("_is_back", F.explode(F.array(F.lit(True), F.lit(False))))
    either = lambda back, ahead: F.when(F.col("_is_back"), back).otherwise(ahead)
    # starts served by the value up to the block's end, or by the value from its beginning
    low = either(F.greatest(F.col("_before") + 1, first), F.col("_i") - span + 1)
    high = either(F.col("_i"), F.least(F.col("_after") - span, first - 1))
    parts = both.select(
        *by,
        F.ceil((low * step - origin) / slide_us).alias("_low"),
        F.floor((high * step - origin) / slide_us).alias("_high"),
        *[either(F.col(f"_back_{c}"), F.col(f"_ahead_{c}")).alias(c) for c in sums],
    )
    return explode_range(parts, "_k", F.col("_low"), F.col("_high")).select(*by, "_k", *sums)


def rollup(
    panes: DataFrame,
    width: str | int,
    slide: str | int,
    agg: str,
    by: Sequence[str] = ("topic",),
    scale: int | None = None,
) -> DataFrame:
    """Exact window results from pane partials."""
    check_aggregate(agg)
    windows = window_partials(panes, width, slide, by, scale)
    return windows.select(*by, "w_start", "w_end", from_partials(agg).alias("value"), "n")


def pane_results(panes: DataFrame, agg: str) -> DataFrame:
    """The published result of every pane: its own aggregate, as a plain number."""
    return panes.withColumn("pane_value", from_partials(agg))


def chunk_combine(
    panes: DataFrame, width: str | int, slide: str | int, agg: str, by: Sequence[str] = ()
) -> DataFrame:
    """Combine pane *results* without weights: AVG is a mean of means, COUNT counts panes.

    Kept beside :func:`rollup` to measure how far the unweighted answer is off.
    """
    return (
        to_windows(panes, width, slide)
        .groupBy(*by, "w_start", "w_end")
        .agg(final(agg, "pane_value").alias("value"), F.count("pane_value").alias("n_panes"))
    )


def chunk_combine_by_topic(
    messages: DataFrame,
    width: str | int,
    slide: str | int,
    agg: str,
    by: Sequence[str] = ("topic",),
    message: str = "message",
) -> DataFrame:
    """The same per topic from result messages; bare numbers repeat a triple and are ignored.

    A window whose messages hold no triple keeps a row with a null value.
    """
    value = F.when(is_result_triple(message), parse_result_value(message))
    return chunk_combine(messages.withColumn("pane_value", value), width, slide, agg, by).withColumn(
        "value", F.when(F.col("n_panes") > 0, F.col("value"))
    )


def pane_completeness(
    panes: DataFrame,
    width: str | int,
    slide: str | int,
    sub_queries: int,
    pane: str | int,
) -> DataFrame:
    """Pane results present per window against the number expected from all sub-queries."""
    expected = ceil(duration_us(width) / duration_us(pane)) * sub_queries
    return (
        to_windows(panes, width, slide)
        .groupBy("w_start", "w_end")
        .agg(F.count(F.lit(1)).alias("n_panes"))
        .withColumn("expected", F.lit(expected).cast("bigint"))
        .withColumn("complete", F.col("n_panes") >= F.col("expected"))
    )


def exact_answer(
    obs: DataFrame,
    width: str | int,
    slide: str | int,
    agg: str,
    topics: Sequence[str] | None = None,
    scale: int | None = None,
) -> DataFrame:
    """Exact window results per topic and over all topics (``topic`` null, ``is_total``).

    Raw rows are read and shuffled once, into per-topic panes; both levels come from those panes.
    """
    chosen = obs if topics is None else obs.filter(F.col("topic").isin(list(topics)))
    partial = pane_partials(chosen, [width, slide], ["topic"], scale)
    total = (F.grouping("topic") == 1).alias("is_total")
    if duration_us(width) / duration_us(slide) > DIRECT_WINDOWS:
        levels = partial.groupingSets([["p_start", "p_end", "topic"], ["p_start", "p_end"]], "p_start", "p_end", "topic")
        windows = window_partials(levels.agg(*merge_partials(scale), total), width, slide, ["topic", "is_total"], scale)
    else:
        copies = to_windows(partial, width, slide)
        levels = copies.groupingSets([["w_start", "w_end", "topic"], ["w_start", "w_end"]], "w_start", "w_end", "topic")
        windows = levels.agg(*merge_partials(scale), total)
    return windows.select("topic", "is_total", "w_start", "w_end", from_partials(agg).alias("value"), "n")

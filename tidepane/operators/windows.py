"""Event-time windows: assignment, aggregation, reporting and relation-to-stream operators.

A window is half-open, ``[start, start + width)``, and starts lie on ``-width`` modulo ``slide``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepane.functions.aggregates import check_aggregate, final
from tidepane.functions.timegrid import (
    duration_us,
    explode_range,
    from_micros,
    interval,
    micros,
    start_offset_us,
    time_type,
)
from tidepane.operators.ordered import running_in, to_blocks
from tidepane.operators.panes import pane_partials, rollup


# Above this many windows per row, rows are summed into panes before they are copied to windows. Both plans give the
# same windows and values; sums of doubles have the same bits too if ``scale`` is given.
DIRECT_FAN_OUT = 4


def window_column(width: str | int, slide: str | int, ts: str = "ts") -> Column:
    """The windows of a time; for a slide wider than the window, the period it starts."""
    width_us, slide_us = duration_us(width), duration_us(slide)
    offset = interval(start_offset_us(width_us, slide_us))
    return F.window(ts, interval(max(width_us, slide_us)), interval(slide_us), offset)


def _covered(df: DataFrame, width: str | int, slide: str | int, ts: str = "ts") -> DataFrame:
    """Rows that lie in some window: all of them, unless there are gaps between windows."""
    width_us, slide_us = duration_us(width), duration_us(slide)
    if slide_us <= width_us:
        return df
    since_start = F.pmod(micros(ts) - start_offset_us(width_us, slide_us), F.lit(slide_us))
    return df.filter(since_start < width_us)


def _borders(df: DataFrame, window: str, width: str | int, slide: str | int) -> dict[str, Column]:
    start, end = F.col(f"{window}.start"), F.col(f"{window}.end")
    width_us = duration_us(width)
    if duration_us(slide) > width_us:
        dtype = df.select(start).schema[0].dataType.simpleString()
        end = from_micros(micros(start) + width_us, dtype)
    return {"w_start": start, "w_end": end}


def assign_windows(df: DataFrame, width: str | int, slide: str | int, ts: str = "ts") -> DataFrame:
    """One row per (row, window that contains it), with ``w_start`` and ``w_end``."""
    assigned = _covered(df, width, slide, ts).withColumn("_w", window_column(width, slide, ts))
    return assigned.withColumns(_borders(assigned, "_w", width, slide)).drop("_w")


def sliding_agg(
    obs: DataFrame,
    width: str | int,
    slide: str | int,
    agg: str,
    by: Sequence[str] = ("topic",),
    scale: int | None = None,
) -> DataFrame:
    """Aggregate of ``value`` per sliding window and ``by``: ``(*by, w_start, w_end, value, n)``.

    Wide, overlapping windows are answered from panes, so each raw row is touched once. The direct
    form also works on a streaming DataFrame.
    """
    check_aggregate(agg)
    fan_out = duration_us(width) / duration_us(slide)
    if fan_out > DIRECT_FAN_OUT and not obs.isStreaming:
        partial = pane_partials(obs, [width, slide], by, scale)
        return rollup(partial, width, slide, agg, by, scale)
    grouped = (
        _covered(obs, width, slide)
        .groupBy(window_column(width, slide), *by)
        .agg(final(agg, "value", scale).alias("value"), F.count("value").alias("n"))
    )
    borders = _borders(grouped, "window", width, slide)
    return grouped.select(*by, *[c.alias(name) for name, c in borders.items()], "value", "n")


def tumbling_agg(
    obs: DataFrame,
    width: str | int,
    agg: str,
    by: Sequence[str] = ("topic",),
    scale: int | None = None,
) -> DataFrame:
    return sliding_agg(obs, width, width, agg, by, scale)


def window_at(
    obs: DataFrame,
    probes: DataFrame,
    width: str | int,
    slide: str | int,
    by: Sequence[str] = ("topic",),
    probe: str = "probe_ts",
) -> DataFrame:
    """Content of the window active at each probe time.

    Of the non-empty windows with ``start <= probe <= end`` (end included) the one that ends first.
    Probes are matched to window starts on the grid, by equality.
    """
    width_us, slide_us = duration_us(width), duration_us(slide)
    assigned = assign_windows(obs, width, slide).withColumn("_start", micros("w_start"))
    open_windows = assigned.select(*by, "_start").distinct()
    origin = start_offset_us(width_us, slide_us)
    at = micros(probe)
    first = F.ceil((at - width_us - origin) / slide_us)
    last = F.floor((at - origin) / slide_us)
    candidates = probes.select(probe).distinct().withColumn(
        "_k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array()))
    )
    candidates = candidates.select(probe, (F.col("_k") * slide_us + origin).alias("_start"))
    active = (
        candidates.join(open_windows, "_start")
        .groupBy(probe, *by)
        .agg(F.min("_start").alias("_start"))
    )
    return assigned.join(active, [*by, "_start"]).drop("_start")


def running_window_agg(
    obs: DataFrame,
    width: str | int,
    slide: str | int,
    order: Sequence[str] = ("ts", "subject"),
    by: Sequence[str] = ("topic",),
    max_group_rows: int | None = None,
    scale: int | None = None,
) -> DataFrame:
    """Report on content change: the window's aggregate after each arriving row.

    With ``scale`` decimals the running sum is one of whole numbers, with equal bits however a window is cut into
    blocks; without it, sums of doubles depend on the order in which they are added.
    """
    addend = F.col("value") if scale is None else F.round(F.col("value") * float(10**scale)).cast("bigint")
    assigned = assign_windows(obs, width, slide).withColumns({"_one": F.lit(1).cast("bigint"), "_addend": addend})
    blocks = to_blocks(assigned, [*by, "w_start"], order, max_group_rows)
    running = running_in(
        blocks,
        {
            "run_count": ("sum", "_one"),
            "run_sum": ("sum", "_addend"),
            "run_min": ("min", "value"),
            "run_max": ("max", "value"),
        },
    )
    if scale is not None:
        running = running.withColumn("run_sum", F.col("run_sum") / F.lit(float(10**scale)))
    return running.withColumn("run_avg", F.col("run_sum") / F.col("run_count")).drop("_one", "_addend")


def rstream(relation: DataFrame, report_at: str = "w_end") -> DataFrame:
    """Relation to stream: the whole relation of each window, stamped with the time it is reported."""
    return relation.withColumn("emit_ts", F.col(report_at))


def _changes(
    relation: DataFrame, slide: str | int, content: Sequence[str], start: str
) -> DataFrame:
    """Copies of each content row in a window (``now``) and in the one a slide earlier (``before``).

    Each row is counted for its own window and for the next one, so both windows meet in one
    aggregation: the relation is read once and equal rows are summed before the shuffle.
    """
    dtype = time_type(relation, start)
    following = from_micros(micros(start) + duration_us(slide), dtype)
    seen = F.array(
        F.struct(F.col(start).alias("at"), F.lit(1).alias("now"), F.lit(0).alias("before")),
        F.struct(following.alias("at"), F.lit(0).alias("now"), F.lit(1).alias("before")),
    )
    return (
        relation.select(*content, F.explode(seen).alias("_s"))
        .groupBy(F.col("_s.at").alias(start), *content)
        .agg(F.sum("_s.now").alias("now"), F.sum("_s.before").alias("before"))
    )


def _surplus(
    changes: DataFrame, more: str, less: str, columns: Sequence[str], bag: bool
) -> DataFrame:
    if not bag:
        return changes.filter((F.col(more) > 0) & (F.col(less) == 0)).select(*columns)
    extra = F.col(more) - F.col(less)
    copies = explode_range(changes.filter(extra > 0), "_copy", F.lit(1), extra)
    return copies.select(*columns)


def istream(
    relation: DataFrame, slide: str | int, content: Sequence[str], start: str = "w_start",
    bag: bool = False,
) -> DataFrame:
    """Rows of a window that were not in the window one slide earlier; ``bag`` counts copies."""
    changes = _changes(relation, slide, content, start)
    return _surplus(changes, "now", "before", [start, *content], bag)


def dstream(
    relation: DataFrame, slide: str | int, content: Sequence[str], start: str = "w_start",
    bag: bool = False,
) -> DataFrame:
    """Rows of the window one slide earlier that are gone, stamped with the later window."""
    changes = _changes(relation, slide, content, start)
    return _surplus(changes, "before", "now", [start, *content], bag)


def classify_lateness(
    obs: DataFrame,
    max_delay: str | int,
    arrival: Sequence[str] = ("arrival",),
    by: Sequence[str] = ("topic",),
    max_group_rows: int | None = None,
) -> DataFrame:
    """Label each row by how far it lies behind the newest time that arrived before it."""
    blocks = to_blocks(obs, by, arrival, max_group_rows)
    seen = running_in(blocks, {"seen_ts": ("max", "ts")}, inclusive=False)
    behind = micros("seen_ts") - micros("ts")
    return seen.withColumn(
        "lateness",
        F.when(F.col("seen_ts").isNull() | (behind <= 0), "in_order")
        .when(behind <= duration_us(max_delay), "late")
        .otherwise("too_late"),
    )


def drop_late(
    obs: DataFrame,
    max_delay: str | int,
    arrival: Sequence[str] = ("arrival",),
    by: Sequence[str] = ("topic",),
    max_group_rows: int | None = None,
) -> DataFrame:
    """Rows that are in order or late by at most ``max_delay``."""
    labelled = classify_lateness(obs, max_delay, arrival, by, max_group_rows)
    return labelled.filter(F.col("lateness") != "too_late").drop("seen_ts", "lateness")


def watermark_progress(
    obs: DataFrame,
    arrival: Sequence[str] = ("arrival",),
    by: Sequence[str] = ("topic",),
    max_group_rows: int | None = None,
) -> DataFrame:
    """Newest event time seen up to each arrival; it never moves back."""
    return running_in(to_blocks(obs, by, arrival, max_group_rows), {"watermark": ("max", "ts")})


def expected_timing_filter(
    results: DataFrame,
    start: Column | str,
    period: str | int,
    tolerance: str | int,
    by: Sequence[str] = ("topic",),
    ts: str = "ts",
) -> DataFrame:
    """Results near the expected interval borders, at most one per interval.

    Accepting rows one by one (deviation within the tolerance, and a full period less the tolerance
    since the last accepted row) equals taking the first near-border row of each period as long as
    two tolerances are shorter than a period; other settings are refused.
    """
    period_us, tol_us = duration_us(period), duration_us(tolerance)
    if 2 * tol_us >= period_us:
        raise ValueError("the tolerance must be shorter than half the period")
    since = micros(ts) - micros(start)
    near = results.withColumn("_since", since).filter(
        (F.col("_since") >= 0) & (F.pmod("_since", F.lit(period_us)) <= tol_us)
    )
    first = F.min_by(F.struct(*results.columns), F.struct("_since", *results.columns))
    return (
        near.groupBy(*by, F.floor(F.col("_since") / period_us).alias("_period"))
        .agg(first.alias("_row"))
        .select("_row.*")
    )

"""The streaming forms of window aggregation, window relations, deduplication, merging and latest value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepane.functions.aggregates import check_aggregate, final, from_partials, merge_partials, partials
from tidepane.functions.timegrid import duration_us, explode_range, interval, micros, pane_us, start_offset_us
from tidepane.operators.windows import sliding_agg


def with_event_time(df: DataFrame, max_delay: str, ts: str = "ts") -> DataFrame:
    """Watermark on the event time; rows later than ``max_delay`` are dropped by Spark."""
    return df.withColumn(ts, F.timestamp_micros(micros(ts))).withWatermark(ts, max_delay)


def stream_sliding_agg(
    obs: DataFrame,
    width: str | int,
    slide: str | int,
    agg: str,
    max_delay: str,
    by: Sequence[str] = ("topic",),
    scale: int | None = None,
) -> DataFrame:
    """Window results of a stream.

    In append mode a window is reported once, when the watermark has passed its end; in update
    mode it is reported whenever its content changes.
    """
    return sliding_agg(with_event_time(obs, max_delay), width, slide, agg, by, scale)


def stream_dedupe(df: DataFrame, keys: Sequence[str], max_delay: str, ts: str = "ts") -> DataFrame:
    """Drop repeated rows that arrive within the delay; older keys leave the state."""
    return with_event_time(df, max_delay, ts).dropDuplicatesWithinWatermark(list(keys))


def stream_merge(
    win: DataFrame,
    sub_width: str | int,
    width: str | int,
    slide: str | int,
    agg: str,
    late_end: str = "late_end",
) -> DataFrame:
    """Time-aligned merge of streaming result windows into targets on the output grid.

    ``late_end`` is the last instant inside a result window (``window_time``) and carries the
    watermark. A target is a window over those instants that is wide enough to hold every result
    overlapping it, so it is reported, and leaves the state, once no such result can come any more.
    """
    kind = check_aggregate(agg)
    if kind == "COUNT":
        raise ValueError("the COUNT merge needs all borders of a target; see tidepane.streaming.live")
    sub_us, width_us, slide_us = duration_us(sub_width), duration_us(width), duration_us(slide)
    reach = F.window(
        late_end,
        interval(width_us + sub_us - 1),
        interval(slide_us),
        interval(start_offset_us(width_us, slide_us)),
    )
    rows = win.withColumn("window", reach)
    start = micros("window.start")
    end = micros(late_end) + 1
    overlap = F.least(end, start + width_us) - F.greatest(end - sub_us, start)
    value: Column = {
        "MIN": F.min("value"),
        "MAX": F.max("value"),
        "AVG": F.sum(F.col("value") * overlap) / F.sum(F.when(F.col("value").isNotNull(), overlap)),
        "SUM": F.sum(F.col("value") * overlap / sub_us),
    }[kind]
    return (
        rows.groupBy("window", "topic")
        .agg(value.alias("value"))
        .select(
            "topic",
            F.col("window.start").alias("t_start"),
            F.timestamp_micros(micros("window.start") + width_us).alias("t_end"),
            "value",
        )
    )


def stream_approximate(
    obs: DataFrame,
    sub: tuple[str, str],
    out: tuple[str, str],
    agg: str,
    max_delay: str,
) -> DataFrame:
    """Sub-query windows and their merge in one stream: two stateful steps under one watermark."""
    width, slide = sub
    kind = check_aggregate(agg)
    column = {"AVG": F.avg, "SUM": F.sum, "MIN": F.min, "MAX": F.max}[kind]("value")
    width_us, slide_us = duration_us(width), duration_us(slide)
    window = F.window(
        "ts", interval(width_us), interval(slide_us), interval(start_offset_us(width_us, slide_us))
    )
    results = (
        with_event_time(obs, max_delay)
        .groupBy(window.alias("window"), "topic")
        .agg(column.alias("value"))
        .select("topic", F.window_time("window").alias("late_end"), "value")
    )
    return stream_merge(results, width, *out, agg)


def stream_chunks(obs: DataFrame, pane: str, out: tuple[str, str], agg: str, max_delay: str) -> DataFrame:
    """Pane results and their unweighted combination over all topics in one stream: ``(w_start, w_end, value, n_panes)``.

    ``pane`` divides width and slide. A pane is reported when the watermark has passed it, and a window when it has
    passed its end, so the rows of closed windows are those of :func:`tidepane.operators.panes.chunk_combine`.
    """
    kind = check_aggregate(agg)
    width_us, slide_us = (duration_us(d) for d in out)
    if width_us % duration_us(pane) or slide_us % duration_us(pane):
        raise ValueError("a pane must divide the width and the slide of the windows")
    results = (
        with_event_time(obs, max_delay)
        .groupBy(F.window("ts", interval(duration_us(pane))).alias("window"), "topic")
        .agg(final(kind, "value").alias("pane_value"))
        .select(F.window_time("window").alias("late_end"), "pane_value")
    )
    grid = F.window("late_end", interval(width_us), interval(slide_us), interval(start_offset_us(width_us, slide_us)))
    return (
        results.groupBy(grid.alias("w"))
        .agg(final(kind, "pane_value").alias("value"), F.count("pane_value").alias("n_panes"))
        .select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "value", "n_panes")
    )


def stream_latest(obs: DataFrame, by: Sequence[str] = ("topic",), ts: str = "ts") -> DataFrame:
    """Newest value per topic so far; one row of state per topic. For update or complete mode."""
    return obs.groupBy(*by).agg(F.max(F.struct(ts, "value")).alias("_last")).select(
        *by, f"_last.{ts}", "_last.value"
    )


def _stream_changes(obs: DataFrame, width: str | int, slide: str | int, content: Sequence[str], max_delay: str) -> DataFrame:
    """Copies of each content row in a window (``now``) and in the one a slide earlier (``before``), as the window closes.

    A row in either of the two windows lies in their union, which is one window of ``width + slide``; so one stateful
    step gives both counts.
    """
    width_us, slide_us = duration_us(width), duration_us(slide)
    both = F.window("ts", interval(width_us + slide_us), interval(slide_us), interval(start_offset_us(width_us, slide_us)))
    start = micros("w.start") + slide_us
    rows = with_event_time(obs, max_delay).select(both.alias("w"), "ts", *content)
    now, before = micros("ts") >= start, micros("ts") < start - slide_us + width_us
    counted = rows.groupBy("w", *content).agg(
        F.sum(now.cast("bigint")).alias("now"), F.sum(before.cast("bigint")).alias("before")
    )
    return counted.select(F.timestamp_micros(start).alias("w_start"), *content, "now", "before")


def _more(changes: DataFrame, more: str, less: str, content: Sequence[str], bag: bool) -> DataFrame:
    if not bag:
        return changes.filter((F.col(more) > 0) & (F.col(less) == 0)).select("w_start", *content)
    extra = F.col(more) - F.col(less)
    return explode_range(changes.filter(extra > 0), "_copy", F.lit(1), extra).select("w_start", *content)


def stream_istream(
    obs: DataFrame, width: str | int, slide: str | int, content: Sequence[str], max_delay: str, bag: bool = False
) -> DataFrame:
    """Rows of each closed window that were not in the window one slide earlier: ``(w_start, *content)``.

    The rows are the content columns of ``obs``; ``bag`` counts copies. For append mode.
    """
    return _more(_stream_changes(obs, width, slide, content, max_delay), "now", "before", content, bag)


def stream_dstream(
    obs: DataFrame, width: str | int, slide: str | int, content: Sequence[str], max_delay: str, bag: bool = False
) -> DataFrame:
    """Rows of the window one slide earlier that are gone when a window closes, stamped with the later window."""
    return _more(_stream_changes(obs, width, slide, content, max_delay), "before", "now", content, bag)


def stream_exact(
    obs: DataFrame, width: str | int, slide: str | int, agg: str, max_delay: str, scale: int | None = None
) -> DataFrame:
    """Streaming form of :func:`tidepane.operators.panes.exact_answer`: windows per topic and over all topics.

    Raw rows are summed into panes per topic; closed panes go into the windows of their topic and of all topics, in a
    second stateful step under the same watermark. A window is reported when the watermark has passed its end.
    """
    width_us, slide_us = duration_us(width), duration_us(slide)
    panes = (
        with_event_time(obs, max_delay)
        .groupBy(F.window("ts", interval(pane_us(width, slide))).alias("p"), "topic")
        .agg(*partials("value", scale))
        .select(F.window_time("p").alias("at"), "topic", "n", "sum", "min", "max")
    )
    levels = F.explode(F.array(F.struct("topic", F.lit(False).alias("is_total")), F.struct(F.lit(None).cast("string").alias("topic"), F.lit(True).alias("is_total"))))
    both = panes.withColumn("level", levels)
    grid = F.window("at", interval(width_us), interval(slide_us), interval(start_offset_us(width_us, slide_us)))
    return (
        both.groupBy(grid.alias("w"), "level")
        .agg(*merge_partials(scale))
        .select("level.topic", "level.is_total", F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), from_partials(agg).alias("value"), "n")
    )

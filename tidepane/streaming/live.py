"""The approximation as one live stream: result messages or raw rows in, merged, unified and nested records out.

A stream of result windows is grouped by target and topic under one watermark, in state that Spark keeps on the JVM
side. When the watermark passes the last window that can overlap a target, all of the target's groups leave the state
in the same micro-batch. So a micro-batch holds whole targets, and what needs a whole target (the borders of a COUNT
merge in order, the values of all topics) is done there by the same DataFrame operators as in batch, however many
topics or borders it has.

What outlives a target is one row per topic, its newest value: a table for every micro-batch, see
:mod:`tidepane.streaming.tables`. A micro-batch that is run again answers the same targets from the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidepane.functions.aggregates import check_aggregate, final
from tidepane.functions.timegrid import duration_us, interval, micros, start_offset_us
from tidepane.operators import merge
from tidepane.session import drop_folder, staging_path
from tidepane.streaming.operators import with_event_time
from tidepane.streaming.tables import TableState

Params = Mapping[str, tuple[str | int, str]]


def message_windows(messages: DataFrame, params: Params, max_delay: str, ts: str = "ts") -> DataFrame:
    """Streaming form of :func:`tidepane.operators.merge.to_result_windows`, with the watermark on ``late_end``.

    A message is the window of its topic's query that ends at its arrival; messages of other topics are dropped.
    """
    stamped = messages.withColumn(ts, F.timestamp_micros(micros(ts)))
    windows = merge.to_result_windows(stamped, params, ts)
    return windows.withColumn("late_end", F.timestamp_micros(micros("w_end") - 1)).withWatermark("late_end", max_delay)


def sub_query_windows(obs: DataFrame, sub: tuple[str, str], agg: str, max_delay: str, scale: int | None = None) -> DataFrame:
    """Windows of one sub-query over raw rows, as :func:`message_windows` gives them for messages."""
    width_us, slide_us = duration_us(sub[0]), duration_us(sub[1])
    window = F.window("ts", interval(width_us), interval(slide_us), interval(start_offset_us(width_us, slide_us)))
    return (
        with_event_time(obs, max_delay)
        .groupBy(window.alias("w"), "topic")
        .agg(final(agg, "value", scale).alias("value"))
        .select("topic", F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "value", F.window_time("w").alias("late_end"))
    )


def closing_targets(windows: DataFrame, reach: str | int, width: str | int, slide: str | int, agg: str) -> DataFrame:
    """Groups of result windows per target and topic, each reported when the watermark has closed its target.

    ``reach`` is the widest result window: none that starts in a target ends later than that after it. All aggregates
    but COUNT keep one row of state per topic and target. COUNT keeps one per result window in it, with windows of
    equal borders summed up, since it needs the borders.
    """
    reach_us, width_us, slide_us = duration_us(reach), duration_us(width), duration_us(slide)
    if width_us < slide_us:
        raise ValueError("targets must not leave gaps between them")
    wide = F.window("late_end", interval(width_us + reach_us - 1), interval(slide_us), interval(start_offset_us(width_us, slide_us)))
    met = windows.withColumn("target", wide)
    start = micros("target.start")
    # windows in reach but past the target's end are in no part of it
    met = met.filter(micros("w_start") < start + width_us)
    if check_aggregate(agg) == "COUNT":
        grouped = met.groupBy("target", "topic", "w_start", "w_end").agg(F.sum("value").alias("value"), F.max("value").alias("most"))
        return grouped.select("topic", start.alias("t_us"), "w_start", "w_end", "value", "most")
    parts = {
        "o_start": F.greatest(micros("w_start"), start),
        "o_end": F.least(micros("w_end"), start + width_us),
        "w_us": micros("w_end") - micros("w_start"),
    }
    arrived = F.struct("w_end", "value")
    in_time = F.when(micros("w_end") <= start + width_us, arrived)
    grouped = met.withColumns(parts).groupBy("target", "topic").agg(
        merge.merged_value(agg).alias("merged"), F.max(arrived).alias("buffered"), F.max(in_time).alias("newest")
    )
    return grouped.select("topic", start.alias("t_us"), "merged", F.col("buffered.value").alias("buffered"), "newest")


def _parts(closed: DataFrame, agg: str, width_us: int, slide_us: int) -> DataFrame:
    """Rows of :func:`closing_targets` as :func:`tidepane.operators.merge.target_parts` gives them."""
    numbered = closed.withColumn("_k", F.floor((F.col("t_us") + width_us) / slide_us))
    if check_aggregate(agg) != "COUNT":
        return numbered.select("topic", "_k", "merged", "buffered", "newest")
    end = F.col("t_us") + width_us
    joined = numbered.withColumns(
        {
            "t_start": F.timestamp_micros("t_us"),
            "t_end": F.timestamp_micros(end),
            "o_start": F.greatest(micros("w_start"), F.col("t_us")),
            "o_end": F.least(micros("w_end"), end),
        }
    )
    counted = merge.merge_counts(joined).select("topic", F.floor(micros("t_end") / slide_us).alias("_k"), F.col("value").alias("merged"))
    arrived = F.struct("w_end", F.col("most").alias("value"))
    others = numbered.groupBy("topic", "_k").agg(
        F.max(arrived)["value"].alias("buffered"), F.max(F.when(micros("w_end") <= end, arrived)).alias("newest")
    )
    return counted.unionByName(others, allowMissingColumns=True)


#: What is written for the targets that closed: a function of the rows of merge.topic_targets().
Finish = Callable[[DataFrame], DataFrame]


def merged(rows: DataFrame) -> DataFrame:
    """``topic, t_start, t_end, value``: the merge of each topic and target."""
    return rows.filter(F.col("merged").isNotNull()).select("topic", "t_start", "t_end", F.col("merged").alias("value"))


def unified(agg: str) -> Finish:
    return partial(merge.unified, agg=agg)


def records(agg: str, expected_topics: int, style: str = "rate") -> Finish:
    return partial(merge.records, agg=agg, expected_topics=expected_topics, style=style)


class LiveTargets(TableState):
    """Answers the targets that closed in each micro-batch."""

    def __init__(self, folder: str, width: str | int, slide: str | int, agg: str, finish: Finish):
        super().__init__(folder)
        self.agg, self.finish = agg, finish
        self.width_us, self.slide_us = duration_us(width), duration_us(slide)

    def answer(self, rows: DataFrame, known: DataFrame | None, batch_id: int) -> None:
        last_k = (rows.agg(F.max("t_us")).first()[0] + self.width_us) // self.slide_us
        after_k = known.agg(F.max("_k")).first()[0] if known is not None else None
        targets = merge.targets_of(
            _parts(rows, self.agg, self.width_us, self.slide_us), self.width_us, self.slide_us, "timestamp",
            known=known, after_k=after_k, last_k=last_k,
        )
        targets = self.put("targets", targets, batch_id)
        self.put("out", self.finish(targets), batch_id)
        end = F.timestamp_micros(F.lit(last_k * self.slide_us))
        newest = targets.filter((F.col("t_end") == end) & F.col("latest_ts").isNotNull()).select(
            "topic", F.struct(F.col("latest_ts").alias("w_end"), F.col("latest").alias("value")).alias("newest"), F.lit(last_k).cast("bigint").alias("_k")
        )
        self.put("known", newest, batch_id)
        drop_folder(targets.sparkSession, self.at("targets", batch_id))


def start_live(
    windows: DataFrame, folder: str, reach: str | int, width: str | int, slide: str | int, agg: str, finish: Finish,
    available_now: bool = False, every: str = "10 seconds",
) -> StreamingQuery:
    """Start answering the targets of a stream of result windows; results stand in ``folder/out/batch=<id>``.

    ``finish`` is :func:`merged`, or what :func:`unified` or :func:`records` return. Started again with the same folder
    the stream goes on where it stopped.
    """
    groups = closing_targets(windows, reach, width, slide, agg)
    return LiveTargets(folder, width, slide, agg, finish).start(groups, available_now, every)


def drain_live(windows: DataFrame, reach, width, slide, agg: str, finish: Finish, folder: str | None = None) -> DataFrame:
    """Run :func:`start_live` over all data present and return its results so far."""
    spark = windows.sparkSession
    folder = folder or staging_path(spark, "live")
    start_live(windows, folder, reach, width, slide, agg, finish, available_now=True).awaitTermination()
    found = LiveTargets(folder, width, slide, agg, finish).results(spark)
    if found is not None:
        return found.drop("batch")
    nothing = StructType.fromDDL("topic string, t_start timestamp, t_end timestamp, merged double, buffered double, latest double, latest_ts timestamp")
    return finish(spark.createDataFrame([], nothing))

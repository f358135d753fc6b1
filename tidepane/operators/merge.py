"""Answer a wide window from overlapping results of smaller windows.

Result windows are ``(topic, w_start, w_end, value)`` rows; target windows ``[t_start, t_end)`` lie
on the grid of the output slide. A result meets only the few targets it overlaps: their grid
numbers are computed from its borders, so every join and group is on equal keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepane.functions.aggregates import check_aggregate
from tidepane.functions.timegrid import (
    duration_us,
    explode_range,
    from_micros,
    micros,
    start_offset_us,
    time_type,
)
from tidepane.operators.joins import attach
from tidepane.operators.ordered import (
    neighbour_in,
    ordinal,
    ordinal_in,
    to_blocks,
)
from tidepane.session import cut_lineage


def to_result_windows(
    results: DataFrame, params: Mapping[str, tuple[str | int, str]], ts: str = "ts"
) -> DataFrame:
    """A result message becomes the window that ends at its arrival.

    ``params`` gives the width and aggregate of each topic's query. Messages of other topics are
    dropped; the aggregate defaults to AVG.
    """
    widths = F.create_map(*[F.lit(x) for t, (w, _) in params.items() for x in (t, duration_us(w))])
    aggs = F.create_map(*[F.lit(x) for t, (_, a) in params.items() for x in (t, a or "AVG")])
    dtype = time_type(results, ts)
    known = results.withColumn("_width", widths[F.col("topic")]).filter(F.col("_width").isNotNull())
    return known.select(
        "topic",
        from_micros(micros(ts) - F.col("_width"), dtype).alias("w_start"),
        F.col(ts).alias("w_end"),
        "value",
        aggs[F.col("topic")].alias("agg"),
    )


def overlap_join(win: DataFrame, width: str | int, slide: str | int) -> DataFrame:
    """One row per (result window, target it overlaps), with the overlap ``[o_start, o_end)``.

    Overlap means ``w_end > t_start`` and ``w_start < t_end``. Times inside are microseconds.
    """
    width_us, slide_us = duration_us(width), duration_us(slide)
    origin = start_offset_us(width_us, slide_us)
    s, e = micros("w_start"), micros("w_end")
    first = F.floor((s - width_us - origin) / slide_us) + 1
    last = F.ceil((e - origin) / slide_us) - 1
    targets = F.when(first <= last, F.sequence(first, last)).otherwise(F.array())
    dtype = time_type(win, "w_start")
    t = F.col("_k") * slide_us + origin
    return win.withColumn("_k", F.explode(targets)).withColumns(
        {
            "t_start": from_micros(t, dtype),
            "t_end": from_micros(t + width_us, dtype),
            "o_start": F.greatest(s, t),
            "o_end": F.least(e, t + width_us),
            "w_us": e - s,
        }
    ).drop("_k")


_TARGET = ["topic", "t_start", "t_end"]


def merge_windows(win: DataFrame, width: str | int, slide: str | int, agg: str) -> DataFrame:
    """Time-aligned merge per topic and target: ``(topic, t_start, t_end, value)``.

    * MIN, MAX: of the overlapping values.
    * AVG: mean weighted by overlap; 0 without any overlap time.
    * SUM: a value is spread evenly over its window; the part inside the target counts.
    * COUNT: a value counts once for each elementary interval (between neighbouring window
      borders inside the target) that its window covers.
    """
    joined = overlap_join(win, width, slide)
    if check_aggregate(agg) == "COUNT":
        return merge_counts(joined)
    return joined.groupBy(*_TARGET).agg(merged_value(agg).alias("value"))


def merged_value(agg: str) -> Column:
    """Merge of the windows of a target, all aggregates but COUNT, from ``value, o_start, o_end, w_us``."""
    kind = check_aggregate(agg)
    overlap = F.col("o_end") - F.col("o_start")
    if kind in ("MIN", "MAX"):
        return {"MIN": F.min, "MAX": F.max}[kind]("value")
    if kind == "AVG":
        weight = F.when(F.col("value").isNotNull(), overlap)  # a window without a value has no weight
        return F.coalesce(F.try_divide(F.sum(F.col("value") * overlap), F.sum(weight)), F.lit(0.0))
    if kind == "SUM":
        share = F.when(F.col("w_us") > 0, F.col("value") * overlap / F.col("w_us"))
        return F.coalesce(F.sum(share), F.lit(0.0))
    raise ValueError("the COUNT merge needs the borders of a target, see merge_counts")


def merge_counts(joined: DataFrame) -> DataFrame:
    """COUNT merge of windows met with targets, without collecting the borders of a target.

    A window covers ``rank(end) - rank(start)`` elementary intervals, ranks being those of the
    distinct borders. So each window adds its value at its end and takes it off at its start;
    borders are summed first, then numbered, and the sum of net value times rank is the result.
    """
    borders = F.array(
        F.struct(F.col("o_start").alias("at"), (-F.col("value")).alias("net")),
        F.struct(F.col("o_end").alias("at"), F.col("value").alias("net")),
    )
    net = (
        joined.select(*_TARGET, F.explode(borders).alias("_b"))
        .groupBy(*_TARGET, F.col("_b.at").alias("at"))
        .agg(F.sum("_b.net").alias("net"))
    )
    # Saved once: the groups are measured before they are numbered.
    ranked = ordinal(cut_lineage(net), _TARGET, ["at"], "rank")
    return ranked.groupBy(*_TARGET).agg(F.sum(F.col("net") * F.col("rank")).alias("value"))


def merge_naive(win: DataFrame, width: str | int, slide: str | int, agg: str) -> DataFrame:
    """Unweighted aggregate of all overlapping values; COUNT is the number of windows.

    An aggregate that is not known is taken as AVG.
    """
    value = {
        "SUM": F.sum("value"),
        "COUNT": F.count("value").cast("double"),
        "MIN": F.min("value"),
        "MAX": F.max("value"),
    }.get(agg.upper(), F.avg("value"))
    return overlap_join(win, width, slide).groupBy(*_TARGET).agg(value.alias("value"))


def merge_pair(
    agg: str,
    first: tuple[Column, Column, Column],
    second: tuple[Column, Column, Column],
    overlap_value: Column,
    target: tuple[Column, Column],
) -> Column:
    """Merge two windows ``(start, end, value)`` and take off their overlap; durations in ms."""
    kind = check_aggregate(agg)
    (s1, e1, v1), (s2, e2, v2) = first, second
    if kind == "COUNT":
        return v1 + v2 - overlap_value
    if kind == "MIN":
        return F.least(v1, v2, overlap_value)
    if kind == "MAX":
        return F.greatest(v1, v2, overlap_value)

    def ms(start, end):
        return (micros(end) - micros(start)) / F.lit(1000)

    shared = F.greatest(F.lit(0), ms(F.greatest(s1, s2), F.least(e1, e2)))
    total = v1 * ms(s1, e1) + v2 * ms(s2, e2) - overlap_value * shared
    return total / ms(*target) if kind == "AVG" else total


def latest_by_topic(
    results: DataFrame, ts: str = "ts", by: Sequence[str] = ("topic",), value: str = "value"
) -> DataFrame:
    """Newest value per topic, kept however old it is."""
    newest = F.max_by(F.struct(ts, value), F.struct(ts, value)).alias("_last")
    return results.groupBy(*by).agg(newest).select(*by, f"_last.{ts}", f"_last.{value}")


def asof_latest(
    results: DataFrame,
    width: str | int,
    slide: str | int,
    ts: str = "ts",
    until=None,
    max_group_rows: int | None = None,
) -> DataFrame:
    """Newest value per topic as of each target end: ``(topic, t_start, t_end, latest, latest_ts)``.

    Results are first cut to the newest one per topic and slide, a size set by the time span and
    not by the number of results; the gaps up to the next result are then filled. The grid ends at
    the first target end at or after ``until`` (default: the newest result).
    """
    width_us, slide_us = duration_us(width), duration_us(slide)
    dtype = time_type(results, ts)
    if until is None:
        newest = results.agg(F.max(micros(ts))).first()[0]
    else:
        newest = results.sparkSession.range(1).select(micros(F.lit(until).cast(dtype))).first()[0]
    if newest is None:
        newest = 0
    last_k = -(-newest // slide_us)
    bucketed = results.withColumn("_k", F.ceil(micros(ts) / slide_us)).filter(F.col("_k") <= last_k)
    per_slide = (
        bucketed.groupBy("topic", "_k")
        .agg(F.max(F.struct(ts, "value")).alias("_last"))
        .select("topic", "_k", F.col("_last.value").alias("latest"), F.col(f"_last.{ts}").alias("latest_ts"))
    )
    filled = fill_slides(cut_lineage(per_slide), last_k, max_group_rows)
    end = F.col("_k") * slide_us
    return filled.select(
        "topic",
        from_micros(end - width_us, dtype).alias("t_start"),
        from_micros(end, dtype).alias("t_end"),
        "latest",
        "latest_ts",
    )


def fill_slides(per_slide: DataFrame, last_k: int, max_group_rows: int | None = None) -> DataFrame:
    """Saved rows ``topic, _k, …`` of some slides, repeated for the slides up to the topic's next one or ``last_k``."""
    following = neighbour_in(to_blocks(per_slide, ["topic"], ["_k"], max_group_rows), {"_next": "_k"}, step=1)
    until_next = F.coalesce(F.col("_next") - 1, F.lit(last_k))
    filled = explode_range(following, "_t", F.col("_k"), until_next)
    return filled.withColumn("_k", F.col("_t")).drop("_t", "_next")


def expire_windows(win: DataFrame, target_start: Column | str, strict: bool = False) -> DataFrame:
    """Drop windows that ended before the target starts; ``strict`` drops those that end there."""
    start = F.col(target_start) if isinstance(target_start, str) else target_start
    return win.filter(F.col("w_end") > start if strict else F.col("w_end") >= start)


def topic_targets(
    win: DataFrame, width: str | int, slide: str | int, agg: str, max_group_rows: int | None = None
) -> DataFrame:
    """What is known of every topic at every target: ``(topic, t_start, t_end, merged, buffered, latest)``.

    ``merged`` is the merge of the windows overlapping the target, ``buffered`` the newest of these, ``latest`` the
    newest value that arrived up to the target's end, however old; a window arrives at its end, and has a positive
    width. Windows meet the targets once and are grouped once. A target's newest arrival is among its own windows, so
    only the targets without one are filled from those before. A row may hold some of the three values only (the
    others null), but every value is in one row, so rows can be counted and combined as they are.
    """
    width_us, slide_us = duration_us(width), duration_us(slide)
    if width_us < slide_us:
        raise ValueError("targets must not leave gaps between them")
    joined = overlap_join(win, width, slide)
    return targets_of(target_parts(joined, agg, slide_us), width_us, slide_us, time_type(win, "w_start"), max_group_rows)


def target_parts(joined: DataFrame, agg: str, slide_us: int) -> DataFrame:
    """``(topic, _k, merged, buffered, newest)`` of windows met with targets; ``_k`` numbers the target ends."""
    arrived = F.struct("w_end", "value")
    known = [F.max(arrived)["value"].alias("buffered"), F.max(F.when(F.col("w_end") <= F.col("t_end"), arrived)).alias("newest")]
    end_k = F.floor(micros("t_end") / slide_us).alias("_k")
    if check_aggregate(agg) != "COUNT":
        return joined.groupBy("topic", "t_end").agg(merged_value(agg).alias("merged"), *known).withColumn("_k", end_k).drop("t_end")
    counted = merge_counts(joined).select("topic", end_k, F.col("value").alias("merged"))
    others = joined.groupBy("topic", "t_end").agg(*known).withColumn("_k", end_k).drop("t_end")
    return counted.unionByName(others, allowMissingColumns=True)


def targets_of(
    parts: DataFrame, width_us: int, slide_us: int, dtype: str, max_group_rows: int | None = None,
    known: DataFrame | None = None, after_k: int | None = None, last_k: int | None = None,
) -> DataFrame:
    """:func:`topic_targets` from the parts of their targets.

    ``known`` are ``topic, newest`` as of the target ``after_k``, the last one that is done already; filling ends at
    ``last_k``, by default the target of the newest arrival.
    """
    saved = cut_lineage(parts)
    newest = saved.filter(F.col("newest").isNotNull()).select("topic", "_k", "newest")
    if last_k is None:
        last_us = newest.agg(F.max(micros("newest.w_end"))).first()[0]
        last_k = -(-(last_us or 0) // slide_us)
        newest = newest.filter(F.col("_k") <= last_k)
    if known is not None:
        newest = cut_lineage(newest.unionByName(known.select("topic", F.lit(after_k).cast("bigint").alias("_k"), "newest")))
    filled = fill_slides(newest, last_k, max_group_rows)
    if after_k is not None:
        filled = filled.filter(F.col("_k") > after_k)
    latest = filled.select("topic", "_k", F.col("newest.value").alias("latest"), F.col("newest.w_end").alias("latest_ts"))
    rows = saved.select("topic", "_k", "merged", "buffered").unionByName(latest, allowMissingColumns=True)
    end = F.col("_k") * slide_us
    return rows.select(
        "topic", from_micros(end - width_us, dtype).alias("t_start"), from_micros(end, dtype).alias("t_end"),
        "merged", "buffered", "latest", "latest_ts",
    )


def unify(per_topic: DataFrame, latest: DataFrame, agg: str) -> DataFrame:
    """One value over all topics per target, from merged values and latest ones, see :func:`unified`."""
    merged = per_topic.select(*_TARGET, F.col("value").alias("merged"))
    return unified(merged.unionByName(latest.select(*_TARGET, "latest"), allowMissingColumns=True), agg)


def unified(rows: DataFrame, agg: str) -> DataFrame:
    """One value over all topics per target: ``(t_start, t_end, value, n_topics, used_latest)``.

    ``n_latest`` and ``n_merged`` count the topics with a latest and with a merged value.
    With two or more topics that ever sent a result, their latest raw values are used; the merged
    per-topic values count only when fewer are known. COUNT is the number of topics.
    """
    return rows.groupBy("t_start", "t_end").agg(*_over_topics(agg)).select(
        "t_start", "t_end", *_unified_columns(), "n_latest", "n_merged"
    )


def _over_topics(agg: str) -> list[Column]:
    combine = {"AVG": F.avg, "SUM": F.sum, "MIN": F.min, "MAX": F.max, "COUNT": F.count}[check_aggregate(agg)]
    return [
        F.count("latest").alias("n_latest"),
        F.count("merged").alias("n_merged"),
        combine("latest").cast("double").alias("of_latest"),
        combine("merged").cast("double").alias("of_merged"),
    ]


def _unified_columns() -> list[Column]:
    many = F.col("n_latest") >= 2
    value = F.coalesce(F.when(many, F.col("of_latest")).otherwise(F.col("of_merged")), F.lit(0.0))
    return [
        value.alias("value"),
        F.when(many, F.col("n_latest")).otherwise(F.col("n_merged")).alias("n_topics"),
        many.alias("used_latest"),
    ]


def buffered_latest(win: DataFrame, width: str | int, slide: str | int) -> DataFrame:
    """Newest value per topic among the windows still overlapping a target."""
    newest = F.max_by("value", F.struct("w_end", "value")).alias("buffered")
    return overlap_join(win, width, slide).groupBy(*_TARGET).agg(newest)


def individual_results(per_topic: DataFrame, buffered: DataFrame, latest: DataFrame) -> DataFrame:
    """The value of each topic and target, from the three sources, see :func:`individual`."""
    rows = (
        per_topic.select(*_TARGET, F.col("value").alias("merged"))
        .unionByName(buffered.select(*_TARGET, "buffered"), allowMissingColumns=True)
        .unionByName(latest.select(*_TARGET, "latest"), allowMissingColumns=True)
    )
    return individual(rows)


def individual(rows: DataFrame) -> DataFrame:
    """Per topic and target: merged value, else newest in the buffer, else newest ever.

    A value of 0 counts as missing and gives way to the next source; it stays 0 if all are 0.
    """
    sources = ("merged", "buffered", "latest")
    one = rows.groupBy(*_TARGET).agg(*[F.max(c).alias(c) for c in sources])
    present = [F.when(F.col(c) != 0, F.col(c)) for c in sources]
    return one.select(*_TARGET, F.coalesce(*present, *sources).alias("value"))


def target_coverage(
    win: DataFrame,
    width: str | int,
    slide: str | int,
    expected: int,
    elapsed: Column | None = None,
    grace: str | int = "3 seconds",
) -> DataFrame:
    """Topics with valid data per target against ``expected``, and whether to wait for more.

    Waiting goes on while topics are missing and less than a slide plus ``grace`` has passed since
    the last output; ``elapsed`` is an aggregate over a target's rows in microseconds, one slide if
    not given.
    """
    slide_us = duration_us(slide)
    passed = F.lit(slide_us) if elapsed is None else elapsed
    return (
        overlap_join(win, width, slide)
        .groupBy("t_start", "t_end")
        .agg(F.count_distinct("topic").alias("topics"), F.max("value").alias("_v"), passed.alias("_passed"))
        .select(
            "t_start",
            "t_end",
            "topics",
            F.lit(expected).cast("bigint").alias("expected"),
            (F.col("topics") >= expected).alias("complete"),
            ((F.col("topics") < expected) & (F.col("_passed") < slide_us + duration_us(grace))).alias("wait"),
        )
    )


def result_record(
    unified: DataFrame, individual: DataFrame, agg: str, expected_topics: int, style: str = "rate"
) -> DataFrame:
    """The nested output record per target, as a struct ``record`` and its JSON text.

    Only per-topic values are collected: one entry per topic and target. ``style="naive"`` uses
    the field names of the naive operator.
    """
    entries = individual.groupBy("t_start").agg(
        F.sort_array(F.collect_list(F.struct("topic", "value"))).alias("_entries"),
    )
    return _as_record(unified.join(entries, "t_start", "left"), agg, expected_topics, style)


def records(rows: DataFrame, agg: str, expected_topics: int, style: str = "rate") -> DataFrame:
    """:func:`result_record` of the rows of :func:`topic_targets`: one grouping by topic and target, one by target."""
    sources = ("merged", "buffered", "latest")
    one = rows.groupBy(*_TARGET).agg(*[F.max(c).alias(c) for c in sources])
    present = [F.when(F.col(c) != 0, F.col(c)) for c in sources]
    entry = F.struct("topic", F.coalesce(*present, *sources).alias("value"))
    entries = F.sort_array(F.collect_list(entry)).alias("_entries")
    per_target = one.groupBy("t_start", "t_end").agg(*_over_topics(agg), entries)
    unified = per_target.select("t_start", "t_end", *_unified_columns(), "n_latest", "n_merged", "_entries")
    return _as_record(unified, agg, expected_topics, style)


def _as_record(joined: DataFrame, agg: str, expected_topics: int, style: str) -> DataFrame:
    kind = check_aggregate(agg)
    window_name, topics_name, available = (
        ("window", "individualTopics", "availableTopics")
        if style == "rate"
        else ("windows", "individualResults", "allAvailableTopics")
    )
    names = F.transform("_entries", lambda e: e.topic)
    record = F.struct(
        (micros("t_end") / 1000).cast("bigint").alias("timestamp"),
        F.struct(
            (micros("t_start") / 1000).cast("bigint").alias("start"),
            (micros("t_end") / 1000).cast("bigint").alias("end"),
        ).alias(window_name),
        F.col("value").alias("unifiedResult"),
        (F.col("value") if kind == "AVG" else F.lit(None).cast("double")).alias("unifiedAverage"),
        F.lit(kind).alias("aggregationType"),
        F.map_from_entries("_entries").alias(topics_name),
        F.struct(
            F.col("n_merged").alias("validBuffers"),
            F.lit(expected_topics).alias("expectedTopics"),
            names.alias(available),
            F.col("n_topics").alias("topicCount"),
            (F.col("n_topics") >= 2).alias("hasMultipleTopics"),
            names.alias("latestValuesUsed"),
            F.col("n_latest").alias("globalValuesAvailable"),
            F.col("used_latest").alias("usingGlobalValues"),
        ).alias("metadata"),
    )
    return joined.select("t_start", "t_end", record.alias("record")).withColumn(
        "json", F.to_json("record")
    )


def adaptive_timeout(
    results: DataFrame,
    by: Sequence[str] = ("topic",),
    ts: str = "ts",
    min_samples: int = 3,
    multiplier: float = 0.5,
    fallback_ms: float = 5000,
    max_ms: float = 15000,
    tie: Sequence[str] = (),
    max_group_rows: int | None = None,
) -> DataFrame:
    """Mean time between results so far and the silence that counts as inactivity, per result.

    The mean of all gaps up to a result is its distance from the first one over the number of
    gaps, so only the position in the topic is needed.
    """
    blocks = to_blocks(results, by, [ts, *tie], max_group_rows)
    numbered = ordinal_in(blocks, "n")
    firsts = results.groupBy(*by).agg(F.min(ts).alias("_first"))
    rows = attach(numbered, firsts, by)
    first, last = micros("_first"), micros(ts)
    limit = adaptive_limit(first, last, F.col("n"), min_samples, multiplier, fallback_ms, max_ms)
    return rows.withColumns({"mean_interval_ms": _mean_interval(first, last, F.col("n")), "timeout_ms": limit}).drop("_first")


def _mean_interval(first: Column, last: Column, n: Column) -> Column:
    return F.try_divide((last - first) / F.lit(1000), n - 1)


def adaptive_limit(
    first: Column, last: Column, n: Column,
    min_samples: int = 3, multiplier: float = 0.5, fallback_ms: float = 5000, max_ms: float = 15000,
) -> Column:
    """Silence in ms that counts as inactivity after ``n`` results between two times in microseconds."""
    mean = _mean_interval(first, last, n)
    usable = (n >= min_samples) & (mean > 0)
    return F.when(usable, F.least(mean * multiplier, F.lit(float(max_ms)))).otherwise(F.lit(float(fallback_ms)))


def flag_gaps(
    timed: DataFrame,
    by: Sequence[str] = ("topic",),
    ts: str = "ts",
    tie: Sequence[str] = (),
    max_group_rows: int | None = None,
) -> DataFrame:
    """Mark results of :func:`adaptive_timeout` after which the topic fell silent too long."""
    blocks = to_blocks(timed, by, [ts, *tie], max_group_rows)
    rows = neighbour_in(blocks, {"next_ts": ts}, step=1)
    silence = (micros("next_ts") - micros(ts)) / F.lit(1000)
    return rows.withColumn("silence_ms", silence).withColumn(
        "gap", F.coalesce(silence > F.col("timeout_ms"), F.lit(False))
    )


def cap_duration(
    results: DataFrame,
    limit: str | int = "150 seconds",
    by: Sequence[str] = ("topic",),
    ts: str = "ts",
) -> DataFrame:
    """Results up to ``limit`` after the first one of their topic; later ones are cut off."""
    firsts = results.groupBy(*by).agg(F.min(ts).alias("_first"))
    rows = attach(results, firsts, by)
    return rows.filter(micros(ts) - micros("_first") <= duration_us(limit)).drop("_first")

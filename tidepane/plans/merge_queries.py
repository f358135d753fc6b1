"""Registered queries for merging results of sub-queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepane.functions.timegrid import from_micros, micros
from tidepane.operators import merge
from tidepane.operators.windows import sliding_agg
from tidepane.plans.catalog import query
from tidepane.plans.inputs import (
    MINUTE,
    OBS,
    OUT,
    observations,
    published,
    sql_sub,
    sql_windowed,
    sub_results,
    with_sql,
)

# The five topics of the events; they stand for the registered sub-queries.
TOPICS = ["click", "error", "purchase", "signup", "view"]

# Overlap of the sub-query results with the targets [2 hours step 1 hour].
_OVER = """over_t AS (
  SELECT * FROM (
    SELECT *, date_trunc('hour', w_start) + INTERVAL 1 HOUR * i AS t_start,
           date_trunc('hour', w_start) + INTERVAL 1 HOUR * i + INTERVAL 2 HOUR AS t_end
    FROM sub, range(-3, 3) r(i))
  WHERE w_end > t_start AND w_start < t_end),
parts AS (
  SELECT *, epoch_us(greatest(w_start, t_start)) AS o_start, epoch_us(least(w_end, t_end)) AS o_end,
         epoch_us(w_end) - epoch_us(w_start) AS w_us
  FROM over_t)"""


def _per_target(expression: str) -> str:
    return f"SELECT topic, t_start, t_end, {expression} AS value FROM parts GROUP BY ALL"


def _rounded(df):
    return df.withColumn("value", F.round("value", 8))


def _irregular(spark, sf_dir):
    """Results at any time: every event is a result of its topic's one-hour query."""
    results = observations(spark, sf_dir).select("topic", "ts", "value", "subject")
    params = {t: ("1 hour" if t != "view" else "30 minutes", "AVG") for t in TOPICS}
    return merge.to_result_windows(results, params)


_IRREGULAR = """sub AS (
  SELECT topic, ts - CASE WHEN topic = 'view' THEN INTERVAL 30 MINUTE ELSE INTERVAL 1 HOUR END AS w_start,
         ts AS w_end, value, 'AVG' AS agg FROM obs)"""


@query("e1_to_result_windows", with_sql("SELECT topic, w_start, w_end, value, agg FROM sub", OBS, _IRREGULAR))
def e1(spark, sf_dir):
    return _irregular(spark, sf_dir)


@query(
    "e2_overlap_join",
    with_sql(
        "SELECT topic, w_start, w_end, t_start, t_end, o_end - o_start AS overlap_us FROM parts",
        OBS, _IRREGULAR, _OVER,
    ),
)
def e2(spark, sf_dir):
    joined = merge.overlap_join(_irregular(spark, sf_dir), *OUT)
    overlap = (F.col("o_end") - F.col("o_start")).alias("overlap_us")
    return joined.select("topic", "w_start", "w_end", "t_start", "t_end", overlap)


@query("e3_merge_min", with_sql(_per_target("min(value)"), OBS, sql_sub("MIN"), _OVER))
def e3_min(spark, sf_dir):
    return merge.merge_windows(sub_results(spark, sf_dir, "MIN"), *OUT, "MIN")


@query("e3_merge_max", with_sql(_per_target("max(value)"), OBS, sql_sub("MAX"), _OVER))
def e3_max(spark, sf_dir):
    return merge.merge_windows(sub_results(spark, sf_dir, "MAX"), *OUT, "MAX")


_WEIGHTED = "round(sum(value * (o_end - o_start)) / sum(o_end - o_start), 8)"
_SPREAD = "round(sum(value * (o_end - o_start) / w_us), 8)"


@query("e4a_merge_avg", with_sql(_per_target(_WEIGHTED), OBS, sql_sub("AVG"), _OVER))
def e4a(spark, sf_dir):
    return _rounded(merge.merge_windows(sub_results(spark, sf_dir, "AVG"), *OUT, "AVG"))


@query("e4b_merge_sum", with_sql(_per_target(_SPREAD), OBS, sql_sub("SUM"), _OVER))
def e4b(spark, sf_dir):
    return _rounded(merge.merge_windows(sub_results(spark, sf_dir, "SUM"), *OUT, "SUM"))


_COVER = """borders AS (
  SELECT DISTINCT topic, t_start, unnest([o_start, o_end]) AS b FROM parts),
covered AS (
  SELECT p.topic, p.t_start, p.t_end, p.value, p.o_start, p.o_end, count(*) AS k
  FROM (SELECT row_number() OVER () AS id, * FROM parts) p
  JOIN borders b ON b.topic = p.topic AND b.t_start = p.t_start AND b.b >= p.o_start AND b.b < p.o_end
  GROUP BY p.id, p.topic, p.t_start, p.t_end, p.value, p.o_start, p.o_end)"""


@query(
    "e4c_merge_count",
    with_sql(
        "SELECT topic, t_start, t_end, CAST(sum(value * k) AS DOUBLE) AS value FROM covered GROUP BY ALL",
        OBS, sql_sub("COUNT"), _OVER, _COVER,
    ),
)
def e4c(spark, sf_dir):
    return merge.merge_windows(sub_results(spark, sf_dir, "COUNT"), *OUT, "COUNT")


@query(
    "e4c_merge_count_irregular",
    with_sql(
        """SELECT topic, t_start, t_end, round(CAST(sum(value * k) AS DOUBLE), 6) AS value
FROM covered GROUP BY ALL""",
        OBS, _IRREGULAR, _OVER, _COVER,
    ),
)
def e4c_irregular(spark, sf_dir):
    merged = merge.merge_windows(_irregular(spark, sf_dir), *OUT, "COUNT")
    return merged.withColumn("value", F.round("value", 6))


_PAIR = """pair AS (
  SELECT a.topic, a.w_start, a.w_end AS first_end, b.w_end AS last_end, a.value AS v1, b.value AS v2,
         o.value AS vo
  FROM sub a JOIN sub b ON a.topic = b.topic AND b.w_start = a.w_start + INTERVAL 30 MINUTE
  JOIN half o ON o.topic = a.topic AND o.w_start = b.w_start)"""


def _pairs(spark, sf_dir, agg):
    """Neighbouring sub-query results with the half hour they share."""
    win = published(sub_results(spark, sf_dir, agg))
    shift = from_micros(micros("w_start") - 30 * MINUTE)
    first = win.select("topic", "w_start", F.col("w_end").alias("first_end"), F.col("value").alias("v1"))
    second = win.select(
        "topic", shift.alias("w_start"), F.col("w_start").alias("second_start"),
        F.col("w_end").alias("last_end"), F.col("value").alias("v2"),
    )
    half = sliding_agg(observations(spark, sf_dir), "30 minutes", "30 minutes", agg, scale=2)
    half = half.select("topic", shift.alias("w_start"), F.col("value").alias("vo"))
    pairs = first.join(second, ["topic", "w_start"]).join(half, ["topic", "w_start"])
    value = merge.merge_pair(
        agg,
        (F.col("w_start"), F.col("first_end"), F.col("v1")),
        (F.col("second_start"), F.col("last_end"), F.col("v2")),
        F.col("vo"),
        (F.col("w_start"), F.col("last_end")),
    )
    return pairs.select("topic", "w_start", F.col("last_end").alias("w_end"), value.alias("value"))


def _pair_sql(agg: str, value: str) -> str:
    return with_sql(
        f"SELECT topic, w_start, last_end AS w_end, {value} AS value FROM pair",
        OBS, sql_sub(agg), sql_windowed(agg, 30 * MINUTE, 30 * MINUTE, "half"), _PAIR,
    )


@query(
    "e5_merge_pair_avg",
    _pair_sql("AVG", "round((v1 * 3600000 + v2 * 3600000 - vo * 1800000) / 5400000, 8)"),
)
def e5_avg(spark, sf_dir):
    return _rounded(_pairs(spark, sf_dir, "AVG"))


@query(
    "e5_merge_pair_sum",
    _pair_sql("SUM", "round(v1 * 3600000 + v2 * 3600000 - vo * 1800000, 2)"),
)
def e5_sum(spark, sf_dir):
    return _pairs(spark, sf_dir, "SUM").withColumn("value", F.round("value", 2))


@query("e5_merge_pair_count", _pair_sql("COUNT", "v1 + v2 - vo"))
def e5_count(spark, sf_dir):
    return _pairs(spark, sf_dir, "COUNT")


@query("e5_merge_pair_max", _pair_sql("MAX", "greatest(v1, v2, vo)"))
def e5_max(spark, sf_dir):
    return _pairs(spark, sf_dir, "MAX")


@query("e5_merge_pair_min", _pair_sql("MIN", "least(v1, v2, vo)"))
def e5_min(spark, sf_dir):
    return _pairs(spark, sf_dir, "MIN")


@query("e6_merge_naive_avg", with_sql(_per_target("round(avg(value), 9)"), OBS, sql_sub("AVG"), _OVER))
def e6_avg(spark, sf_dir):
    return merge.merge_naive(sub_results(spark, sf_dir), *OUT, "AVG").withColumn("value", F.round("value", 9))


@query("e6_merge_naive_count", with_sql(_per_target("CAST(count(*) AS DOUBLE)"), OBS, sql_sub("AVG"), _OVER))
def e6_count(spark, sf_dir):
    return merge.merge_naive(sub_results(spark, sf_dir), *OUT, "COUNT")


@query("e6_merge_naive_sum", with_sql(_per_target("round(sum(value), 6)"), OBS, sql_sub("SUM"), _OVER))
def e6_sum(spark, sf_dir):
    return merge.merge_naive(sub_results(spark, sf_dir, "SUM"), *OUT, "SUM").withColumn("value", F.round("value", 6))


@query("e6_merge_naive_min", with_sql(_per_target("min(value)"), OBS, sql_sub("MIN"), _OVER))
def e6_min(spark, sf_dir):
    return merge.merge_naive(sub_results(spark, sf_dir, "MIN"), *OUT, "MIN")


@query("e6_merge_naive_max", with_sql(_per_target("max(value)"), OBS, sql_sub("MAX"), _OVER))
def e6_max(spark, sf_dir):
    return merge.merge_naive(sub_results(spark, sf_dir, "MAX"), *OUT, "MAX")


@query(
    "e7_latest_by_topic",
    with_sql("SELECT topic, max(ts) AS ts, arg_max(value, ts) AS value FROM obs GROUP BY topic", OBS),
)
def e7_latest(spark, sf_dir):
    return merge.latest_by_topic(observations(spark, sf_dir))


_ASOF = """grid AS (
  SELECT topic, e AS t_end, e - INTERVAL 2 HOUR AS t_start FROM (
    SELECT topic, unnest(generate_series(date_trunc('hour', min(ts) - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR,
      (SELECT date_trunc('hour', max(ts) - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR FROM {0}), INTERVAL 1 HOUR)) AS e
    FROM {0} GROUP BY topic)),
asof_rows AS (
  SELECT g.topic, g.t_start, g.t_end, r.value AS latest, r.ts AS latest_ts
  FROM grid g ASOF JOIN {0} r ON g.topic = r.topic AND g.t_end >= r.ts)"""


@query(
    "e7_asof_latest",
    with_sql("SELECT topic, t_start, t_end, latest, latest_ts FROM asof_rows", OBS, _ASOF.format("obs")),
)
def e7_asof(spark, sf_dir):
    return merge.asof_latest(observations(spark, sf_dir).select("topic", "ts", "value"), *OUT)


@query(
    "e8_expire_windows",
    with_sql(
        "SELECT topic, w_start, w_end, value FROM sub WHERE w_end >= TIMESTAMP '2024-01-15 12:00:00'",
        OBS, sql_sub("AVG"),
    ),
)
def e8(spark, sf_dir):
    start = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return merge.expire_windows(sub_results(spark, sf_dir), start).drop("n")


@query(
    "e8_expire_windows_strict",
    with_sql(
        "SELECT topic, w_start, w_end, value FROM sub WHERE w_end > TIMESTAMP '2024-01-15 12:00:00'",
        OBS, sql_sub("AVG"),
    ),
)
def e8_strict(spark, sf_dir):
    start = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return merge.expire_windows(sub_results(spark, sf_dir), start, strict=True).drop("n")


# Sub-query results arrive when their window ends.
_ARRIVED = "arrived AS (SELECT topic, w_end AS ts, value FROM sub)"


def _unify_sql(agg: str, sub: str, merged: str, combine: str) -> str:
    return with_sql(
        f"""SELECT t_start, t_end, coalesce(CASE WHEN n_latest >= 2 THEN round(of_latest, 8) ELSE round(of_merged, 8) END, 0.0) AS value,
  CASE WHEN n_latest >= 2 THEN n_latest ELSE n_merged END AS n_topics, n_latest >= 2 AS used_latest
FROM (SELECT t_start, t_end, count(latest) AS n_latest, count(merged) AS n_merged,
             CAST({combine.format('latest')} AS DOUBLE) AS of_latest, CAST({combine.format('merged')} AS DOUBLE) AS of_merged
      FROM asof_rows FULL JOIN merged USING (topic, t_start, t_end) GROUP BY t_start, t_end)""",
        OBS, sql_sub(sub), _ARRIVED, _OVER, _ASOF.format("arrived"),
        f"merged AS (SELECT topic, t_start, t_end, {merged} AS merged FROM parts GROUP BY ALL)",
    )


def _unify(spark, sf_dir, agg):
    rows = merge.topic_targets(sub_results(spark, sf_dir, agg), *OUT, agg)
    return _rounded(merge.unified(rows, agg)).drop("n_latest", "n_merged")


@query("e9_unify_avg", _unify_sql("AVG", "AVG", _WEIGHTED, "avg({})"))
def e9_avg(spark, sf_dir):
    return _unify(spark, sf_dir, "AVG")


@query("e9_unify_max", _unify_sql("MAX", "MAX", "max(value)", "max({})"))
def e9_max(spark, sf_dir):
    return _unify(spark, sf_dir, "MAX")


@query("e9_unify_min", _unify_sql("MIN", "MIN", "min(value)", "min({})"))
def e9_min(spark, sf_dir):
    return _unify(spark, sf_dir, "MIN")


@query(
    "e9_unify_count",
    _unify_sql("COUNT", "COUNT", "CAST(sum(value * k) AS DOUBLE)", "count({})").replace(
        "merged AS (SELECT topic, t_start, t_end, CAST(sum(value * k) AS DOUBLE) AS merged FROM parts",
        _COVER + ",\nmerged AS (SELECT topic, t_start, t_end, CAST(sum(value * k) AS DOUBLE) AS merged FROM covered",
    ),
)
def e9_count(spark, sf_dir):
    """The number of topics, whose merged values are COUNT merges."""
    return _unify(spark, sf_dir, "COUNT")


@query("e9_unify_sum", _unify_sql("SUM", "SUM", _SPREAD, "sum({})"))
def e9_sum(spark, sf_dir):
    return _unify(spark, sf_dir, "SUM")


@query(
    "e10_individual_results",
    with_sql(
        """SELECT topic, t_start, t_end, round(coalesce(nullif(merged, 0), nullif(buffered, 0), nullif(latest, 0),
  merged, buffered, latest), 8) AS value
FROM asof_rows FULL JOIN merged USING (topic, t_start, t_end)""",
        OBS, sql_sub("AVG"), _ARRIVED, _OVER, _ASOF.format("arrived"),
        f"""merged AS (SELECT topic, t_start, t_end, {_WEIGHTED} AS merged,
  arg_max(value, w_end) AS buffered FROM parts GROUP BY ALL)""",
    ),
)
def e10(spark, sf_dir):
    return _rounded(merge.individual(merge.topic_targets(sub_results(spark, sf_dir), *OUT, "AVG")))


@query(
    "e11_target_coverage",
    with_sql(
        """SELECT t_start, t_end, count(DISTINCT topic) AS topics, CAST(5 AS BIGINT) AS expected,
  count(DISTINCT topic) >= 5 AS complete, count(DISTINCT topic) < 5 AS wait
FROM parts GROUP BY t_start, t_end""",
        OBS, sql_sub("AVG"), _OVER,
    ),
)
def e11(spark, sf_dir):
    return merge.target_coverage(sub_results(spark, sf_dir), *OUT, expected=len(TOPICS))


@query(
    "e12_result_record",
    with_sql(
        """SELECT t_start, t_end, epoch_ms(t_end) AS at_ms, epoch_ms(t_start) AS start_ms, epoch_ms(t_end) AS end_ms,
  CAST(coalesce(CASE WHEN n_latest >= 2 THEN of_latest ELSE of_merged END, 0.0) AS DOUBLE) AS result, true AS without_average,
  'MAX' AS kind, individual, n_merged AS valid_buffers, 5::BIGINT AS expected, names AS available,
  CASE WHEN n_latest >= 2 THEN n_latest ELSE n_merged END AS topic_count,
  CASE WHEN n_latest >= 2 THEN n_latest ELSE n_merged END >= 2 AS several, names AS used, n_latest AS available_latest,
  n_latest >= 2 AS using_latest
FROM (
  SELECT t_start, t_end, count(latest) AS n_latest, count(merged) AS n_merged, max(latest) AS of_latest, max(merged) AS of_merged,
    string_agg(topic, ',' ORDER BY topic) AS names, string_agg(topic || '=' || printf('%.2f', coalesce(nullif(merged, 0),
      nullif(buffered, 0), nullif(latest, 0), merged, buffered, latest)), ';' ORDER BY topic) AS individual
  FROM asof_rows FULL JOIN merged USING (topic, t_start, t_end) GROUP BY t_start, t_end)""",
        OBS, sql_sub("MAX"), _ARRIVED, _OVER, _ASOF.format("arrived"),
        """merged AS (SELECT topic, t_start, t_end, max(value) AS merged, arg_max(value, w_end) AS buffered
  FROM parts GROUP BY ALL)""",
    ),
)
def e12(spark, sf_dir):
    """Every field of the nested record, read back out of its JSON text."""
    rows = merge.topic_targets(sub_results(spark, sf_dir, "MAX"), *OUT, "MAX")
    return read_record(merge.records(rows, "MAX", len(TOPICS)))


def read_record(record):
    """The fields of the JSON text as columns."""
    def read(path: str, kind: str):
        return F.get_json_object("json", f"$.{path}").cast(kind)

    def names(path: str):
        return F.array_join(F.from_json(read(path, "string"), "array<string>"), ",")

    topics = F.from_json(read("individualTopics", "string"), "map<string,double>")
    entries = F.transform(
        F.array_sort(F.map_entries(topics)), lambda e: F.format_string("%s=%.2f", e["key"], e["value"])
    )
    return record.select(
        "t_start",
        "t_end",
        read("timestamp", "bigint").alias("at_ms"),
        read("window.start", "bigint").alias("start_ms"),
        read("window.end", "bigint").alias("end_ms"),
        read("unifiedResult", "double").alias("result"),
        F.col("record.unifiedAverage").isNull().alias("without_average"),
        read("aggregationType", "string").alias("kind"),
        F.array_join(entries, ";").alias("individual"),
        read("metadata.validBuffers", "bigint").alias("valid_buffers"),
        read("metadata.expectedTopics", "bigint").alias("expected"),
        names("metadata.availableTopics").alias("available"),
        read("metadata.topicCount", "bigint").alias("topic_count"),
        read("metadata.hasMultipleTopics", "boolean").alias("several"),
        names("metadata.latestValuesUsed").alias("used"),
        read("metadata.globalValuesAvailable", "bigint").alias("available_latest"),
        read("metadata.usingGlobalValues", "boolean").alias("using_latest"),
    )


_TIMEOUT = """timed AS (
  SELECT topic, subject, ts, row_number() OVER w AS n,
         CASE WHEN row_number() OVER w > 1
              THEN (us - min(us) OVER w) / 1000.0::DOUBLE / (row_number() OVER w - 1) END AS mean_ms
  FROM obs WINDOW w AS (PARTITION BY topic ORDER BY ts, subject ROWS UNBOUNDED PRECEDING)),
timeouts AS (
  SELECT *, CASE WHEN n >= 3 AND mean_ms > 0 THEN least(mean_ms * 0.5::DOUBLE, 7200000.0::DOUBLE)
            ELSE 3600000.0::DOUBLE END AS timeout_ms FROM timed)"""


def _timed(spark, sf_dir):
    results = observations(spark, sf_dir).select("topic", "subject", "ts")
    return merge.adaptive_timeout(
        results, tie=["subject"], fallback_ms=3_600_000, max_ms=7_200_000
    )


@query(
    "e13_adaptive_timeout",
    with_sql(
        """SELECT topic, subject, ts, n, mean_ms AS mean_interval_ms, timeout_ms FROM timeouts""",
        OBS, _TIMEOUT,
    ),
)
def e13(spark, sf_dir):
    return _timed(spark, sf_dir).select("topic", "subject", "ts", "n", "mean_interval_ms", "timeout_ms")


@query(
    "e14_flag_gaps",
    with_sql(
        """SELECT topic, subject, ts, next_ts, coalesce((epoch_us(next_ts) - epoch_us(ts)) / 1000.0::DOUBLE > timeout_ms, false) AS gap
FROM (SELECT *, lead(ts) OVER (PARTITION BY topic ORDER BY ts, subject) AS next_ts FROM timeouts)""",
        OBS, _TIMEOUT,
    ),
)
def e14(spark, sf_dir):
    flagged = merge.flag_gaps(_timed(spark, sf_dir), tie=["subject"])
    return flagged.select("topic", "subject", "ts", "next_ts", "gap")


@query(
    "e14_cap_duration",
    with_sql(
        """SELECT topic, subject, ts FROM (SELECT *, min(us) OVER (PARTITION BY topic) AS first FROM obs)
WHERE us - first <= 1209600000000""",
        OBS,
    ),
)
def e14_cap(spark, sf_dir):
    return merge.cap_duration(observations(spark, sf_dir), "14 days").select("topic", "subject", "ts")

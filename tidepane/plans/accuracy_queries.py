"""Registered queries for accuracy, trend and resource analytics and for reshaping series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepane.functions import grades
from tidepane.functions.timegrid import micros
from tidepane.operators import accuracy, merge, reshape, trends
from tidepane.operators.panes import rollup
from tidepane.operators.profile import buffer_stats
from tidepane.plans.catalog import query
from tidepane.plans.inputs import (
    OBS,
    OUT,
    SCALE,
    SUB,
    observations,
    shared_panes,
    sql_exact,
    sql_sub,
    table,
    with_sql,
)
from tidepane.plans.merge_queries import _OVER, _WEIGHTED


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- exact answer against merged answer ------------------------------------------------------

# Every fiftieth truth is set to 0, to reach the rules for zero truths.
_PAIRS = [
    OBS,
    sql_exact(),
    sql_sub(),
    _OVER,
    f"""approx AS (SELECT topic, t_start, {_WEIGHTED} AS value FROM parts GROUP BY topic, t_start),
aligned AS (
  SELECT e.topic, e.n AS ord, e.value AS truth, a.value AS approx
  FROM (SELECT topic, value, row_number() OVER (PARTITION BY topic ORDER BY w_start) AS n FROM exact) e
  JOIN (SELECT topic, value, row_number() OVER (PARTITION BY topic ORDER BY t_start) AS n FROM approx) a
    ON e.topic = a.topic AND e.n = a.n),
pairs AS (SELECT topic, ord, CASE WHEN ord % 50 = 0 THEN 0.0::DOUBLE ELSE truth END AS truth, approx FROM aligned)""",
]


def _aligned(spark, sf_dir):
    panes = shared_panes(spark, sf_dir)
    exact = rollup(panes, *OUT, "AVG", scale=SCALE)
    approx = merge.merge_windows(rollup(panes, *SUB, "AVG", scale=SCALE), *OUT, "AVG")
    approx = approx.withColumn("value", F.round("value", 8))
    return accuracy.align_by_ordinal(exact, approx, ["topic"], ["w_start"], ["t_start"])


def _pairs(spark, sf_dir):
    zeroed = F.when(F.col("ord") % 50 == 0, 0.0).otherwise(F.col("truth"))
    return _aligned(spark, sf_dir).withColumn("truth", zeroed)


def _pairs_sql(body: str) -> str:
    return with_sql(body, *_PAIRS)


_ERR = "CASE WHEN truth <> 0 THEN abs((truth - approx) / truth) * 100 END"


@query("g1_align_by_ordinal", _pairs_sql("SELECT topic, ord, truth, approx FROM aligned"))
def g1(spark, sf_dir):
    return _aligned(spark, sf_dir)


@query(
    "g2_mape",
    _pairs_sql(
        f"""SELECT topic, round(avg({_ERR}), 6) AS mape_skip, round(sum({_ERR}) / count(*), 6) AS mape_count
FROM pairs GROUP BY topic"""
    ),
)
def g2(spark, sf_dir):
    out = _pairs(spark, sf_dir).groupBy("topic").agg(
        grades.mape("truth", "approx").alias("mape_skip"),
        grades.mape("truth", "approx", zero="count").alias("mape_count"),
    )
    return _rounded(out, "mape_skip", "mape_count")


@query(
    "g3_mae_rmse",
    _pairs_sql(
        """SELECT topic, round(avg(abs(truth - approx)), 7) AS mae, round(sqrt(avg(pow(truth - approx, 2))), 7) AS rmse
FROM pairs GROUP BY topic"""
    ),
)
def g3(spark, sf_dir):
    out = _pairs(spark, sf_dir).groupBy("topic").agg(
        grades.mae("truth", "approx").alias("mae"), grades.rmse("truth", "approx").alias("rmse")
    )
    return _rounded(out, "mae", "rmse", digits=7)


@query(
    "g3b_accuracy_metrics",
    _pairs_sql(
        f"""SELECT topic, round(avg(abs(truth - approx)) FILTER (truth <> 0), 7) AS mae,
  round(sqrt(avg(pow(truth - approx, 2)) FILTER (truth <> 0)), 7) AS rmse, round(avg({_ERR}), 6) AS mape,
  round(greatest(0.0, 100 - avg({_ERR})), 6) AS accuracy, count(*) FILTER (truth <> 0) AS data_points,
  count(truth) AS truth_count, count(approx) AS approx_count FROM pairs GROUP BY topic"""
    ),
)
def g3b(spark, sf_dir):
    out = accuracy.accuracy_metrics(_pairs(spark, sf_dir), ["topic"])
    out = _rounded(out, "mae", "rmse", digits=7)
    return _rounded(out, "mape", "accuracy")


@query("g4_pearson", _pairs_sql("SELECT topic, round(corr(truth, approx), 8) AS r FROM pairs GROUP BY topic"))
def g4(spark, sf_dir):
    out = _pairs(spark, sf_dir).groupBy("topic").agg(grades.pearson("truth", "approx").alias("r"))
    return _rounded(out, "r", digits=8)


_ACC = f"CASE WHEN truth = 0 THEN CASE WHEN approx = 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END ELSE greatest(0.0::DOUBLE, 100 - {_ERR}) END"


@query("g5_pair_accuracy", _pairs_sql(f"SELECT topic, ord, {_ACC} AS accuracy FROM pairs"))
def g5(spark, sf_dir):
    return _pairs(spark, sf_dir).select(
        "topic", "ord", grades.pair_accuracy("truth", "approx").alias("accuracy")
    )


@query(
    "g6_percentage_accuracy",
    _pairs_sql(f"SELECT topic, round(avg(100 - {_ERR}), 6) AS accuracy FROM pairs GROUP BY topic"),
)
def g6(spark, sf_dir):
    out = _pairs(spark, sf_dir).groupBy("topic").agg(
        grades.percentage_accuracy("truth", "approx").alias("accuracy")
    )
    return _rounded(out, "accuracy")


@query(
    "g7_rel_diff",
    _pairs_sql(
        """SELECT topic, ord, abs(approx - truth) / nullif(greatest(approx, truth), 0) * 100 AS against_max,
  abs(approx - truth) / nullif(abs(truth), 0) * 100 AS against_truth FROM pairs"""
    ),
)
def g7(spark, sf_dir):
    return _pairs(spark, sf_dir).select(
        "topic",
        "ord",
        grades.rel_diff("approx", "truth", "max").alias("against_max"),
        grades.rel_diff("approx", "truth", "truth").alias("against_truth"),
    )


@query(
    "g8_series_stats",
    with_sql(
        """SELECT device, count(value) AS "count", round(avg(value), 8) AS mean, round(stddev_pop(value), 6) AS std,
  min(value) AS "min", max(value) AS "max", round(median(value), 8) AS median FROM obs GROUP BY device""",
        OBS,
    ),
)
def g8(spark, sf_dir):
    out = accuracy.series_stats(observations(spark, sf_dir), ["device"])
    return _rounded(_rounded(out, "std"), "mean", "median", digits=8)


@query(
    "g9_floor_rank_percentiles",
    with_sql(
        """SELECT topic, min(value) AS "min", max(value) AS "max", round(avg(value), 7) AS avg,
  max(value) FILTER (k = floor(n * 0.5)) AS median, max(value) FILTER (k = floor(n * 0.95::DOUBLE)) AS p95,
  max(value) FILTER (k = floor(n * 0.99::DOUBLE)) AS p99, count(*) AS samples
FROM (SELECT topic, value, row_number() OVER (PARTITION BY topic ORDER BY value) - 1 AS k,
             count(*) OVER (PARTITION BY topic) AS n FROM obs) GROUP BY topic""",
        OBS,
    ),
)
def g9(spark, sf_dir):
    out = accuracy.floor_rank_percentiles(observations(spark, sf_dir), ["topic"])
    return _rounded(out, "avg", digits=7)


@query(
    "g10_first_vs_average",
    _pairs_sql(
        f"""SELECT topic, arg_min(approx, ord) AS first_approx, arg_min(truth, ord) AS first_truth,
  round(arg_min({_ERR}, ord), 7) AS first_error, round(avg({_ERR}), 6) AS average_error, count(*) AS results
FROM pairs GROUP BY topic"""
    ),
)
def g10(spark, sf_dir):
    out = accuracy.first_vs_average(_pairs(spark, sf_dir), ["topic"])
    return _rounded(_rounded(out, "first_error", digits=7), "average_error")


# --- test runs: one per event ----------------------------------------------------------------

_TESTS = f"""tests_raw AS (
  SELECT event_id AS test, CASE WHEN event_type IN ('purchase', 'signup') THEN 'favorable_' ELSE 'challenging_' END || event_type AS pattern,
         user_id % 5 AS rate, (user_id % 9) / 4.0::DOUBLE AS frequency, value AS truth,
         value + ((event_id * 37) % 21 - 10) / 10.0::DOUBLE AS approx,
         value + ((event_id * 41) % 21 - 10) / 10.0::DOUBLE AS fetched FROM events),
tests AS (SELECT *, {_ACC} AS accuracy, {_ERR} AS error FROM tests_raw)"""


def _tests(spark, sf_dir):
    """One test per event: a truth and two answers that are up to 1.0 off."""
    number, value = F.col("event_id"), F.col("value")
    favorable = F.col("event_type").isin("purchase", "signup")
    return (
        table(spark, sf_dir, "events")
        .select(
            number.alias("test"),
            F.concat(F.when(favorable, "favorable_").otherwise("challenging_"), "event_type").alias("pattern"),
            (F.col("user_id") % 5).alias("rate"),
            ((F.col("user_id") % 9) / F.lit(4.0)).alias("frequency"),
            value.alias("truth"),
            (value + ((number * 37) % 21 - 10) / F.lit(10.0)).alias("approx"),
            (value + ((number * 41) % 21 - 10) / F.lit(10.0)).alias("fetched"),
        )
        .withColumn("accuracy", grades.pair_accuracy("truth", "approx"))
        .withColumn("error", grades.percentage_error("truth", "approx"))
    )


def _tests_sql(body: str) -> str:
    return with_sql(body, _TESTS)


_TYPE = "CASE WHEN pattern LIKE 'challenging%' THEN 'Challenging' ELSE 'Favorable' END"


@query(
    "g11_summary_by",
    _tests_sql(
        f"""SELECT CASE WHEN grouping(type) = 0 THEN 'type' WHEN grouping(rate) = 0 THEN 'rate' ELSE 'pattern' END AS "grouping",
  type, rate, pattern, round(avg(accuracy), 6) AS avg, min(accuracy) AS "min", max(accuracy) AS "max", count(*) AS tests
FROM (SELECT *, {_TYPE} AS type FROM tests) GROUP BY GROUPING SETS ((type), (rate), (pattern))"""
    ),
)
def g11(spark, sf_dir):
    tests = _tests(spark, sf_dir).withColumn("type", grades.pattern_type("pattern"))
    return _rounded(accuracy.summary_by(tests, ["type", "rate", "pattern"]), "avg")


@query(
    "g12_grades",
    _tests_sql(
        """SELECT test, CASE WHEN accuracy >= 95 THEN 'Excellent' WHEN accuracy >= 90 THEN 'Good' WHEN accuracy >= 80 THEN 'Acceptable' ELSE 'Poor' END AS band,
  CASE WHEN error > 10 THEN 'Poor' WHEN error > 5 THEN 'Fair' WHEN error > 1 THEN 'Good' WHEN error <= 1 THEN 'Excellent' END AS grade,
  CASE WHEN accuracy > 95 THEN 'Excellent approx' WHEN accuracy > 85 THEN 'Good approx' WHEN accuracy > 70 THEN 'Fair approx' ELSE 'Poor approx' END AS quality,
  CASE WHEN abs(d) < 1 THEN 'Similar' WHEN d > 0 THEN 'Fetching better' ELSE 'Approximation better' END AS better
FROM (SELECT *, CASE WHEN truth = 0 THEN CASE WHEN fetched = 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END
                ELSE greatest(0.0::DOUBLE, 100 - abs((truth - fetched) / truth) * 100) END - accuracy AS d FROM tests)"""
    ),
)
def g12(spark, sf_dir):
    return _tests(spark, sf_dir).select(
        "test",
        grades.accuracy_band("accuracy").alias("band"),
        grades.mape_grade("error").alias("grade"),
        grades.approximation_quality("accuracy").alias("quality"),
        grades.better_side("accuracy", grades.pair_accuracy("truth", "fetched")).alias("better"),
    )


@query(
    "g12_band_distribution",
    _tests_sql(
        """SELECT pattern, CASE WHEN accuracy >= 95 THEN 'Excellent' WHEN accuracy >= 90 THEN 'Good' WHEN accuracy >= 80 THEN 'Acceptable' ELSE 'Poor' END AS band,
  count(*) AS tests FROM tests GROUP BY ALL"""
    ),
)
def g12_distribution(spark, sf_dir):
    return accuracy.band_distribution(_tests(spark, sf_dir), grades.accuracy_band("accuracy"), ["pattern"])


@query(
    "g13_best_worst",
    _tests_sql(
        """SELECT place, pattern, rate, test, accuracy FROM (
  SELECT 'best' AS place, *, row_number() OVER (PARTITION BY pattern ORDER BY accuracy DESC, test) AS k FROM tests
  UNION ALL SELECT 'worst', *, row_number() OVER (PARTITION BY pattern ORDER BY accuracy, test) FROM tests) WHERE k = 1"""
    ),
)
def g13(spark, sf_dir):
    tests = _tests(spark, sf_dir).select("pattern", "rate", "test", "accuracy")
    return accuracy.best_worst(tests, "accuracy", ["test"], ["pattern"])


_WON = """won AS (SELECT *, CASE WHEN abs(approx - truth) < abs(fetched - truth) THEN 'Approximation' ELSE 'Fetching' END AS winner FROM tests)"""


def _won(spark, sf_dir):
    tests = _tests(spark, sf_dir).withColumns(
        {
            "approx_error": F.abs(F.col("approx") - F.col("truth")),
            "exact_error": F.abs(F.col("fetched") - F.col("truth")),
        }
    )
    return accuracy.winners(tests)


@query("g14_winners", with_sql("SELECT test, pattern, rate, winner FROM won", _TESTS, _WON))
def g14(spark, sf_dir):
    return _won(spark, sf_dir).select("test", "pattern", "rate", "winner")


@query(
    "g14_win_counts",
    with_sql(
        """SELECT CASE WHEN grouping(rate) = 0 THEN 'rate' WHEN grouping(pattern) = 0 THEN 'pattern' ELSE 'overall' END AS "grouping", rate, pattern,
  count(*) FILTER (winner = 'Approximation') AS approximation_wins, count(*) FILTER (winner = 'Fetching') AS fetching_wins, count(*) AS total
FROM won GROUP BY GROUPING SETS ((), (rate), (pattern))""",
        _TESTS, _WON,
    ),
)
def g14_counts(spark, sf_dir):
    return accuracy.win_counts(_won(spark, sf_dir), ["rate", "pattern"])


# --- trends ----------------------------------------------------------------------------------

_SLOPES = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY device ORDER BY ts, subject) AS n, count(*) OVER (PARTITION BY device) AS total FROM obs)"""


@query(
    "g15_trend_slope",
    with_sql(
        """SELECT device, points, round(slope, 6) AS slope,
  CASE WHEN slope IS NULL THEN 'Insufficient data' WHEN slope > 1 THEN 'Strong positive trend' WHEN slope > 0.1 THEN 'Positive trend'
       WHEN slope > -0.1 THEN 'Stable' WHEN slope > -1 THEN 'Negative trend' ELSE 'Strong negative trend' END AS trend
FROM (SELECT device, count(*) AS points, CASE WHEN count(*) >= 2 THEN regr_slope(value, n - 1) END AS slope FROM numbered GROUP BY device)""",
        OBS, _SLOPES,
    ),
)
def g15(spark, sf_dir):
    out = trends.trend_slope(observations(spark, sf_dir), ["device"], ["ts", "subject"])
    return _rounded(out, "slope")


@query(
    "g16_trend_direction",
    with_sql(
        """SELECT device, first_value, last_value, CASE WHEN last_value > first_value THEN 'increasing' ELSE 'decreasing' END AS direction
FROM (SELECT device, arg_min(value, ts) AS first_value, arg_max(value, ts) AS last_value FROM obs GROUP BY device HAVING count(*) > 1)""",
        OBS,
    ),
)
def g16(spark, sf_dir):
    return trends.trend_direction(observations(spark, sf_dir), ["device"], "ts")


@query(
    "g17_head_tail_trend",
    with_sql(
        """SELECT device, round(start_avg, 7) AS start_avg, round(end_avg, 7) AS end_avg, round((end_avg - start_avg) / start_avg * 100, 5) AS change_pct,
  CASE WHEN end_avg > start_avg THEN 'Increasing' WHEN end_avg IS NOT NULL THEN 'Decreasing' END AS trend
FROM (SELECT device, avg(value) FILTER (n <= least(10, floor(total * 0.1))) AS start_avg,
             avg(value) FILTER (total - n < least(10, floor(total * 0.1))) AS end_avg FROM numbered GROUP BY device)""",
        OBS, _SLOPES,
    ),
)
def g17(spark, sf_dir):
    out = trends.head_tail_trend(observations(spark, sf_dir), ["device"], ["ts", "subject"])
    return _rounded(_rounded(out, "start_avg", "end_avg", digits=7), "change_pct", digits=5)


@query(
    "g18_rolling_stats",
    with_sql(
        """SELECT subject, topic, CASE WHEN n >= 50 THEN round(m, 7) END AS rolling_mean, CASE WHEN n >= 100 THEN round(s, 6) END AS rolling_std
FROM (SELECT subject, topic, row_number() OVER (PARTITION BY topic ORDER BY ts, subject) AS n,
  avg(value) OVER (PARTITION BY topic ORDER BY ts, subject ROWS 49 PRECEDING) AS m,
  stddev_samp(value) OVER (PARTITION BY topic ORDER BY ts, subject ROWS 99 PRECEDING) AS s FROM obs)""",
        OBS,
    ),
)
def g18(spark, sf_dir):
    out = trends.rolling_stats(observations(spark, sf_dir), ["topic"], ["ts", "subject"])
    out = out.select("subject", "topic", "rolling_mean", "rolling_std")
    return _rounded(_rounded(out, "rolling_mean", digits=7), "rolling_std")


# Two approaches observed at once: the users with even and with odd numbers.
_SAMPLES = """samples AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'approximation' ELSE 'chunked' END AS approach, event_type AS topic, ts,
         epoch_us(ts) // 1000 AS "timestamp", value AS cpu_user, user_id * 1048576 AS heap,
         CASE WHEN event_id % 9 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS cpu_text,
         CASE WHEN event_id % 8 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS mem_text, value, epoch_us(ts) AS us FROM events)"""


def _samples(spark, sf_dir):
    user, number, value = F.col("user_id"), F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select(
        F.when(user % 2 == 0, "approximation").otherwise("chunked").alias("approach"),
        F.col("event_type").alias("topic"),
        "ts",
        F.floor(micros("ts") / 1000).alias("timestamp"),
        value.alias("cpu_user"),
        (user * 1048576).alias("heap"),
        F.when(number % 9 == 0, "n/a").otherwise(value.cast("string")).alias("cpu_text"),
        F.when(number % 8 == 0, "").otherwise(user.cast("string")).alias("mem_text"),
        "value",
    )


@query(
    "g19_bucket_means",
    with_sql(
        """SELECT topic, a.bucket, round(a.m, 7) AS mean_a, round(b.m, 7) AS mean_b FROM buckets a JOIN buckets b USING (topic, bucket)
WHERE a.approach = 'approximation' AND b.approach = 'chunked' AND a.bucket * 3600 < least(a.e, b.e)""",
        _SAMPLES,
        """rel AS (SELECT *, (us - min(us) OVER (PARTITION BY approach, topic)) / 1000000.0::DOUBLE AS rel_s FROM samples),
ended AS (SELECT *, max(rel_s) OVER (PARTITION BY approach, topic) AS e FROM rel),
buckets AS (SELECT approach, topic, CAST(floor(rel_s / 3600) AS BIGINT) AS bucket, avg(value) AS m, max(e) AS e FROM ended GROUP BY ALL)""",
    ),
)
def g19(spark, sf_dir):
    samples = _samples(spark, sf_dir)
    a = samples.filter(F.col("approach") == "approximation")
    b = samples.filter(F.col("approach") == "chunked")
    return _rounded(trends.bucket_means(a, b, ["topic"], width_s=3600), "mean_a", "mean_b", digits=7)


@query(
    "g20_resource_compare",
    with_sql(
        """SELECT metric, round(avg_a, 5) AS avg_a, round(avg_b, 5) AS avg_b, max_a, max_b, duration_a_s, duration_b_s,
  round((avg_b - avg_a) / avg_b * 100, 7) AS improvement_pct, round((max_a - max_b) / max_b * 100, 7) AS peak_diff_pct
FROM (SELECT metric, avg(v) FILTER (approach = 'approximation') AS avg_a, avg(v) FILTER (approach = 'chunked') AS avg_b,
  max(v) FILTER (approach = 'approximation') AS max_a, max(v) FILTER (approach = 'chunked') AS max_b,
  (max("timestamp") FILTER (approach = 'approximation') - min("timestamp") FILTER (approach = 'approximation')) / 1000.0::DOUBLE AS duration_a_s,
  (max("timestamp") FILTER (approach = 'chunked') - min("timestamp") FILTER (approach = 'chunked')) / 1000.0::DOUBLE AS duration_b_s
FROM (SELECT approach, "timestamp", 'cpu_user' AS metric, cpu_user AS v FROM samples
      UNION ALL SELECT approach, "timestamp", 'heap_mb', heap / (1024.0 * 1024.0)::DOUBLE FROM samples) GROUP BY metric)""",
        _SAMPLES,
    ),
)
def g20(spark, sf_dir):
    samples = _samples(spark, sf_dir).withColumn("heap_mb", grades.bytes_to_mb("heap"))
    out = trends.resource_compare(samples, ["cpu_user", "heap_mb"], "approximation", "chunked")
    return _rounded(_rounded(out, "avg_a", "avg_b", digits=5), "improvement_pct", "peak_diff_pct", digits=7)


@query(
    "g21_histogram",
    with_sql(
        """SELECT topic, bin, round(lo + bin * w, 8) AS "left", round(lo + (bin + 1) * w, 8) AS "right", coalesce(c, 0) AS "count",
  round(coalesce(c, 0) / (total * w), 10) AS density
FROM (SELECT *, unnest(range(50)) AS bin FROM ranges) LEFT JOIN (
  SELECT topic, least(CAST(floor((value - lo) / w) AS BIGINT), 49) AS bin, count(*) AS c FROM obs JOIN ranges USING (topic) GROUP BY ALL) USING (topic, bin)""",
        OBS,
        "ranges AS (SELECT topic, min(value) AS lo, (max(value) - min(value)) / 50 AS w, count(*) AS total FROM obs GROUP BY topic)",
    ),
)
def g21(spark, sf_dir):
    out = trends.histogram(observations(spark, sf_dir), ["topic"])
    return _rounded(_rounded(out, "left", "right", digits=8), "density", digits=10)


@query(
    "g22_closed_form_truth",
    """SELECT event_id, round(truth, 9) AS truth, round(abs(value - truth) / truth * 100, 5) AS error_pct FROM (
  SELECT event_id, value, CASE WHEN event_type IN ('click', 'view') THEN exp(user_id % 5 * (event_id % 480 / 4.0::DOUBLE) / 120)
    WHEN event_type = 'error' THEN exp(-(user_id % 5 * (event_id % 480 / 4.0::DOUBLE) / 120)) END AS truth FROM events)""",
)
def g22(spark, sf_dir):
    kind = F.col("event_type")
    pattern = F.when(kind.isin("click", "view"), "exponential_growth").when(kind == "error", "exponential_decay")
    events = table(spark, sf_dir, "events").select(
        "event_id", "value", pattern.alias("pattern"), (F.col("user_id") % 5).alias("rate"),
        (F.col("event_id") % 480 / F.lit(4.0)).alias("elapsed"),
    )
    out = events.withColumn("truth", grades.closed_form_truth("pattern", "rate", "elapsed"))
    return out.select(
        "event_id",
        F.round("truth", 9).alias("truth"),
        F.round(grades.percentage_error("truth", "value"), 5).alias("error_pct"),
    )


@query(
    "g23_aliasing_risk",
    with_sql(
        """SELECT test, frequency, ratio, CASE WHEN ratio <= 0.5 THEN 'Low' WHEN ratio <= 0.75 THEN 'Medium' ELSE 'High' END AS risk,
  CASE WHEN ratio > 0.8 THEN 'High' WHEN ratio > 0.5 THEN 'Medium' ELSE 'Low' END AS risk_2,
  CASE WHEN frequency <= 0.1 THEN 'Low frequency' WHEN frequency <= 0.5 THEN 'Medium-low frequency' WHEN frequency <= 1.0 THEN 'Medium frequency'
       WHEN frequency <= 1.5 THEN 'High frequency' ELSE 'Near Nyquist frequency' END AS label
FROM (SELECT *, frequency / 2 AS ratio FROM tests)""",
        _TESTS,
    ),
)
def g23(spark, sf_dir):
    tests = _tests(spark, sf_dir).withColumn("ratio", grades.nyquist_ratio("frequency"))
    return tests.select(
        "test", "frequency", "ratio",
        grades.aliasing_risk("ratio").alias("risk"),
        grades.aliasing_risk("ratio", variant=2).alias("risk_2"),
        grades.frequency_label("frequency").alias("label"),
    )


@query(
    "g23_stream_aliasing",
    with_sql(
        """SELECT topic, 0.0001::DOUBLE / (rate_hz / 2) > 0.75 AS high_risk FROM (
  SELECT topic, 1000.0::DOUBLE / ((max(us) - min(us)) / 1000.0::DOUBLE / (count(*) - 1)) AS rate_hz FROM obs GROUP BY topic)""",
        OBS,
    ),
)
def g23_stream(spark, sf_dir):
    """The sampling rate taken from the stream itself, for a signal of 0.1 mHz."""
    stats = buffer_stats(observations(spark, sf_dir))
    ratio = grades.nyquist_ratio(F.lit(0.0001), F.col("rate_hz"))
    return stats.select("topic", (grades.aliasing_risk(ratio) == "High").alias("high_risk"))


@query(
    "g24_risk_summary",
    with_sql(
        """SELECT risk, round(avg(accuracy), 6) AS mean_accuracy, round(avg(error), 5) AS mean_mape, count(*) AS tests FROM (
  SELECT accuracy, error, CASE WHEN frequency / 2 <= 0.5 THEN 'Low' WHEN frequency / 2 <= 0.75 THEN 'Medium' ELSE 'High' END AS risk FROM tests) GROUP BY risk""",
        _TESTS,
    ),
)
def g24(spark, sf_dir):
    tests = _tests(spark, sf_dir).withColumnRenamed("error", "mape")
    risk = grades.aliasing_risk(grades.nyquist_ratio("frequency"))
    out = accuracy.risk_summary(tests.withColumn("risk", risk))
    return _rounded(_rounded(out, "mean_accuracy"), "mean_mape", digits=5)


@query(
    "g25_change_profile",
    with_sql(
        """SELECT device, points, start_value, end_value, "min", "max", duration_ms, value_25pct, value_50pct, value_75pct,
  end_value - start_value AS change, (end_value - start_value) / nullif(start_value, 0) * 100 AS change_pct,
  duration_ms / (points - 1) AS mean_interval_ms, round((end_value - start_value) / (duration_ms / 1000), 12) AS change_per_s,
  f10 - start_value AS change_first_10, f50 - start_value AS change_first_50, f100 - start_value AS change_first_100,
  CASE WHEN abs((end_value - start_value) / nullif(start_value, 0) * 100) < 5 THEN 'Low impact'
       WHEN abs((end_value - start_value) / nullif(start_value, 0) * 100) < 20 THEN 'Medium impact'
       WHEN start_value <> 0 THEN 'High impact' END AS impact
FROM (SELECT device, max(total) AS points, max(value) FILTER (n = 1) AS start_value, max(value) FILTER (n = total) AS end_value,
  min(value) AS "min", max(value) AS "max", (max(us) - min(us)) / 1000.0::DOUBLE AS duration_ms, max(value) FILTER (n = 10) AS f10,
  max(value) FILTER (n = 50) AS f50, max(value) FILTER (n = 100) AS f100, max(value) FILTER (n = floor(total * 0.25) + 1) AS value_25pct,
  max(value) FILTER (n = floor(total * 0.5) + 1) AS value_50pct, max(value) FILTER (n = floor(total * 0.75) + 1) AS value_75pct
FROM numbered GROUP BY device)""",
        OBS, _SLOPES,
    ),
)
def g25(spark, sf_dir):
    out = trends.change_profile(observations(spark, sf_dir), ["device"], ["ts", "subject"])
    return _rounded(out, "change_per_s", digits=12)


@query(
    "g26_head_mean_truth",
    with_sql(
        """SELECT round(avg(m), 7) AS truth, count(*) AS streams FROM (
  SELECT topic, avg(value) AS m FROM (SELECT topic, value, row_number() OVER (PARTITION BY topic ORDER BY ts, subject) AS n FROM obs)
  WHERE n <= 240 GROUP BY topic)""",
        OBS,
    ),
)
def g26(spark, sf_dir):
    out = accuracy.head_mean_truth(observations(spark, sf_dir), "topic", ["ts", "subject"])
    return _rounded(out, "truth", digits=7)


@query(
    "g27_cpu_mem_summary",
    with_sql(
        """SELECT approach, round(coalesce(avg(TRY_CAST(cpu_text AS DOUBLE)), 0), 6) AS avg_cpu, coalesce(max(TRY_CAST(cpu_text AS DOUBLE)), 0) AS max_cpu,
  round(coalesce(avg(TRY_CAST(mem_text AS DOUBLE)), 0), 6) AS avg_memory, coalesce(max(TRY_CAST(mem_text AS DOUBLE)), 0) AS max_memory, count(*) AS samples
FROM samples GROUP BY approach""",
        _SAMPLES,
    ),
)
def g27(spark, sf_dir):
    out = trends.cpu_mem_summary(_samples(spark, sf_dir), ["approach"], "cpu_text", "mem_text")
    return _rounded(out, "avg_cpu", "avg_memory")


_LISTS = """lists AS (
  SELECT event_id, CAST(value AS VARCHAR) || '|' || CASE WHEN event_id % 3 = 0 THEN 'NaN' ELSE CAST(user_id AS VARCHAR) END
         || '|x|' || CAST(-value AS VARCHAR) AS results FROM events)"""


def _lists(spark, sf_dir):
    value, user = F.col("value"), F.col("user_id").cast("string")
    text = F.concat_ws(
        "|", value.cast("string"), F.when(F.col("event_id") % 3 == 0, "NaN").otherwise(user), F.lit("x"),
        (-value).cast("string"),
    )
    return table(spark, sf_dir, "events").select("event_id", text.alias("results"))


@query(
    "g28_explode_result_lists",
    with_sql(
        """SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY i) - 1 AS INTEGER) AS pos, result FROM (
  SELECT event_id, generate_subscripts(string_split(results, '|'), 1) AS i, TRY_CAST(unnest(string_split(results, '|')) AS DOUBLE) AS result FROM lists)
WHERE result IS NOT NULL AND NOT isnan(result)""",
        _LISTS,
    ),
)
def g28(spark, sf_dir):
    return accuracy.explode_result_lists(_lists(spark, sf_dir), "results", ["event_id"])


@query(
    "g28_mean_positive",
    _tests_sql("SELECT pattern, round(coalesce(avg(accuracy) FILTER (accuracy > 0), 0), 6) AS mean_accuracy FROM tests GROUP BY pattern"),
)
def g28_mean(spark, sf_dir):
    out = _tests(spark, sf_dir).groupBy("pattern").agg(accuracy.mean_positive("accuracy").alias("mean_accuracy"))
    return _rounded(out, "mean_accuracy")


@query(
    "g29_threshold_counts",
    _tests_sql(
        """SELECT pattern, count(error) AS total, count(*) FILTER (error <= 0.01) AS perfect, count(*) FILTER (error <= 0.1) AS near_perfect,
  count(*) FILTER (error <= 5) AS good FROM tests GROUP BY pattern"""
    ),
)
def g29(spark, sf_dir):
    return accuracy.threshold_counts(_tests(spark, sf_dir), "error", ["pattern"])


@query(
    "g30_pivot_matrix",
    _tests_sql(
        """SELECT rate, round(coalesce(avg(error) FILTER (pattern LIKE 'challenging%'), 0), 5) AS "Challenging",
  round(coalesce(avg(error) FILTER (pattern LIKE 'favorable%'), 0), 5) AS "Favorable", 0.0::DOUBLE AS "Unknown" FROM tests GROUP BY rate"""
    ),
)
def g30(spark, sf_dir):
    tests = _tests(spark, sf_dir).withColumn("type", grades.pattern_type("pattern"))
    out = accuracy.pivot_matrix(tests, "rate", "type", ["Challenging", "Favorable", "Unknown"], "error")
    return _rounded(out, "Challenging", "Favorable", digits=5)


@query(
    "g31_five_number",
    with_sql(
        """SELECT topic, min(value) AS "min", round(quantile_cont(value, 0.25), 7) AS q1, round(quantile_cont(value, 0.5), 7) AS median,
  round(quantile_cont(value, 0.75), 7) AS q3, max(value) AS "max" FROM obs GROUP BY topic""",
        OBS,
    ),
)
def g31(spark, sf_dir):
    out = accuracy.five_number(observations(spark, sf_dir), ["topic"])
    return _rounded(out, "q1", "median", "q3", digits=7)


@query(
    "g32_ordered_report",
    _tests_sql("SELECT test, pattern, rate, error FROM tests WHERE error IS NOT NULL ORDER BY error, test"),
)
def g32(spark, sf_dir):
    tests = _tests(spark, sf_dir).select("test", "pattern", "rate", "error")
    return accuracy.ordered_report(tests, "error", ["test"])


@query(
    "g33_run_summary",
    """SELECT event_type AS pattern, count(*) AS total, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed,
  max(value) FILTER (ok AND user_id % 2 = 0) AS approximation_ms, max(value) FILTER (ok AND user_id % 2 = 1) AS fetching_ms,
  CASE WHEN max(value) FILTER (ok AND user_id % 2 = 0) > max(value) FILTER (ok AND user_id % 2 = 1) THEN 'fetching' ELSE 'approximation' END AS faster,
  abs(max(value) FILTER (ok AND user_id % 2 = 0) - max(value) FILTER (ok AND user_id % 2 = 1)) AS faster_by_ms
FROM (SELECT *, event_id % 6 <> 0 AS ok FROM events) GROUP BY event_type""",
)
def g33(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("pattern"),
        F.when(F.col("user_id") % 2 == 0, "approximation").otherwise("fetching").alias("approach"),
        (F.col("event_id") % 6 != 0).alias("success"),
        F.col("value").alias("duration_ms"),
    )
    return accuracy.run_summary(runs)


# --- reshaping -------------------------------------------------------------------------------


@query("h1_order_by_time", with_sql("SELECT subject, topic, ts, value FROM obs ORDER BY ts, subject", OBS))
def h1(spark, sf_dir):
    return reshape.order_by_time(observations(spark, sf_dir).select("subject", "topic", "ts", "value"))


@query(
    "h2_retime",
    with_sql(
        """SELECT subject, topic, TIMESTAMP '2024-06-01 00:00:00' + INTERVAL 250 MILLISECOND * (row_number() OVER (PARTITION BY topic ORDER BY ts, subject) - 1) AS ts
FROM obs""",
        OBS,
    ),
)
def h2(spark, sf_dir):
    out = reshape.retime(observations(spark, sf_dir), "2024-06-01 00:00:00", 4)
    return out.select("subject", "topic", "ts")


@query(
    "h3_rescale",
    with_sql(
        """SELECT subject, topic, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 200 - 100, 8) AS value
FROM obs WINDOW w AS (PARTITION BY topic)""",
        OBS,
    ),
)
def h3(spark, sf_dir):
    out = reshape.rescale(observations(spark, sf_dir), -100, 100).select("subject", "topic", "value")
    return _rounded(out, "value", digits=8)


@query(
    "h4_prefixes",
    with_sql(
        """SELECT subject, topic, n, size AS "prefix" FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY ts, subject) AS n, count(*) OVER (PARTITION BY topic) AS total FROM obs)
JOIN (SELECT unnest([100, 500, 1000, 2000, 5000])::BIGINT AS size) ON n <= size AND size <= total""",
        OBS,
    ),
)
def h4(spark, sf_dir):
    return reshape.prefixes(observations(spark, sf_dir)).select("subject", "topic", "n", "prefix")


_LEVELS = (0.1, 0.5, 1.0, 2.0, 5.0)


def _drawn(seed: int) -> str:
    def uniform(stream: int) -> str:
        return f"((('0x' || substr(md5(subject || '|{seed}|{stream}'), 1, 13))::BIGINT + 1) / pow(2, 52))"

    return f"sqrt(-2 * ln({uniform(1)})) * cos(2 * pi() * {uniform(2)})"


def _noisy(sigma: float) -> str:
    return f"noisy_{str(sigma).replace('.', '_')}"


@query(
    "h5_add_noise",
    with_sql(
        "SELECT subject, topic, ts, value AS original, "
        + ", ".join(f"round(value + {_drawn(7 + k)} * {s}, 9) AS {_noisy(s)}" for k, s in enumerate(_LEVELS))
        + f", round(value * (1 + {_drawn(7 + len(_LEVELS))} * 0.02), 9) AS noisy_2pct FROM obs",
        OBS,
    ),
)
def h5(spark, sf_dir):
    """Five noise levels, additive, and 2 % multiplicative; drawn apart by level and row key."""
    obs = observations(spark, sf_dir).select("subject", "topic", "ts", "value")
    out = obs.withColumnRenamed("value", "original")
    for k, sigma in enumerate(_LEVELS):
        name = _noisy(sigma)
        out = reshape.add_noise(out.withColumn(name, F.col("original")), sigma, seed=7 + k, value=name)
        out = out.withColumn(name, F.round(name, 9))
    out = reshape.add_noise(
        out.withColumn("noisy_2pct", F.col("original")), 0.02, seed=7 + len(_LEVELS), value="noisy_2pct", multiplicative=True
    )
    return out.withColumn("noisy_2pct", F.round("noisy_2pct", 9))


@query(
    "h6_noise_levels",
    with_sql(
        """SELECT topic, count(value) AS "count", round(avg(value), 7) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS "min", max(value) AS "max",
  max(value) - min(value) AS "range", round(stddev_pop(value) * 0.05, 7) AS low_noise, round(stddev_pop(value) * 0.1, 7) AS medium_noise FROM obs GROUP BY topic""",
        OBS,
    ),
)
def h6(spark, sf_dir):
    out = reshape.noise_levels(observations(spark, sf_dir))
    return _rounded(_rounded(out, "std"), "mean", "low_noise", "medium_noise", digits=7)

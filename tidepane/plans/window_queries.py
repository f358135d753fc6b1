"""Registered queries for windows and panes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepane.operators import panes, windows
from tidepane.plans.catalog import query
from tidepane.plans.inputs import (
    HOUR,
    LATE,
    MINUTE,
    OBS,
    OUT,
    SCALE,
    SQL_AGG,
    SUB,
    observations,
    shuffled,
    sql_assigned,
    sql_sub,
    sql_windowed,
    sub_results,
    table,
    with_sql,
)

RESULT = ["topic", "w_start", "w_end", "value", "n"]


@query(
    "c1_sliding_window_agg",
    with_sql("SELECT topic, w_start, w_end, value, n FROM sub", OBS, sql_sub()),
)
def c1(spark, sf_dir):
    return sub_results(spark, sf_dir)


@query(
    "c1_sliding_unaligned",
    with_sql(
        "SELECT topic, w_start, w_end, value, n FROM w",
        OBS,
        sql_windowed("MAX", 5 * HOUR, 2 * HOUR, "w"),
    ),
)
def c1_unaligned(spark, sf_dir):
    """Width not a multiple of the slide: starts are congruent to ``-width``."""
    return windows.sliding_agg(observations(spark, sf_dir), "5 hours", "2 hours", "MAX")


@query(
    "c1_sliding_wide_fan_out",
    with_sql(
        "SELECT topic, w_start, w_end, value, n FROM w",
        OBS,
        sql_windowed("SUM", 24 * HOUR, HOUR, "w"),
    ),
)
def c1_wide(spark, sf_dir):
    """24 windows per row: answered from panes."""
    return windows.sliding_agg(observations(spark, sf_dir), "24 hours", "1 hour", "SUM", scale=SCALE)


@query(
    "c2_tumbling_window_agg",
    with_sql(
        "SELECT topic, w_start, w_end, value, n FROM w", OBS, sql_windowed("AVG", HOUR, HOUR, "w")
    ),
)
def c2(spark, sf_dir):
    return windows.tumbling_agg(observations(spark, sf_dir), "1 hour", "AVG", scale=SCALE)


@query(
    "c3_assign_windows",
    with_sql(
        "SELECT subject, topic, ts, value, w_start, w_end FROM assigned",
        OBS,
        sql_assigned(HOUR, 30 * MINUTE),
    ),
)
def c3(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return windows.assign_windows(obs, *SUB).select("subject", "topic", "ts", "value", "w_start", "w_end")


@query(
    "c4_window_at",
    with_sql(
        """SELECT probe_ts, a.topic, a.w_start, a.w_end, subject, value
FROM assigned a JOIN (
  SELECT probe_ts, topic, w_start, row_number() OVER (PARTITION BY probe_ts, topic ORDER BY w_end) AS k
  FROM (SELECT DISTINCT topic, w_start, w_end FROM assigned)
  JOIN (SELECT DISTINCT date_trunc('day', o_orderdate) + INTERVAL 26 YEAR AS probe_ts FROM orders)
    ON w_start <= probe_ts AND probe_ts <= w_end) p
ON a.topic = p.topic AND a.w_start = p.w_start AND p.k = 1""",
        OBS,
        sql_assigned(HOUR, 30 * MINUTE),
    ),
)
def c4(spark, sf_dir):
    """Probe times come from ``orders`` dates, moved into the span of the events."""
    probes = table(spark, sf_dir, "orders").select(
        (F.date_trunc("day", "o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 26 YEAR")).alias("probe_ts")
    )
    found = windows.window_at(observations(spark, sf_dir), probes, *SUB)
    return found.select("probe_ts", "topic", "w_start", "w_end", "subject", "value")


@query(
    "c6_running_window_agg",
    with_sql(
        """SELECT subject, topic, w_start, run_count, run_min, run_max,
  CAST(run_cents AS DOUBLE) / 100.0 AS run_sum,
  CAST(run_cents AS DOUBLE) / 100.0 / run_count AS run_avg
FROM (SELECT subject, topic, w_start, count(*) OVER w AS run_count, min(value) OVER w AS run_min,
             max(value) OVER w AS run_max, sum(cents) OVER w AS run_cents
      FROM assigned WINDOW w AS (PARTITION BY topic, w_start ORDER BY ts, subject
                                 ROWS UNBOUNDED PRECEDING))""",
        OBS,
        sql_assigned(HOUR, 30 * MINUTE),
    ),
)
def c6(spark, sf_dir):
    running = windows.running_window_agg(observations(spark, sf_dir), *SUB, scale=SCALE)
    return running.select("subject", "topic", "w_start", "run_count", "run_min", "run_max", "run_sum", "run_avg")


@query(
    "c7_rstream",
    with_sql("SELECT topic, w_start, w_end, value, n, w_end AS emit_ts FROM sub", OBS, sql_sub("MAX")),
)
def c7(spark, sf_dir):
    return windows.rstream(sub_results(spark, sf_dir, "MAX"))


_MEMBERS = """members AS (SELECT DISTINCT w_start, topic, device FROM assigned),
shifted AS (SELECT w_start + INTERVAL 30 MINUTE AS w_start, topic, device FROM members)"""


def _members(spark, sf_dir):
    """Devices active per topic and window."""
    assigned = windows.assign_windows(observations(spark, sf_dir), *SUB)
    return assigned.select("w_start", "topic", "device")


@query(
    "c8_istream",
    with_sql(
        "SELECT * FROM members EXCEPT SELECT * FROM shifted",
        OBS, sql_assigned(HOUR, 30 * MINUTE), _MEMBERS,
    ),
)
def c8_istream(spark, sf_dir):
    return windows.istream(_members(spark, sf_dir), SUB[1], ["topic", "device"])


@query(
    "c8_dstream",
    with_sql(
        "SELECT * FROM shifted EXCEPT SELECT * FROM members",
        OBS, sql_assigned(HOUR, 30 * MINUTE), _MEMBERS,
    ),
)
def c8_dstream(spark, sf_dir):
    return windows.dstream(_members(spark, sf_dir), SUB[1], ["topic", "device"])


@query(
    "c8_istream_bag",
    with_sql(
        """SELECT w_start, topic, device FROM assigned
EXCEPT ALL SELECT w_start + INTERVAL 30 MINUTE, topic, device FROM assigned""",
        OBS, sql_assigned(HOUR, 30 * MINUTE),
    ),
)
def c8_bag(spark, sf_dir):
    return windows.istream(_members(spark, sf_dir), SUB[1], ["topic", "device"], bag=True)


_SEEN = """seen AS (
  SELECT *, max(ts) OVER (PARTITION BY topic ORDER BY arrival
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_ts
  FROM late),
labelled AS (
  SELECT *, CASE WHEN seen_ts IS NULL OR seen_ts <= ts THEN 'in_order'
                 WHEN epoch_us(seen_ts) - us <= 3600000000 THEN 'late' ELSE 'too_late' END AS lateness
  FROM seen)"""


@query(
    "c9_classify_lateness",
    with_sql("SELECT subject, topic, arrival, ts, seen_ts, lateness FROM labelled", OBS, LATE, _SEEN),
)
def c9(spark, sf_dir):
    obs = shuffled(observations(spark, sf_dir))
    out = windows.classify_lateness(obs, "1 hour")
    return out.select("subject", "topic", "arrival", "ts", "seen_ts", "lateness")


@query(
    "c10_drop_late",
    with_sql(
        "SELECT subject, topic, arrival, ts, value FROM labelled WHERE lateness <> 'too_late'",
        OBS, LATE, _SEEN,
    ),
)
def c10(spark, sf_dir):
    obs = shuffled(observations(spark, sf_dir))
    return windows.drop_late(obs, "1 hour").select("subject", "topic", "arrival", "ts", "value")


@query(
    "c11_watermark_progress",
    with_sql(
        """SELECT subject, topic, arrival, ts,
  max(ts) OVER (PARTITION BY topic ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS watermark FROM late""",
        OBS, LATE,
    ),
)
def c11(spark, sf_dir):
    obs = shuffled(observations(spark, sf_dir))
    out = windows.watermark_progress(obs)
    return out.select("subject", "topic", "arrival", "ts", "watermark")


@query(
    "c12_expected_timing_filter",
    with_sql(
        """SELECT subject, topic, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY topic, since // 3600000000 ORDER BY since, subject) AS k
  FROM (SELECT *, us - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS since FROM obs)
  WHERE since >= 0 AND since % 3600000000 <= 600000000) WHERE k = 1""",
        OBS,
    ),
)
def c12(spark, sf_dir):
    obs = observations(spark, sf_dir).select("subject", "topic", "ts", "value")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return windows.expected_timing_filter(obs, start, "1 hour", "10 minutes")


# --- panes -----------------------------------------------------------------------------------

_PANES = """panes AS (
  SELECT topic, date_trunc('hour', ts) + INTERVAL 30 MINUTE * (minute(ts) // 30) AS p_start,
         count(*) AS n, CAST(sum(cents) AS DOUBLE) / 100.0 AS "sum", min(value) AS "min",
         max(value) AS "max"
  FROM obs GROUP BY 1, 2),
pane_windows AS (
  SELECT *, date_trunc('hour', p_start) - INTERVAL 1 HOUR * i AS w_start,
         date_trunc('hour', p_start) - INTERVAL 1 HOUR * i + INTERVAL 2 HOUR AS w_end
  FROM panes, range(2) r(i))"""


def _panes(spark, sf_dir):
    return panes.pane_partials(observations(spark, sf_dir), [*SUB, *OUT], scale=SCALE)


@query(
    "d1_pane_partials",
    with_sql(
        """SELECT topic, p_start, p_start + INTERVAL 30 MINUTE AS p_end, n, "sum", "min", "max"
FROM panes""",
        OBS, _PANES,
    ),
)
def d1_panes(spark, sf_dir):
    return _panes(spark, sf_dir)


@query(
    "d1_pane_rollup",
    with_sql(
        "SELECT topic, w_start, w_end, value, n FROM exact",
        OBS, sql_windowed("AVG", 2 * HOUR, HOUR, "exact"),
    ),
)
def d1_rollup(spark, sf_dir):
    """The registered query answered from the panes its sub-queries share."""
    return panes.rollup(_panes(spark, sf_dir), *OUT, "AVG", scale=SCALE)


@query(
    "d2_chunk_combine",
    with_sql(
        """SELECT w_start, w_end, round(avg("sum" / n), 9) AS value, count(*) AS n_panes
FROM pane_windows GROUP BY w_start, w_end""",
        OBS, _PANES,
    ),
)
def d2(spark, sf_dir):
    results = panes.pane_results(_panes(spark, sf_dir), "AVG")
    return panes.chunk_combine(results, *OUT, "AVG").withColumn("value", F.round("value", 9))


def _register_chunks() -> None:
    """D2 for the other aggregates: panes report one, and a window combines what its panes report."""
    combined = {
        "SUM": 'round(sum("sum"), 4)',
        "COUNT": "CAST(count(*) AS DOUBLE)",  # panes that report, not rows in them
        "MIN": 'min("min")',
        "MAX": 'max("max")',
    }
    for agg, expression in combined.items():
        sql = f"SELECT w_start, w_end, {expression} AS value, count(*) AS n_panes FROM pane_windows GROUP BY w_start, w_end"

        def run(spark, sf_dir, agg=agg):
            results = panes.pane_results(_panes(spark, sf_dir), agg)
            out = panes.chunk_combine(results, *OUT, agg)
            return out.withColumn("value", F.round("value", 4)) if agg == "SUM" else out

        query(f"d2_chunk_combine_{agg.lower()}", with_sql(sql, OBS, _PANES))(run)


_register_chunks()


@query(
    "d3_chunk_combine_by_topic",
    with_sql(
        """SELECT topic, w_start, w_end,
  CASE WHEN count(v) > 0 THEN round(avg(v), 7) END AS value, count(v) AS n_panes
FROM (SELECT *, CASE WHEN n % 3 <> 0 THEN "max" END AS v FROM pane_windows)
GROUP BY topic, w_start, w_end""",
        OBS, _PANES,
    ),
)
def d3(spark, sf_dir):
    """Panes report a triple, a quoted triple or, if their count divides by 3, a bare number."""
    from tidepane.functions.messages import result_triple

    triple = result_triple("max", ["topic", "p_start"])
    quoted = F.concat(F.lit('"'), F.replace(triple, F.lit('"'), F.lit('\\"')), F.lit('"'))
    message = (
        F.when(F.col("n") % 3 == 0, F.col("max").cast("string"))
        .when(F.col("n") % 3 == 1, triple)
        .otherwise(quoted)
    )
    messages = _panes(spark, sf_dir).withColumn("message", message)
    out = panes.chunk_combine_by_topic(messages, *OUT, "AVG")
    return out.withColumn("value", F.round("value", 7))


@query(
    "d4_pane_completeness",
    with_sql(
        """SELECT w_start, w_end, count(*) AS n_panes, CAST(20 AS BIGINT) AS expected,
  count(*) >= 20 AS complete FROM pane_windows GROUP BY w_start, w_end""",
        OBS, _PANES,
    ),
)
def d4(spark, sf_dir):
    return panes.pane_completeness(_panes(spark, sf_dir), *OUT, sub_queries=5, pane="30 minutes")


@query(
    "d5_exact_answer",
    with_sql(
        f"""SELECT topic, grouping(topic) = 1 AS is_total, w_start, w_end, {SQL_AGG['AVG']} AS value,
  count(*) AS n
FROM a GROUP BY GROUPING SETS ((w_start, w_end, topic), (w_start, w_end))""",
        OBS, sql_assigned(2 * HOUR, HOUR, "a"),
    ),
)
def d5(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return panes.exact_answer(obs, *OUT, "AVG", scale=SCALE)

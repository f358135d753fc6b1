"""Registered queries that run as streams over the events, up to the data present."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepane.functions.timegrid import from_micros, micros
from tidepane.plans.catalog import ORACLES, query
from tidepane.plans.inputs import MINUTE, OBS, OUT, SCALE, SUB, sql_sub, sql_windowed, table, with_sql
from tidepane.plans.merge_queries import _IRREGULAR, _OVER, TOPICS, read_record
from tidepane.plans.window_queries import _PANES
from tidepane.session import staging_path
from tidepane.streaming import live, tables
from tidepane.streaming import operators as ops
from tidepane.streaming.io import drain, read_stream

DELAY = "10 minutes"

# Watermark at the end of the data, in whole milliseconds as Spark keeps it.
_MARK = "mark AS (SELECT make_timestamp((max(us) // 1000 - 600000) * 1000) AS w FROM obs)"


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    events = read_stream(spark, sf_dir, schema, pathGlobFilter="events.parquet")
    return events.select(
        F.concat(F.lit("obs"), F.col("event_id").cast("string")).alias("subject"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("device"),
        F.col("event_type").alias("topic"),
        from_micros(micros("ts"), "timestamp").alias("ts"),
        "value",
    )


def _plain_times(df, *columns):
    return df.withColumns({c: from_micros(micros(c)) for c in columns})


@query("a6_stream_round_trip", with_sql("SELECT subject, device, topic, ts, value FROM obs", OBS))
def a6(spark, sf_dir):
    """Source to sink without an operator: every row arrives once."""
    return _plain_times(drain(_stream(spark, sf_dir)), "ts")


@query(
    "c5_report_on_close",
    with_sql("SELECT topic, w_start, w_end, value, n FROM sub, mark WHERE w_end <= w", OBS, sql_sub(), _MARK),
)
def c5(spark, sf_dir):
    out = ops.stream_sliding_agg(_stream(spark, sf_dir), *SUB, "AVG", DELAY, scale=SCALE)
    return _plain_times(drain(out), "w_start", "w_end")


@query(
    "c13_stream_update_mode",
    with_sql("SELECT topic, w_start, w_end, value, n FROM sub", OBS, sql_sub("MAX")),
)
def c13_update(spark, sf_dir):
    """Reported on every change; the last report per window is its result."""
    out = drain(ops.stream_sliding_agg(_stream(spark, sf_dir), *SUB, "MAX", DELAY), "update")
    last = F.max_by(F.struct("value", "n"), "batch").alias("_last")
    final = out.groupBy("topic", "w_start", "w_end").agg(last).select("topic", "w_start", "w_end", "_last.*")
    return _plain_times(final, "w_start", "w_end")


@query("c13_stream_dedupe", with_sql("SELECT subject, topic, ts, value FROM obs", OBS))
def c13_dedupe(spark, sf_dir):
    """Every row sent twice; the second copy is dropped."""
    twice = _stream(spark, sf_dir).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = ops.stream_dedupe(twice, ["subject"], DELAY).select("subject", "topic", "ts", "value")
    return _plain_times(drain(out), "ts")


@query(
    "c13_stream_merge",
    with_sql(
        """SELECT topic, t_start, t_end, max(value) AS value FROM parts, mark
WHERE t_end + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND <= w GROUP BY topic, t_start, t_end""",
        OBS, sql_sub("MAX"), _OVER, _MARK,
    ),
)
def c13_merge(spark, sf_dir):
    """Sub-queries and their merge as one stream."""
    out = ops.stream_approximate(_stream(spark, sf_dir), SUB, OUT, "MAX", DELAY)
    return _plain_times(drain(out), "t_start", "t_end")


def _register_merges() -> None:
    """The same for the aggregates whose values are sums of doubles, rounded."""
    weighted = "round(sum(value * (o_end - o_start)) / sum(o_end - o_start), 8)"
    spread = "round(sum(value * (o_end - o_start) / w_us), 6)"
    for agg, expression, digits in (("AVG", weighted, 8), ("SUM", spread, 6)):
        sql = f"""SELECT topic, t_start, t_end, {expression} AS value FROM parts, mark
WHERE t_end + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND <= w GROUP BY topic, t_start, t_end"""

        def run(spark, sf_dir, agg=agg, digits=digits):
            out = drain(ops.stream_approximate(_stream(spark, sf_dir), SUB, OUT, agg, DELAY))
            return _plain_times(out, "t_start", "t_end").withColumn("value", F.round("value", digits))

        query(f"c13_stream_merge_{agg.lower()}", with_sql(sql, OBS, sql_sub(agg), _OVER, _MARK))(run)


_register_merges()


# Targets that the end of the data has closed: no result window that overlaps them can come any more.
_CLOSED = "t_end + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND <= (SELECT w FROM mark)"


def _closed_rows(name: str) -> str:
    """The SQL of a batch query, for the closed targets only."""
    body = ORACLES[name]
    return f"WITH {_MARK.replace('FROM obs', 'FROM (SELECT epoch_us(ts) AS us FROM events)')} SELECT * FROM ({body}) WHERE {_CLOSED}"


def _closed_windows(name: str, closed: str = "w_start + INTERVAL 1 HOUR <= (SELECT w FROM mark)") -> str:
    """The SQL of a batch query, for the closed windows only."""
    return f"WITH {_MARK.replace('FROM obs', 'FROM (SELECT epoch_us(ts) AS us FROM events)')} SELECT * FROM ({ORACLES[name]}) WHERE {closed}"


def _live(spark, sf_dir, agg, finish):
    windows = live.sub_query_windows(_stream(spark, sf_dir), SUB, agg, DELAY, scale=SCALE)
    return _plain_times(live.drain_live(windows, SUB[0], *OUT, agg, finish), "t_start", "t_end")


@query("c13_stream_merge_count", _closed_rows("e4c_merge_count"))
def c13_merge_count(spark, sf_dir):
    """The COUNT merge, whose targets are ranked as they close."""
    return _live(spark, sf_dir, "COUNT", live.merged)


@query("e9_stream_unify", _closed_rows("e9_unify_avg"))
def e9_stream(spark, sf_dir):
    """From raw rows to one value over all topics in one stream."""
    out = _live(spark, sf_dir, "AVG", live.unified("AVG"))
    return out.withColumn("value", F.round("value", 8)).drop("n_latest", "n_merged")


@query("e9_stream_unify_count", _closed_rows("e9_unify_count"))
def e9_stream_count(spark, sf_dir):
    out = _live(spark, sf_dir, "COUNT", live.unified("COUNT"))
    return out.withColumn("value", F.round("value", 8)).drop("n_latest", "n_merged")


@query("e12_stream_record", _closed_rows("e12_result_record"))
def e12_stream(spark, sf_dir):
    """From raw rows to the nested record of every target in one stream."""
    return read_record(_live(spark, sf_dir, "MAX", live.records("MAX", len(TOPICS))))


@query(
    "e1_stream_messages",
    with_sql(
        f"""SELECT topic, t_start, t_end, round(sum(value * (o_end - o_start)) / sum(o_end - o_start), 8) AS value
FROM parts WHERE {_CLOSED} GROUP BY topic, t_start, t_end""",
        OBS, _IRREGULAR, _OVER, _MARK.replace("max(us) // 1000", "(max(us) - 1) // 1000"),
    ),
)
def e1_stream(spark, sf_dir):
    """Result messages at any time, turned into windows and merged in one stream."""
    params = {t: ("1 hour" if t != "view" else "30 minutes", "AVG") for t in TOPICS}
    windows = live.message_windows(_stream(spark, sf_dir).select("topic", "ts", "value"), params, DELAY)
    out = live.drain_live(windows, "1 hour", *OUT, "AVG", live.merged)
    return _plain_times(out, "t_start", "t_end").withColumn("value", F.round("value", 8))


@query(
    "d2_stream_chunks",
    with_sql(
        """SELECT w_start, w_end, max("max") AS value, count(*) AS n_panes FROM pane_windows, mark
WHERE w_end <= w GROUP BY w_start, w_end""",
        OBS, _PANES, _MARK,
    ),
)
def d2_stream(spark, sf_dir):
    """Half-hour panes of all topics and the windows over them as one stream."""
    out = ops.stream_chunks(_stream(spark, sf_dir), SUB[1], OUT, "MAX", DELAY)
    return _plain_times(drain(out), "w_start", "w_end")


@query(
    "e7_stream_latest",
    with_sql("SELECT topic, max(ts) AS ts, arg_max(value, ts) AS value FROM obs GROUP BY topic", OBS),
)
def e7_stream(spark, sf_dir):
    out = drain(ops.stream_latest(_stream(spark, sf_dir)), "update")
    newest = F.max(F.struct("ts", "value")).alias("_last")
    return _plain_times(out.groupBy("topic").agg(newest).select("topic", "_last.*"), "ts")


_GAPS = """halves AS (SELECT topic, w_end AS ts, epoch_us(w_end) AS us FROM half, mark WHERE w_end <= w),
numbered AS (
  SELECT *, row_number() OVER w AS n, (us - min(us) OVER w) / 1000.0::DOUBLE / nullif(row_number() OVER w - 1, 0) AS mean_ms
  FROM halves WINDOW w AS (PARTITION BY topic ORDER BY ts ROWS UNBOUNDED PRECEDING)),
timed AS (
  SELECT *, CASE WHEN n >= 3 AND mean_ms > 0 THEN least(mean_ms * 1.5::DOUBLE, 5400000.0::DOUBLE) ELSE 3600000.0::DOUBLE END AS timeout_ms,
         lead(ts) OVER (PARTITION BY topic ORDER BY ts) AS next_ts, max(us) OVER () // 1000 - 600000 AS end_ms FROM numbered)"""


@query(
    "e14_stream_gaps",
    with_sql(
        """SELECT topic, ts AS silent_since, timeout_ms, next_ts AS resumed_at FROM timed
WHERE CASE WHEN next_ts IS NULL THEN floor(us / 1000.0::DOUBLE + timeout_ms) + 1 < end_ms
           ELSE (epoch_us(next_ts) - us) / 1000.0::DOUBLE > timeout_ms END""",
        OBS, sql_windowed("AVG", 30 * MINUTE, 30 * MINUTE, "half"), _MARK, _GAPS,
    ),
)
def e14_stream(spark, sf_dir):
    """Silences of the half-hour results of all topics, which one stream writes and one reads."""
    results = drain(ops.stream_sliding_agg(_stream(spark, sf_dir), SUB[1], SUB[1], "AVG", DELAY))
    published = results.select("topic", F.col("w_end").alias("ts"), "value")
    folder = staging_path(spark, "results")
    published.write.parquet(folder)
    incoming = read_stream(spark, folder, published.schema)
    out = tables.stream_gaps(incoming, DELAY, fallback_ms=3_600_000, max_ms=5_400_000, multiplier=1.5)
    return _plain_times(out.drop("batch"), "silent_since", "resumed_at")


@query("c8_stream_istream", _closed_windows("c8_istream"))
def c8_istream(spark, sf_dir):
    """Devices new in each window as it closes."""
    out = ops.stream_istream(_stream(spark, sf_dir), *SUB, ["topic", "device"], DELAY)
    return _plain_times(drain(out), "w_start")


@query("c8_stream_dstream", _closed_windows("c8_dstream"))
def c8_dstream(spark, sf_dir):
    """Devices gone from each window as it closes."""
    out = ops.stream_dstream(_stream(spark, sf_dir), *SUB, ["topic", "device"], DELAY)
    return _plain_times(drain(out), "w_start")


@query("c8_stream_istream_bag", _closed_windows("c8_istream_bag"))
def c8_bag(spark, sf_dir):
    out = ops.stream_istream(_stream(spark, sf_dir), *SUB, ["topic", "device"], DELAY, bag=True)
    return _plain_times(drain(out), "w_start")


@query("d5_stream_exact", _closed_windows("d5_exact_answer", "w_end <= (SELECT w FROM mark)"))
def d5_stream(spark, sf_dir):
    """Exact windows per topic and over all topics as one stream."""
    out = ops.stream_exact(_stream(spark, sf_dir), *OUT, "AVG", DELAY, scale=SCALE)
    return _plain_times(drain(out), "w_start", "w_end")


@query("f3_stream_signature_live", ORACLES["f3_stream_signature"])
def f3_live(spark, sf_dir):
    """Signatures kept up to date by a stream; the last one of each topic."""
    out = tables.stream_profile(_stream(spark, sf_dir).select("topic", "subject", "ts", "value"))
    fields = ["triple_count", "variance", "entropy", "skewness", "fft_entropy"]
    last = out.groupBy("topic").agg(F.max_by(F.struct(*fields), "batch").alias("s")).select("topic", "s.*")
    digits = {"variance": 6, "entropy": 9, "skewness": 6, "fft_entropy": 6}
    return last.withColumns({c: F.round(c, d) for c, d in digits.items()})

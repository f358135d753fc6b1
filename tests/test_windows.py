"""Hand-computed window cases and properties."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import at, rows, seconds
from tidepane.functions.timegrid import common_period_us, duration_us, explode_range, pane_us
from tidepane.operators import merge, panes, windows


def test_alignment_of_starts(make_obs):
    got = windows.assign_windows(make_obs([("t", 23, 1)]), "10 seconds", "4 seconds")
    assert sorted(seconds(r.w_start) % 86400 for r in got.collect()) == [
        s for s in _starts(23, 10, 4)
    ]


def _starts(t, width, slide):
    """Windows [o, o + width) that hold ``t``, with starts at -width modulo slide of the epoch."""
    base = int((at(0) - at(0).replace(year=1970)).total_seconds())
    found = []
    for o in range(t - width + 1, t + 1):
        if (base + o + width) % slide == 0:
            found.append(float(o))
    return found


def test_alignment_at_the_epoch(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '1970-01-01 00:00:23' AS ts, 't' AS topic, 1.0D AS value")
    got = windows.assign_windows(df, "10 seconds", "4 seconds").collect()
    assert sorted(r.w_start.second for r in got) == [14, 18, 22]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(width=st.integers(1, 30), slide=st.integers(1, 12), seed=st.integers(0, 100))
def test_panes_equal_direct_windows(make_obs, width, slide, seed):
    rng = random.Random(seed)
    obs = make_obs([(rng.choice("ab"), rng.randrange(90), rng.randrange(100)) for _ in range(40)])
    w, s = f"{width} seconds", f"{slide} seconds"
    direct = (
        windows.assign_windows(obs, w, s)
        .groupBy("topic", "w_start")
        .agg(F.sum("value").alias("value"), F.count("value").alias("n"))
    )
    for r in windows.assign_windows(obs, w, s).collect():
        assert r.w_start <= r.ts < r.w_end
        assert (r.w_end - r.w_start).total_seconds() == width
    rolled = panes.rollup(panes.pane_partials(obs, [w, s]), w, s, "SUM")
    assert rows(rolled, "topic", "w_start", "value", "n") == rows(direct, "topic", "w_start", "value", "n")


def test_pane_width():
    assert pane_us("10 seconds", "2 seconds", "20 seconds", "5 seconds") == duration_us("1 second")
    assert pane_us(60000, 30000, 120000) == duration_us("30 seconds")
    assert common_period_us("12 seconds", "18 seconds") == duration_us("36 seconds")


def test_window_at_takes_the_window_that_ends_first(make_obs, spark):
    obs = make_obs([("t", 1, 1), ("t", 6, 2), ("t", 11, 3)])
    probes = spark.createDataFrame([(at(10),)], "probe_ts TIMESTAMP_NTZ")
    got = windows.window_at(obs, probes, "10 seconds", "5 seconds")
    # [0, 10) still counts at 10, since the end is included here.
    assert rows(got, "value") == [(1.0,), (2.0,)]


def test_lateness(make_obs):
    obs = make_obs([("t", 10, 0), ("t", 30, 0), ("t", 25, 0), ("t", 5, 0), ("t", 31, 0), ("u", 1, 0)])
    got = windows.classify_lateness(obs, "10 seconds")
    assert [r.lateness for r in got.orderBy("arrival").collect()] == [
        "in_order", "in_order", "late", "too_late", "in_order", "in_order",
    ]
    assert windows.drop_late(obs, "10 seconds").count() == 5


def test_istream_and_dstream(spark):
    rel = spark.createDataFrame(
        [(at(0), "x"), (at(0), "y"), (at(10), "y"), (at(10), "z")], "w_start TIMESTAMP_NTZ, v STRING"
    )
    ins = windows.istream(rel, "10 seconds", ["v"])
    gone = windows.dstream(rel, "10 seconds", ["v"])
    assert rows(ins, "w_start", "v") == [(at(0), "x"), (at(0), "y"), (at(10), "z")]
    assert rows(gone, "w_start", "v") == [(at(10), "x"), (at(20), "y"), (at(20), "z")]


def _accept_one_by_one(times, start, period, tol):
    kept, last = [], None
    for t in sorted(times):
        if t < start:
            continue
        near = (t - start) % period <= tol
        if near and (last is None or t - last >= period - tol):
            kept.append(t)
            last = t
    return kept


@pytest.mark.parametrize("seed", range(6))
def test_expected_timing_equals_accepting_one_by_one(make_obs, seed):
    rng = random.Random(seed)
    times = sorted({rng.randrange(0, 600) for _ in range(120)})
    got = windows.expected_timing_filter(
        make_obs([("t", t, 0) for t in times]), F.lit(at(0)).cast("timestamp_ntz"), "60 seconds", "5 seconds"
    )
    assert [seconds(r.ts) for r in got.orderBy("ts").collect()] == _accept_one_by_one(times, 0, 60, 5)


def test_expected_timing_refuses_wide_tolerance(make_obs):
    with pytest.raises(ValueError):
        windows.expected_timing_filter(make_obs([("t", 0, 0)]), "ts", "60 seconds", "30 seconds")


def test_unknown_aggregate_is_refused(make_obs):
    with pytest.raises(ValueError):
        windows.sliding_agg(make_obs([("t", 0, 0)]), "10 seconds", "5 seconds", "MEDIAN")


def test_unweighted_combination_is_biased(make_obs):
    obs = make_obs([("t", 1, 10), ("t", 2, 10), ("t", 3, 10), ("t", 11, 50)])
    partial = panes.pane_partials(obs, ["10 seconds"])
    exact = panes.rollup(partial, "20 seconds", "20 seconds", "AVG").first()
    loose = panes.chunk_combine(panes.pane_results(partial, "AVG"), "20 seconds", "20 seconds", "AVG").first()
    assert (exact.value, loose.value) == (20.0, 30.0)


def test_chunk_combine_by_topic_ignores_bare_numbers(spark):
    triple = '<urn:r> <https://saref.etsi.org/core/hasValue> "4.5"^^<http://www.w3.org/2001/XMLSchema#float> .'
    data = [("t", at(0), at(10), triple), ("t", at(0), at(10), "4.5"), ("u", at(0), at(10), "9")]
    df = spark.createDataFrame(data, "topic STRING, p_start TIMESTAMP_NTZ, p_end TIMESTAMP_NTZ, message STRING")
    got = panes.chunk_combine_by_topic(df, "10 seconds", "10 seconds", "SUM")
    assert rows(got, "topic", "value") == [("t", 4.5), ("u", None)]


def test_exact_answer_totals(make_obs):
    obs = make_obs([("a", 1, 2), ("b", 2, 4), ("c", 3, 100)])
    got = panes.exact_answer(obs, "10 seconds", "10 seconds", "SUM", topics=["a", "b"])
    found = {(r.topic, r.is_total): r.value for r in got.collect()}
    assert found == {("a", False): 2.0, ("b", False): 4.0, (None, True): 6.0}


@pytest.fixture(params=["UTC", "Asia/Kolkata", "Europe/Berlin"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_one_grid_in_every_zone(spark, zone):
    """Direct windows, panes and the windows at a time meet, on the day the clocks change in Berlin too."""
    obs = spark.sql(
        "SELECT TIMESTAMP_NTZ '2024-03-31 00:10:00' + make_dt_interval(0, 0, CAST(id * 7 AS INT)) AS ts, 't' AS topic, "
        "CAST(id AS DOUBLE) AS value, concat('o', id) AS subject FROM range(60)"
    )
    direct = windows.sliding_agg(obs, "1 hour", "30 minutes", "SUM")
    wide = windows.sliding_agg(obs, "5 hours", "30 minutes", "SUM")
    exact = panes.exact_answer(obs, "1 hour", "30 minutes", "SUM").filter("topic = 't'")
    starts = {r.w_start for r in direct.collect()}
    assert starts == {r.w_start for r in exact.collect()}
    assert starts <= {r.w_start for r in wide.collect()}
    assert all(s.minute in (0, 30) and s.second == 0 for s in starts)
    probes = obs.filter("subject = 'o20'").select(F.col("ts").alias("probe_ts"))
    assert windows.window_at(obs, probes, "1 hour", "30 minutes").count() > 0


def test_epoch_in_every_zone(spark, zone):
    test_alignment_at_the_epoch(spark)


def test_long_ranges_are_laid_out_in_runs(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 5L, 1000004L), ('b', 3L, 2L), ('c', 7L, 7L), ('d', NULL, 3L) AS t(k, x, y)")
    got = explode_range(df, "n", F.col("x"), F.col("y")).groupBy("k").agg(F.count("n"), F.min("n"), F.max("n"), F.countDistinct("n"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1000000, 5, 1000004, 1000000), ("c", 1, 7, 7, 1)]


def test_a_silence_of_a_million_slides(make_obs):
    """The latest value is carried over every slide of a long silence, without an array of that length."""
    obs = make_obs([("t", 0, 1), ("t", 1_000_000, 2)])
    got = merge.asof_latest(obs, "2 seconds", "1 second")
    assert (got.count(), got.filter("latest = 1.0").count()) == (1_000_001, 1_000_000)


@pytest.mark.parametrize("width, slide", [("60 seconds", "5 seconds"), ("50 seconds", "4 seconds"), ("33 seconds", "3 seconds"), ("45 seconds", "1 second")])
def test_wide_windows_from_blocks_equal_copies(make_obs, monkeypatch, width, slide):
    """Sparse and dense stretches, times before the epoch's grid and rows without a value."""
    r = random.Random(4)
    times = sorted({r.randrange(-300, 300) for _ in range(60)} | set(range(900, 1000, 2)))
    obs = make_obs([(r.choice("ab"), t, r.randrange(-50, 50) / 4) for t in times]).withColumn(
        "value", F.when(F.col("arrival") % 11 > 0, F.col("value"))
    )
    partial = panes.pane_partials(obs, [width, slide, 500])
    for scale in (None, 2):
        results = []
        for direct in (1000, 8):
            monkeypatch.setattr(panes, "DIRECT_WINDOWS", direct)
            windows_of = panes.window_partials(partial, width, slide, ["topic"], scale)
            exact = panes.exact_answer(obs, width, slide, "SUM", scale=scale).select("topic", "is_total", "w_start", "w_end", "value", "n")
            results.append([sorted(map(repr, df.collect())) for df in (windows_of, exact)])
        assert results[0] == results[1]

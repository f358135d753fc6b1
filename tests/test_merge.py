"""Merging of result windows: hand-computed cases and comparison with direct evaluation."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import at, rows, seconds
from tidepane.operators import merge


def _targets(df):
    return {(r.topic, seconds(r.t_start)): r.value for r in df.collect()}


def test_average_is_weighted_by_overlap(make_windows):
    win = make_windows([("t", 0, 60, 10), ("t", 30, 90, 20)])
    got = _targets(merge.merge_windows(win, "60 seconds", "60 seconds", "AVG"))
    assert got[("t", 0.0)] == pytest.approx((10 * 60 + 20 * 30) / 90)
    assert got[("t", 60.0)] == pytest.approx(20)


def test_a_window_without_a_value_has_no_weight(make_windows):
    win = make_windows([("t", 0, 60, 10), ("t", 0, 60, -1)]).withColumn("value", F.when(F.col("value") > 0, F.col("value")))
    assert _targets(merge.merge_windows(win, "60 seconds", "60 seconds", "AVG")) == {("t", 0.0): 10.0}


def test_sum_is_spread_over_the_window(make_windows):
    win = make_windows([("t", 0, 60, 12), ("t", 30, 90, 6)])
    got = _targets(merge.merge_windows(win, "60 seconds", "60 seconds", "SUM"))
    assert got == {("t", 0.0): pytest.approx(15), ("t", 60.0): pytest.approx(3)}


def test_count_counts_each_elementary_interval(make_windows):
    win = make_windows([("t", 0, 60, 5), ("t", 20, 40, 1)])
    got = _targets(merge.merge_windows(win, "60 seconds", "60 seconds", "COUNT"))
    # Borders 0, 20, 40, 60: the first window covers three intervals, the second one.
    assert got == {("t", 0.0): 16.0}


def _direct(windows, start, end, agg):
    """Evaluation by boundaries, as a plain loop."""
    over = [w for w in windows if w[1] > start and w[0] < end]
    cuts = sorted({start, end} | {x for w in over for x in w[:2] if start < x < end})
    total = 0.0
    for a, b in zip(cuts, cuts[1:]):
        covering = [w for w in over if w[0] <= a and w[1] >= b]
        if agg == "SUM":
            total += sum(w[2] / (w[1] - w[0]) for w in covering) * (b - a)
        else:
            total += sum(w[2] for w in covering)
    return total


@pytest.mark.parametrize("agg", ["SUM", "COUNT"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closed_forms_equal_boundary_evaluation(make_windows, agg, seed):
    rng = random.Random(seed)
    data = []
    for _ in range(60):
        start = rng.randrange(0, 200)
        data.append((start, start + rng.randrange(1, 70), rng.randrange(1, 9)))
    win = make_windows([("t", *w) for w in data])
    got = _targets(merge.merge_windows(win, "60 seconds", "20 seconds", agg))
    assert len(got) > 5
    for (_, start), value in got.items():
        assert value == pytest.approx(_direct(data, start, start + 60, agg))


def test_count_on_split_groups(make_windows, monkeypatch):
    rng = random.Random(9)
    data = [("t", s, s + rng.randrange(1, 50), 1) for s in (rng.randrange(0, 100) for _ in range(80))]
    win = make_windows(data)
    want = _targets(merge.merge_windows(win, "60 seconds", "60 seconds", "COUNT"))
    monkeypatch.setattr("tidepane.operators.ordered.MAX_GROUP_ROWS", 10)
    assert _targets(merge.merge_windows(win, "60 seconds", "60 seconds", "COUNT")) == want


def test_zero_length_windows(make_windows):
    win = make_windows([("t", 10, 10, 7)])
    assert _targets(merge.merge_windows(win, "60 seconds", "60 seconds", "SUM")) == {("t", 0.0): 0.0}
    assert _targets(merge.merge_windows(win, "60 seconds", "60 seconds", "AVG")) == {("t", 0.0): 0.0}
    assert _targets(merge.merge_windows(win, "60 seconds", "60 seconds", "MAX")) == {("t", 0.0): 7.0}


def test_pair_merge(spark):
    df = spark.createDataFrame(
        [(at(0), at(60), at(30), at(90))],
        "s1 TIMESTAMP_NTZ, e1 TIMESTAMP_NTZ, s2 TIMESTAMP_NTZ, e2 TIMESTAMP_NTZ",
    )

    def value(agg):
        col = merge.merge_pair(
            agg,
            (F.col("s1"), F.col("e1"), F.lit(10.0)),
            (F.col("s2"), F.col("e2"), F.lit(20.0)),
            F.lit(15.0),
            (F.col("s1"), F.col("e2")),
        )
        return df.select(col.alias("v")).first().v

    total = 10 * 60000 + 20 * 60000 - 15 * 30000
    assert value("SUM") == total
    assert value("AVG") == pytest.approx(total / 90000)
    assert (value("COUNT"), value("MIN"), value("MAX")) == (15.0, 10.0, 20.0)
    with pytest.raises(ValueError):
        value("MEDIAN")


def test_naive_merge_takes_unknown_aggregates_as_average(make_windows):
    win = make_windows([("t", 0, 60, 10), ("t", 30, 60, 40)])
    got = _targets(merge.merge_naive(win, "60 seconds", "60 seconds", "MEDIAN"))
    assert got == {("t", 0.0): 25.0}


def test_asof_keeps_the_latest_value_for_ever(make_obs):
    obs = make_obs([("a", 5, 1), ("a", 8, 2), ("b", 45, 9)])
    got = merge.asof_latest(obs, "20 seconds", "10 seconds")
    assert rows(got, "topic", "t_end", "latest") == [
        ("a", at(10), 2.0), ("a", at(20), 2.0), ("a", at(30), 2.0), ("a", at(40), 2.0), ("a", at(50), 2.0),
        ("b", at(50), 9.0),
    ]


def _frames(spark, merged, latest):
    kind = "topic STRING, t_start TIMESTAMP_NTZ, t_end TIMESTAMP_NTZ, {} DOUBLE"
    stamp = lambda data: [(t, at(0), at(60), v) for t, v in data]
    return (
        spark.createDataFrame(stamp(merged), kind.format("value")),
        spark.createDataFrame(stamp(latest), kind.format("latest")),
    )


def test_unify_prefers_latest_of_two_topics(spark):
    merged, latest = _frames(spark, [("a", 1.0), ("b", 3.0)], [("a", 10.0), ("b", 30.0)])
    row = merge.unify(merged, latest, "AVG").first()
    assert (row.value, row.n_topics, row.used_latest) == (20.0, 2, True)


def test_unify_falls_back_to_merged(spark):
    merged, latest = _frames(spark, [("a", 1.0)], [("a", 10.0)])
    row = merge.unify(merged, latest, "SUM").first()
    assert (row.value, row.n_topics, row.used_latest) == (1.0, 1, False)
    assert merge.unify(merged, latest, "COUNT").first().value == 1.0


def test_zero_counts_as_missing(spark):
    merged, latest = _frames(spark, [("a", 0.0), ("b", 0.0), ("c", 5.0)], [("a", 7.0), ("b", 0.0)])
    buffered = latest.withColumnRenamed("latest", "buffered").filter("topic = 'b'")
    got = merge.individual_results(merged, buffered, latest)
    assert rows(got, "topic", "value") == [("a", 7.0), ("b", 0.0), ("c", 5.0)]


def test_adaptive_timeout_and_gaps(make_obs):
    obs = make_obs([("t", 0, 0), ("t", 10, 0), ("t", 20, 0), ("t", 60, 0)])
    timed = merge.adaptive_timeout(obs)
    got = merge.flag_gaps(timed).orderBy("ts").collect()
    # Two samples are too few for the mean; then half the mean interval, capped.
    assert [r.timeout_ms for r in got] == [5000.0, 5000.0, 5000.0, 10000.0]
    assert [r.mean_interval_ms for r in got] == [None, 10000.0, 10000.0, 20000.0]
    assert [r.gap for r in got] == [True, True, True, False]


def test_cap_duration(make_obs):
    obs = make_obs([("t", 0, 0), ("t", 150, 1), ("t", 151, 2)])
    assert rows(merge.cap_duration(obs), "value") == [(0.0,), (1.0,)]


def test_expiry(make_windows):
    win = make_windows([("t", 0, 60, 1), ("t", 30, 90, 2)])
    start = F.lit(at(60)).cast("timestamp_ntz")
    assert merge.expire_windows(win, start).count() == 2
    assert merge.expire_windows(win, start, strict=True).count() == 1


def test_coverage(make_windows):
    win = make_windows([("a", 0, 60, 1), ("b", 0, 60, 1), ("a", 60, 120, 1)])
    got = merge.target_coverage(win, "60 seconds", "60 seconds", expected=2)
    assert rows(got, "t_start", "topics", "complete", "wait") == [
        (at(0), 2, True, False), (at(60), 1, False, True),
    ]


def test_record_has_the_field_names_of_each_style(spark):
    merged, latest = _frames(spark, [("a", 1.0), ("b", 3.0)], [("a", 10.0), ("b", 30.0)])
    unified = merge.unify(merged, latest, "AVG")
    individual = merged
    rate = merge.result_record(unified, individual, "AVG", 2).first()
    assert rate.record.unifiedAverage == 20.0
    assert rate.record.individualTopics == {"a": 1.0, "b": 3.0}
    meta = rate.record.metadata
    assert (meta.validBuffers, meta.globalValuesAvailable, meta.usingGlobalValues) == (2, 2, True)
    naive = merge.result_record(unified, individual, "MAX", 2, style="naive").first()
    assert naive.record.windows.end - naive.record.windows.start == 60000
    assert naive.record.individualResults == {"a": 1.0, "b": 3.0}
    assert naive.record.unifiedAverage is None


def test_result_windows_end_at_arrival(make_obs):
    obs = make_obs([("a", 100, 5), ("x", 100, 1)])
    got = merge.to_result_windows(obs, {"a": (60000, "MAX")})
    assert rows(got, "topic", "w_start", "w_end", "value", "agg") == [("a", at(40), at(100), 5.0, "MAX")]

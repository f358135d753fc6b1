"""Physical plans: what is read, what is shuffled, and what a hot group goes through."""

import pytest
from pyspark.sql import functions as F

from tidepane.operators import panes, patterns, reshape, windows
from tidepane.operators.joins import attach

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF_DIR}/events.parquet").withColumn("topic", F.col("event_type"))


def test_window_aggregate_reads_three_columns_and_shuffles_once(events):
    text = plan(windows.sliding_agg(events, "1 hour", "30 minutes", "AVG"))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in text
    assert text.count("Exchange hashpartitioning") == 1
    # Summed in the map tasks before the shuffle.
    assert "partial_avg" in text


def test_wide_windows_touch_raw_rows_once(events):
    text = plan(windows.sliding_agg(events, "24 hours", "1 hour", "SUM"))
    # panes, blocks of panes, windows
    assert text.count("Exchange hashpartitioning") == 3 and text.count("FileScan") == 1
    assert text.index("Generate explode") < text.index("FileScan")
    assert "Expand" not in text


@pytest.mark.parametrize("width, slide", [("24 hours", "1 hour"), ("1 day", "1 minute"), ("1 day", "7 minutes")])
def test_wide_windows_make_no_copies_of_panes(events, width, slide):
    partial = panes.pane_partials(events, [width, slide])
    made = panes.block_parts(partial, width, slide, ["topic"]).count()
    assert made <= 2 * panes.window_partials(partial, width, slide, ["topic"]).count()


def test_exact_answer_scans_once(events):
    text = plan(panes.exact_answer(events, "2 hours", "1 hour", "AVG"))
    assert text.count("FileScan") == 1
    # The copies for the two levels are made of panes, above the first aggregation.
    assert text.index("Expand") < text.index("FileScan")
    assert text.count("Exchange hashpartitioning") == 2


def test_topic_filter_reaches_the_scan(events):
    text = plan(panes.exact_answer(events, "2 hours", "1 hour", "AVG", topics=["view", "click"]))
    assert "PushedFilters: [In(event_type, [click,view])" in text or "In(event_type" in text


def test_istream_reads_once_without_join(events):
    members = windows.assign_windows(events, "1 hour", "30 minutes").select("w_start", "topic", "user_id")
    text = plan(windows.istream(members, "30 minutes", ["topic", "user_id"]))
    assert text.count("FileScan") == 1 and "Join" not in text


def test_pattern_filters_reach_the_scan(spark, tmp_path):
    rows = [("s", "v", "1", "g"), ("s", "p", "x", "g")]
    spark.createDataFrame(rows, "s STRING, p STRING, o STRING, g STRING").write.parquet(str(tmp_path / "t"))
    triples = spark.read.parquet(str(tmp_path / "t"))
    text = plan(patterns.bgp(triples, [("?s", "v", "?value"), ("?s", "p", "x")], scope=["g"]))
    assert "EqualTo(p,v)" in text and "EqualTo(o,x)" in text


def test_rescale_does_not_shuffle_rows(events):
    text = plan(reshape.rescale(events, 0, 1))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_many_groups_are_joined_by_shuffle(events, monkeypatch):
    monkeypatch.setattr("tidepane.operators.joins.BROADCAST_ROWS", 3)
    counts = events.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    joined = attach(events, counts, ["topic"])
    assert "broadcast" not in joined._jdf.queryExecution().logical().toString().lower()
    assert joined.count() == events.count()


def test_attach_keeps_rows_with_null_keys(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "k STRING, v INT")
    figures = df.groupBy("k").agg(F.sum("v").alias("s"))
    assert sorted(r.s for r in attach(df, figures, ["k"]).collect()) == [1, 2]

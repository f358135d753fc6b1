"""Streams over several micro-batches give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import at, rows, seconds
from tidepane.operators import merge, panes, profile, windows
from tidepane.streaming import operators as ops
from tidepane.streaming import tables
from tidepane.streaming.io import drain, read_stream


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """State of few partitions: a micro-batch of some rows is then a matter of a second."""
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", usual)


@pytest.fixture()
def feed(spark, make_obs, tmp_path):
    """A stream that gets each list of rows as one micro-batch, in order."""

    def make(*batches):
        folder = tmp_path / f"in{len(list(tmp_path.iterdir()))}"
        for i, batch in enumerate(batches):
            df = make_obs(batch).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
            df.write.mode("append").parquet(str(folder))
        return read_stream(spark, str(folder), df.schema, maxFilesPerTrigger=1)

    return make


def test_closed_windows_equal_batch(feed, make_obs):
    batches = [[("a", t, t % 7) for t in range(0, 50)], [("a", t, t % 5) for t in range(50, 90)], [("b", 200, 1)]]
    stream = ops.stream_sliding_agg(feed(*batches), "20 seconds", "10 seconds", "SUM", "5 seconds")
    got = drain(stream).withColumn("w_start", F.col("w_start").cast("timestamp_ntz"))
    batch = windows.sliding_agg(make_obs(sum(batches, [])), "20 seconds", "10 seconds", "SUM")
    closed = batch.filter(F.col("w_end") <= F.lit(at(195)))
    assert rows(got, "topic", "w_start", "value", "n") == rows(closed, "topic", "w_start", "value", "n")


def test_late_rows(feed):
    stream = ops.stream_sliding_agg(
        feed([("a", 1, 1)], [("a", 30, 1)], [("a", 31, 1)], [("a", 27, 1), ("a", 2, 100)], [("a", 100, 1)]),
        "10 seconds", "10 seconds", "SUM", "5 seconds",
    )
    got = {seconds(r.w_start): r.value for r in drain(stream).collect()}
    # 27 is late within the delay and counts; 2 is too late: its window was already reported.
    assert got[0.0] == 1.0 and got[20.0] == 1.0


def test_duplicates(feed):
    stream = ops.stream_dedupe(feed([("a", 1, 1), ("a", 2, 2)], [("a", 3, 3)]), ["subject"], "1 minute")
    assert drain(stream).count() == 2


def test_merge_equals_batch(feed, make_obs):
    data = [("a", t, (t * 13) % 11) for t in range(0, 200, 3)] + [("b", t, t % 4) for t in range(0, 200, 5)]
    data.sort(key=lambda r: r[1])
    batches = [data[:30], data[30:60], data[60:], [("z", 600, 0)]]
    for agg in ("AVG", "SUM", "MAX"):
        stream = ops.stream_approximate(
            feed(*batches), ("20 seconds", "10 seconds"), ("40 seconds", "20 seconds"), agg, "5 seconds"
        )
        got = {(r.topic, seconds(r.t_start)): r.value for r in drain(stream).collect() if r.topic != "z"}
        win = windows.sliding_agg(make_obs(data), "20 seconds", "10 seconds", agg)
        want = {
            (r.topic, seconds(r.t_start)): r.value
            for r in merge.merge_windows(win, "40 seconds", "20 seconds", agg).collect()
        }
        assert got.keys() == want.keys()
        assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_latest(feed):
    stream = ops.stream_latest(feed([("a", 1, 1), ("b", 9, 9)], [("a", 5, 2)]))
    out = drain(stream, "update")
    newest = out.groupBy("topic").agg(F.max_by("value", "batch").alias("v"))
    assert rows(newest, "topic", "v") == [("a", 2.0), ("b", 9.0)]


def test_gap_timer(feed):
    stream = feed([("a", 0, 0), ("a", 4, 0), ("b", 0, 0)], [("a", 8, 0), ("b", 2, 0)], [("b", 60, 0)], [("b", 61, 0)])
    out = tables.stream_gaps(stream, "5 seconds")
    got = {(r.topic, seconds(r.silent_since), r.resumed_at is None) for r in out.collect()}
    # "a" stops after 8; nobody speaks for it again, so its timer reports it.
    assert ("a", 8.0, True) in got
    # "b" is silent from 2 to 60.
    assert any(topic == "b" and since == 2.0 for topic, since, _ in got)


def test_topics_are_filtered(spark, feed):
    stream = feed([("a", 1, 1), ("b", 2, 2)])
    assert rows(drain(stream.filter(F.col("topic").isin("a"))), "topic") == [("a",)]


def test_count_merge_is_batch_only(feed):
    with pytest.raises(ValueError):
        ops.stream_merge(feed([("a", 1, 1)]), "20 seconds", "40 seconds", "20 seconds", "COUNT")


def test_gaps_of_one_and_of_many_micro_batches_agree(feed, make_obs):
    """Rows cut into micro-batches anywhere end the same silences as the batch operators find."""
    data = [("a", t, 0) for t in [*range(0, 40, 4), 90, 94, 98, 160, 300]] + [("b", t, 0) for t in [5, 6, 7, 8, 30, 31, 200]]
    data.sort(key=lambda r: r[1])
    timed = merge.flag_gaps(merge.adaptive_timeout(make_obs(data), tie=["subject"]), tie=["subject"])
    want = {(r.topic, seconds(r.ts), r.timeout_ms) for r in timed.filter("gap").collect()}
    assert want
    for n in (1, 7):
        cuts = [data[i : i + -(-len(data) // n)] for i in range(0, len(data), -(-len(data) // n))]
        out = tables.stream_gaps(feed(*cuts), "1 hour").collect()
        assert {(r.topic, seconds(r.silent_since), r.timeout_ms) for r in out if r.resumed_at} == want


def test_a_silence_is_told_once(spark, tmp_path, make_obs):
    gaps = tables.LiveGaps(str(tmp_path / "gaps"), "1 second")
    for n, batch in enumerate([[("a", 0, 0), ("b", 0, 0)], [("b", 60, 0)], [("b", 61, 0)], [("b", 62, 0), ("a", 62, 0)]]):
        gaps(make_obs(batch), n)
        gaps(make_obs(batch), n)  # run again
    got = sorted((r.topic, r.silent_us is not None, r.resumed_us is None) for r in gaps.results(spark).collect())
    # a's silence was told at 60, so its end is none; b's was ended by its own row
    assert got == [("a", True, True), ("b", True, False)]


@pytest.mark.parametrize("bag", [False, True])
def test_window_relations_equal_batch(feed, make_obs, bag):
    data = [(topic, t, (t * 7) % 3) for t in range(0, 100, 4) for topic in ("a", "b") if (t // 20 + len(topic)) % 3 or topic == "b"]
    data.sort(key=lambda r: r[1])
    batches = [data[:15], data[15:], [("z", 500, 1)]]
    relation = windows.assign_windows(make_obs(data), "20 seconds", "10 seconds")
    content = ["topic", "value"]
    for stream, batch in ((ops.stream_istream, windows.istream), (ops.stream_dstream, windows.dstream)):
        got = drain(stream(feed(*batches), "20 seconds", "10 seconds", content, "5 seconds", bag))
        got = got.filter("topic <> 'z'").withColumn("w_start", F.col("w_start").cast("timestamp_ntz"))
        rows_in = relation if bag else relation.select("w_start", *content).distinct()
        want = batch(rows_in, "10 seconds", content, bag=bag)
        assert rows(got, "w_start", *content) == rows(want, "w_start", *content)


def test_exact_answer_with_its_total(feed, make_obs):
    data = [(topic, t, (t * 7) % 11) for t in range(0, 100, 3) for topic in ("a", "b")]
    stream = ops.stream_exact(feed(data[:30], data[30:], [("z", 500, 1)]), "30 seconds", "10 seconds", "SUM", "5 seconds")
    got = drain(stream).withColumn("w_start", F.col("w_start").cast("timestamp_ntz"))
    want = panes.exact_answer(make_obs(data), "30 seconds", "10 seconds", "SUM")
    key = lambda df: sorted((seconds(r.w_start), r.is_total, r.topic or "", r.value, r.n) for r in df.collect())
    assert key(got) == key(want)


def test_live_profile_equals_batch_at_every_emission(spark, make_obs, tmp_path):
    """Buffers of seven points, rows out of order, a topic that stops, and a micro-batch that is run again."""
    batches = [
        [("a", t, t % 5) for t in range(0, 12)] + [("b", t, 3) for t in range(6)],
        [("a", t, t % 3) for t in (40, 20, 30, 3)] + [("c", 1, 1)],
        [("a", t, 100 - t) for t in range(50, 60)] + [("c", t, t * t) for t in range(2, 8)],
    ]
    live, so_far = tables.LiveProfile(str(tmp_path / "profile"), points=7), []
    fields = ["triple_count", "variance", "entropy", "skewness", "fft_entropy"]
    for n, batch in enumerate(batches):
        numbered = [(t, s, v) for t, s, v in batch]
        df = make_obs(numbered).withColumn("subject", F.concat(F.lit(f"{n}-"), "subject"))
        so_far.append(df)
        live(df, n)
        live(df, n)
        every = so_far[0]
        for more in so_far[1:]:
            every = every.unionByName(more)
        want = profile.stream_signature(profile.last_n(every, 7), points=7)
        told = {r.topic: r for r in live.results(spark).filter(F.col("batch") == n).collect()}
        expected = {r.topic: r for r in want.collect() if r.topic in {b[0] for b in batch}}
        assert told.keys() == expected.keys()
        for topic, row in told.items():
            assert [row[f] for f in fields] == [pytest.approx(expected[topic][f]) for f in fields]
    assert spark.read.parquet(live.at("known", 2)).groupBy("topic").count().agg(F.max("count")).first()[0] == 7

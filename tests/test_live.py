"""The live stream of targets over several micro-batches against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import at, seconds
from tidepane.operators import merge, windows
from tidepane.session import versions
from tidepane.streaming import live
from tidepane.streaming.io import read_stream

SUB, OUT = ("20 seconds", "10 seconds"), ("40 seconds", "20 seconds")


def events(seed=2, until=900):
    """Two steady topics, one that stops and one silence of all of them."""
    r = random.Random(seed)
    rows = [("a", t, r.randrange(1, 9)) for t in range(0, until, 3)] + [("b", t, r.randrange(9)) for t in range(0, until, 7)]
    rows += [("c", t, r.randrange(9)) for t in range(5, 200, 11)]
    return sorted((x for x in rows if not 400 <= x[1] < 560), key=lambda x: x[1])


@pytest.fixture(autouse=True)
def few_partitions(spark):
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", usual)


@pytest.fixture()
def feed(spark, make_obs, tmp_path):
    """A folder that streams its files one by one; more can be added later."""

    class Feed:
        folder = str(tmp_path / "in")

        def add(self, *batches):
            for batch in batches:
                df = make_obs(batch).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
                df.write.mode("append").parquet(self.folder)
                self.schema = df.schema
            return self

        def stream(self):
            return read_stream(spark, self.folder, self.schema, maxFilesPerTrigger=1)

    return Feed()


def cut(rows, n):
    size = -(-len(rows) // n)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def batch_targets(make_obs, data, agg):
    win = windows.sliding_agg(make_obs(data), *SUB, agg)
    return merge.topic_targets(win.select("topic", "w_start", "w_end", "value"), *OUT, agg)


def by_target(df, *keys):
    stamp = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("t_start", "t_end")]
    others = [c for c in df.columns if c not in ("t_start", "t_end")]
    return {(*[r[k] for k in keys], seconds(r.t_start)): tuple(r[c] for c in others if c not in keys) for r in df.select(*others, *stamp).collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key, row in got.items():
        assert row == tuple(pytest.approx(v) if isinstance(v, float) else v for v in want[key]), key


@pytest.mark.parametrize("agg", ["AVG", "COUNT", "MAX", "SUM"])
def test_closed_targets_equal_batch(feed, make_obs, agg):
    data = events()
    feed.add(*cut(data, 3), [("z", 2000, 1)])
    sub = live.sub_query_windows(feed.stream(), SUB, agg, "5 seconds")
    rows = batch_targets(make_obs, data, agg)
    got = live.drain_live(sub, SUB[0], *OUT, agg, live.merged)
    want = rows.filter("merged is not null").select("topic", "t_start", "t_end", F.col("merged").alias("value"))
    same(by_target(got, "topic"), by_target(want, "topic"))


@pytest.mark.parametrize("agg", ["AVG", "COUNT"])
def test_unified_equals_batch_through_a_silence(feed, make_obs, agg):
    """Topics that fell silent keep their latest value, also where no topic sends anything. (In batch the latest values
    end with the newest result, in the stream with the last target that closed.)"""
    data = events()
    feed.add(*cut(data, 3), [("z", 2000, 1)])
    sub = live.sub_query_windows(feed.stream(), SUB, agg, "5 seconds")
    got = live.drain_live(sub, SUB[0], *OUT, agg, live.unified(agg)).filter(F.col("t_end") <= F.lit(at(920)))
    want = merge.unified(batch_targets(make_obs, data, agg), agg).filter(F.col("t_end") <= F.lit(at(920)))
    assert by_target(want)[(440.0,)][1] == 3  # in the silence
    same(by_target(got), by_target(want))


def test_records_equal_batch(feed, make_obs):
    data = events()
    feed.add(*cut(data, 2), [("z", 2000, 1)])
    sub = live.sub_query_windows(feed.stream(), SUB, "MAX", "5 seconds")
    got = live.drain_live(sub, SUB[0], *OUT, "MAX", live.records("MAX", 3)).filter(F.col("t_end") <= F.lit(at(920)))
    want = merge.records(batch_targets(make_obs, data, "MAX"), "MAX", 3).filter(F.col("t_end") <= F.lit(at(920)))
    texts = lambda df: {k: v[-1] for k, v in by_target(df).items()}
    assert texts(got) == texts(want)


def test_messages_of_topics_with_their_own_widths(feed, make_obs):
    data = events(3)
    params = {"a": ("20 seconds", "AVG"), "b": ("7 seconds", "AVG")}
    feed.add(*cut(data, 2), [("a", 2000, 1)])
    incoming = live.message_windows(feed.stream().select("topic", "ts", "value"), params, "5 seconds")
    got = live.drain_live(incoming, "20 seconds", *OUT, "COUNT", live.merged)
    win = merge.to_result_windows(make_obs(data), params)
    want = merge.merge_windows(win, *OUT, "COUNT")
    same(by_target(got, "topic"), by_target(want, "topic"))


def test_goes_on_where_it_stopped(feed, make_obs, tmp_path):
    data = events()
    parts = cut(data, 4)
    folder = str(tmp_path / "live")

    def run():
        sub = live.sub_query_windows(feed.stream(), SUB, "AVG", "5 seconds")
        return live.drain_live(sub, SUB[0], *OUT, "AVG", live.unified("AVG"), folder)

    feed.add(*parts[:2])
    first = by_target(run())
    feed.add(*parts[2:], [("z", 2000, 1)])
    both = {k: v for k, v in by_target(run()).items() if k <= (880.0,)}
    want = by_target(merge.unified(batch_targets(make_obs, data, "AVG"), "AVG").filter(F.col("t_end") <= F.lit(at(920))))
    same({k: both[k] for k in first}, first)
    same(both, want)


def test_a_micro_batch_run_again_changes_nothing(spark, tmp_path):
    """The same rows under the same number give the same tables, also after a crash between the writes."""
    kind = "topic string, t_us bigint, merged double, buffered double, newest struct<w_end:timestamp,value:double>"
    slide = 20_000_000

    def closed(k, *topics):
        stamp = at(k * 20 + 5)
        return spark.createDataFrame([(t, (k - 2) * slide, float(k), float(k), (stamp, float(k) + len(t))) for t in topics], kind)

    target = live.LiveTargets(str(tmp_path / "live"), *OUT, "AVG", live.unified("AVG"))
    target(closed(10, "a", "bb"), 3)
    target(closed(12, "a"), 4)
    once = by_target(target.results(spark))
    target(closed(12, "a"), 4)
    assert by_target(target.results(spark)) == once
    # 11 had no rows at all, 12 only one topic: both topics' latest values stand
    assert [once[k][1:3] for k in sorted(once)] == [(2, True)] * 3
    target(closed(13, "bb"), 5)
    assert {n for n in versions(spark, f"{target.folder}/known")} == {4, 5}
    target(spark.createDataFrame([], kind), 6)
    assert len(by_target(target.results(spark))) == 4


def test_gaps_between_targets_are_refused(feed):
    sub = live.sub_query_windows(feed.add([("a", 1, 1)]).stream(), SUB, "AVG", "5 seconds")
    with pytest.raises(ValueError):
        live.closing_targets(sub, SUB[0], "10 seconds", "20 seconds", "AVG")

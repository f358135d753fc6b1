"""Order-dependent operators: groups cut into blocks give what the plain window gives."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidepane.operators import accuracy, merge, trends, windows
from tidepane.operators.ordered import (
    first_n,
    group_sizes,
    neighbour_in,
    ordinal,
    running_in,
    to_blocks,
)
from tidepane.operators.ranks import quantiles


@pytest.fixture(scope="module")
def skewed(make_obs):
    """One hot topic, a few small ones, and a third of all rows at one instant with one value."""
    rng = random.Random(5)
    data = []
    for i in range(900):
        topic = "hot" if i % 10 < 8 else rng.choice(["a", "b", None])
        hot_instant = i % 3 == 0
        data.append((topic, 100 if hot_instant else rng.randrange(1000), 7 if hot_instant else rng.randrange(50)))
    return make_obs(data).repartition(7).cache()


SMALL = 40


def test_group_sizes(skewed):
    assert group_sizes(skewed, ["topic"]) == (720, 900)


def test_running_sums_have_equal_bits_however_windows_are_cut(make_obs):
    """Hundredths that no double holds exactly: sums of whole numbers don't depend on the blocks they pass."""
    rng = random.Random(8)
    obs = make_obs([("t", i % 700, rng.randrange(10**7) / 100) for i in range(3000)])
    got = [
        rows(windows.running_window_agg(obs, "10 minutes", "5 minutes", max_group_rows=n, scale=2), "subject", "w_start", "run_sum", "run_avg")
        for n in (None, 100)
    ]
    assert got[0] == got[1]


def test_blocks_of_a_partition_stay_small(skewed, monkeypatch):
    """Too few range partitions for the rows: they are cut by position, so the limit holds at any size."""
    from tidepane.operators import ordered

    monkeypatch.setattr(ordered, "MAX_RANGE_PARTITIONS", 1)
    blocks = to_blocks(skewed, ["topic"], ["ts", "subject"], 10)
    assert blocks.df.groupBy("topic", "_block").count().agg(F.max("count")).first()[0] <= 10
    got = ordinal(skewed, ["topic"], ["ts", "subject"], "n", 10)
    assert rows(got, "subject", "n") == rows(ordinal(skewed, ["topic"], ["ts", "subject"]), "subject", "n")


def test_small_groups_stay_whole(skewed):
    assert not to_blocks(skewed, ["topic"], ["ts", "subject"]).split


def test_hot_instants_are_cut_by_range(skewed):
    """A third of the rows share one instant: equal steps of time cannot split them."""
    blocks = to_blocks(skewed, ["topic"], ["ts", "subject"], SMALL)
    sizes = blocks.df.groupBy("topic", "_block").count()
    assert blocks.split and sizes.agg(F.max("count")).first()[0] <= 3 * SMALL
    assert sizes.filter("topic = 'hot'").count() >= 4


def test_hot_topics_are_cut_into_steps(skewed):
    """Arrival numbers are spread evenly, so steps are enough and nothing is shuffled for them."""
    blocks = to_blocks(skewed, ["topic"], ["arrival"], SMALL)
    sizes = blocks.df.groupBy("topic", "_block").count()
    assert blocks.split and sizes.agg(F.max("count")).first()[0] <= SMALL
    assert sizes.filter("topic = 'hot'").count() > 100
    assert sizes.filter("topic is null").count() >= 1
    plan = blocks.df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("order", [["ts", "subject"], ["arrival"], ["subject"]])
def test_ordinal(skewed, order):
    want = ordinal(skewed, ["topic"], order)
    got = ordinal(skewed, ["topic"], order, max_group_rows=SMALL)
    key = lambda df: sorted((r.subject, r.n) for r in df.collect())
    assert key(got) == key(want)
    assert got.count() == 900


@pytest.mark.parametrize("inclusive", [True, False])
def test_running(skewed, inclusive):
    aggs = {"s": ("sum", "value"), "hi": ("max", "value"), "lo": ("min", "value")}
    order = ["arrival"]
    want = running_in(to_blocks(skewed, ["topic"], order), aggs, inclusive)
    got = running_in(to_blocks(skewed, ["topic"], order, SMALL), aggs, inclusive)
    key = lambda df: sorted((r.subject, r.s, r.hi, r.lo) for r in df.collect())
    assert key(got) == key(want)


@pytest.mark.parametrize("step", [-1, 1])
@pytest.mark.parametrize("order", [["ts", "subject"], ["arrival"]])
def test_neighbour(skewed, step, order):
    want = neighbour_in(to_blocks(skewed, ["topic"], order), {"other": "subject"}, step)
    got = neighbour_in(to_blocks(skewed, ["topic"], order, SMALL), {"other": "subject"}, step)
    key = lambda df: sorted((r.subject, r.other or "") for r in df.collect())
    assert key(got) == key(want)


def test_first_n(skewed):
    got = first_n(skewed, ["topic"], [F.desc("ts"), F.desc("subject")], 20)
    every = sorted(
        ((r.topic or "", r.ts, r.subject) for r in skewed.collect()), reverse=True
    )
    for topic in ("hot", "a", "b", ""):
        want = [s for t, _, s in every if t == topic][:20]
        mine = got.filter(F.coalesce("topic", F.lit("")) == topic).orderBy("n").collect()
        assert [r.subject for r in mine] == want
        assert [r.n for r in mine] == list(range(1, len(want) + 1))


def test_first_n_takes_any_number(skewed):
    """Beyond the number up to which Spark cuts groups in its map tasks, too."""
    got = first_n(skewed, ["topic"], ["ts", "subject"], 5000, "n")
    assert rows(got, "subject", "n") == rows(ordinal(skewed, ["topic"], ["ts", "subject"]), "subject", "n")


def test_quantiles(skewed):
    got = quantiles(skewed, ["topic"], "value", {"m": 0.5, "q1": 0.25})
    values = {}
    for r in skewed.collect():
        values.setdefault(r.topic, []).append(r.value)
    for r in got.collect():
        mine = values[r.topic]
        assert r.m == pytest.approx(statistics.median(mine))
        assert r.q1 == pytest.approx(statistics.quantiles(mine, n=4, method="inclusive")[0])


def test_floor_rank(skewed):
    got = accuracy.floor_rank_percentiles(skewed, ["topic"]).collect()
    for r in got:
        mine = sorted(x.value for x in skewed.collect() if x.topic == r.topic)
        assert r.p95 == mine[int(len(mine) * 0.95)]
        assert r.median == mine[len(mine) // 2]
        assert r.samples == len(mine)


def test_rolling_stats_cut_into_chunks(skewed):
    def key(df):
        return sorted(
            (r.subject, *(None if x is None else round(x, 9) for x in (r.rolling_mean, r.rolling_std)))
            for r in df.collect()
        )

    args = (["topic"], ["ts", "subject"])
    want = trends.rolling_stats(skewed, *args, mean_rows=5, std_rows=9)
    got = trends.rolling_stats(skewed, *args, mean_rows=5, std_rows=9, max_group_rows=30)
    assert key(got) == key(want)


@pytest.mark.parametrize(
    "operator",
    [
        lambda df, n: windows.classify_lateness(df, "5 seconds", max_group_rows=n).select("subject", "lateness"),
        lambda df, n: windows.watermark_progress(df, max_group_rows=n).select("subject", "watermark"),
        lambda df, n: windows.running_window_agg(df, "100 seconds", "50 seconds", max_group_rows=n).select(
            "subject", "w_start", "run_count", "run_max"
        ),
        lambda df, n: trends.trend_slope(df, ["topic"], ["ts", "subject"], max_group_rows=n).select(
            "topic", F.round("slope", 9)
        ),
        lambda df, n: merge.flag_gaps(
            merge.adaptive_timeout(df, tie=["subject"], max_group_rows=n), tie=["subject"], max_group_rows=n
        ).select("subject", "n", "gap"),
        lambda df, n: trends.change_profile(
            df, ["topic"], ["ts", "subject"], max_group_rows=n
        ).select("topic", "start_value", "end_value", "value_50pct", "change_first_100"),
        lambda df, n: merge.asof_latest(df, "100 seconds", "50 seconds", max_group_rows=n),
    ],
)
def test_operators_agree_on_split_groups(skewed, operator):
    def key(df):
        return sorted(map(repr, df.collect()))

    known = skewed.filter("topic is not null")
    assert key(operator(known, 10)) == key(operator(known, None))


def test_align_by_ordinal(make_obs):
    a = make_obs([("t", 1, 10), ("t", 2, 20), ("t", 3, 30), ("u", 1, 1)])
    b = make_obs([("t", 5, 11), ("t", 9, 19)])
    got = accuracy.align_by_ordinal(a, b, ["topic"], ["ts"], ["ts"])
    assert rows(got, "topic", "ord", "truth", "approx") == [("t", 1, 10.0, 11.0), ("t", 2, 20.0, 19.0)]

"""Values at exact ranks against sorting."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepane.operators import ranks

RANKS = {"first": lambda n: F.lit(0), "middle": lambda n: F.floor(n / 2), "last": lambda n: n - 1, "none": lambda n: n}


def key(x):
    return (math.isnan(x), 0.0 if math.isnan(x) else x)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", usual)


def check(spark, groups):
    data = [(g, v) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(data, "g string, v double").repartition(3)
    got = {r.g: (r.n, r.least, r.first, r.middle, r.last, r.none) for r in ranks.values_at(df, ["g"], "v", RANKS).collect()}
    want = {}
    for g, values in groups.items():
        if s := sorted((v for v in values if v is not None), key=key):
            want[g] = (len(s), s[0], s[0], s[len(s) // 2], s[-1], None)
    assert repr(sorted(got.items(), key=repr)) == repr(sorted(want.items(), key=repr))


def test_values_of_every_kind(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BINS", 512)
    r = random.Random(6)
    check(spark, {
        "sizes": [s * 10.0**e for e in range(-300, 301, 20) for s in (-1, 1, 3)],
        "near": [1e15 + i for i in range(300)] + [1e15 + 7] * 500,
        "ends": [float("inf"), float("-inf"), float("nan"), 1.0, 2.0, 5e-324, 1.7e308, -1.7e308, 0.0],
        "one": [4.25] * 1000,
        "cents": [r.randrange(50_000) / 100 for _ in range(5000)],
        "skewed": [r.random() ** 30 for _ in range(3000)] + [None, None],
        "nothing": [None],
    })


@given(st.lists(st.one_of(st.floats(), st.integers(-3, 3).map(float)), min_size=1, max_size=40))
@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_any_doubles(spark, values):
    check(spark, {"a": [v + 0.0 if v == 0 else v for v in values]})


def test_no_values_are_saved_or_sorted(spark, monkeypatch):
    """What is checkpointed between passes has a row for each group or wanted rank."""
    saved = []
    usual = ranks.cut_lineage
    monkeypatch.setattr(ranks, "cut_lineage", lambda df: saved.append(usual(df)) or saved[-1])
    df = spark.range(200_000).select((F.col("id") % 3).alias("g"), F.sin(F.col("id").cast("double")).alias("v"))
    out = ranks.quantiles(df, ["g"], "v", {"q1": 0.25, "median": 0.5})
    assert out.count() == 3
    assert len(saved) <= 6 and all(s.count() <= 12 for s in saved)

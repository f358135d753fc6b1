"""Profiling, query texts, accuracy measures and reshaping on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import at, rows, seconds
from tidepane.functions import grades, querytext
from tidepane.operators import accuracy, profile, reshape, trends


def test_buffer_stats(make_obs):
    obs = make_obs([("temp", 1, 10), ("temp", 2, 20), ("temp", 4, 30)])
    row = profile.buffer_stats(profile.last_n(obs)).first()
    assert (row.buffer_size, row.mean, row.mean_interval_ms) == (3, 20.0, 1500.0)
    assert row.rate_hz == pytest.approx(1000 / 1500)
    assert row.variance == pytest.approx(200 / 3)
    assert row.duration_ms == 3000.0


def test_one_point_has_no_rate(make_obs):
    row = profile.buffer_stats(make_obs([("t", 1, 10)])).first()
    assert (row.rate_hz, row.mean_interval_ms) == (0.0, 0.0)


def test_buffer_limit(make_obs):
    obs = make_obs([("t", i, i) for i in range(30)] + [("u", 100, 1)])
    assert rows(profile.last_n(obs, 3), "topic", "value") == [("t", 27.0), ("t", 28.0), ("t", 29.0), ("u", 1.0)]
    assert rows(profile.last_n(obs, 2, by=None), "topic", "value") == [("t", 29.0), ("u", 1.0)]
    # More than a map-side limit can bound.
    assert profile.last_n(obs, 5000).count() == 31
    assert profile.last_n(obs, 5000, by=None).count() == 31


def test_any_number_of_first_rows(make_obs):
    obs = make_obs([("t", i, i) for i in range(6000)])
    head = accuracy.head_mean_truth(obs, "topic", ["ts", "subject"], n=5000).first()
    assert head.truth == pytest.approx(sum(range(5000)) / 5000)


def test_signature_needs_five_points(make_obs):
    obs = make_obs([("t", i, i) for i in range(4)] + [("c", i, 5) for i in range(6)])
    got = profile.stream_signature(profile.last_n(obs)).collect()
    assert [r.topic for r in got] == ["c"]
    constant = got[0]
    assert (constant.triple_count, constant.variance, constant.entropy) == (12, 0.0, 0.0)
    assert (constant.skewness, constant.fft_entropy) == (0.0, 0.0)


def test_pure_wave_has_one_frequency(make_obs):
    obs = make_obs([("t", i, math.sin(2 * math.pi * i / 8)) for i in range(64)])
    row = profile.stream_signature(profile.last_n(obs)).first()
    assert row.fft_entropy == pytest.approx(0.0, abs=1e-6)


def _signature(spark, **values):
    base = {"topic": "t", "triple_count": 10, "variance": 20.0, "entropy": 2.5, "skewness": 0.0, "fft_entropy": 3.0}
    base.update(values)
    return spark.createDataFrame(
        [tuple(base.values())],
        "topic STRING, triple_count BIGINT, variance DOUBLE, entropy DOUBLE, skewness DOUBLE, fft_entropy DOUBLE",
    )


@pytest.mark.parametrize(
    "values,kind",
    [
        ({"variance": 5.0, "entropy": 1.0}, "stable"),
        ({"variance": 60.0, "entropy": 1.0}, "volatile"),
        ({"skewness": -1.5}, "irregular"),
        ({}, "periodic"),
        ({"fft_entropy": 1.0}, "mixed"),
    ],
)
def test_stream_types(spark, values, kind):
    assert profile.classify_stream(_signature(spark, **values)).first().stream_type == kind


def test_recommendation_by_priority(spark):
    both = _signature(spark, variance=5.0, entropy=1.0, fft_entropy=1.0, triple_count=200)
    row = profile.reasoning(profile.recommend(both)).first()
    assert (row.recommended, row.confidence) == (profile.APPROXIMATION, 1.0)
    assert row.matching == [profile.APPROXIMATION, profile.CHUNKED]
    assert row.scores.asDict() == {"approximation": 100, "fetching": 0, "chunked": 0}
    assert [(r.reason, r.field, r.value, r.bound) for r in row.reasons] == [
        ("steady_values", "variance", 5.0, None), ("repeating_values", "entropy", 1.0, 2.0), ("several_match", "matching", 2.0, 1.0)
    ]
    said = profile.reasoning(profile.recommend(both)).select(profile.explained().alias("s")).first().s
    assert len(said) == 3 and said[1].endswith("(entropy 1.00, bound 2.00)")
    partial = profile.recommend(_signature(spark, variance=40.0, entropy=3.5, fft_entropy=9.0)).first()
    assert (partial.recommended, partial.confidence) == (profile.FETCHING, 0.5)


def test_a_missing_field_meets_no_bound(spark):
    """Both bounds of the chunked rule hold; the rule that reads the missing field must not win."""
    row = profile.recommend(_signature(spark, variance=5.0, triple_count=200, fft_entropy=None)).first()
    assert (row.recommended, row.confidence, row.matching) == (profile.CHUNKED, 1.0, [profile.CHUNKED])


def test_rules_can_be_added_and_removed(spark):
    rule = profile.ApproachRule("custom", 0, at_least={"variance": 1})
    rules = profile.add_rule(profile.DEFAULT_RULES, rule)
    assert profile.rule_names(rules)[-1] == "custom"
    assert profile.recommend(_signature(spark), rules).first().recommended == "custom"
    assert "custom" not in profile.rule_names(profile.remove_rule(rules, "custom"))


def test_final_choice(spark):
    sure = profile.recommend(_signature(spark, variance=5.0, entropy=1.0, fft_entropy=1.0))
    pick = lambda df, mode, manual=None: profile.choose_approach(df, mode, manual=manual).first().chosen
    assert pick(sure, "automatic") == profile.APPROXIMATION
    assert pick(sure, "manual", profile.CHUNKED) == profile.CHUNKED
    assert pick(sure, "manual") == profile.FETCHING
    unsure = sure.withColumn("confidence", F.lit(0.65))
    assert pick(unsure, "automatic") == profile.APPROXIMATION
    assert pick(unsure, "hybrid", profile.CHUNKED) == profile.CHUNKED
    assert pick(unsure, "off") == profile.FETCHING


def test_registry_keeps_the_last_complete_registration(spark):
    data = [("a", "q1", "r", "d", 1), ("a", "q2", "r", "d", 2), ("a", None, "r", "d", 3), ("b", "q", "", "d", 4)]
    events = spark.createDataFrame(data, "id STRING, rspql_query STRING, r2s_topic STRING, data_topic STRING, seq BIGINT")
    assert rows(profile.registry(events), "id", "rspql_query") == [("a", "q2")]


QUERY = """PREFIX saref: <https://saref.etsi.org/core/>
REGISTER RStream <output> AS
SELECT (AVG(?v) AS ?avg)
FROM NAMED WINDOW <w1> ON STREAM <urn:a> [RANGE 60000 STEP 30000]
FROM NAMED WINDOW <w2> ON STREAM <urn:b> [RANGE 10 STEP 2]
WHERE { { WINDOW <w1> { ?s saref:hasValue ?v . } } UNION { WINDOW <w2> { ?s saref:hasValue ?v . } } FILTER(?v > 1) }"""


def test_query_features(spark):
    df = spark.createDataFrame([(QUERY,), ("SELECT ?v WHERE { ?s ?p ?v }",)], "query STRING")
    first, second = querytext.query_features(df).collect()
    assert (first.agg, first.contained_agg, first.output_operator, first.output_name) == ("AVG", "AVG", "RStream", "output")
    assert [tuple(w) for w in first.windows] == [("w1", "urn:a", 60000, 30000), ("w2", "urn:b", 10, 2)]
    assert "SELECT ?v\n" in first.bare_query
    assert first.complexity == 10
    assert (second.agg, second.contained_agg, second.complexity, second.windows) == ("AVG", None, 1, [])


def test_query_features_in_other_notation(spark):
    """Keywords in any case, line breaks between words, ISO sizes, prefixed names, a window without a step."""
    text = """register istream ex:out as select ?s ( count ( distinct $v )
      as ?n ) from
      named window ex:w1 on stream ex:a[range PT1M30S step pt0.5s] from named window <w2> on stream <b> [ RANGE 10 ]
      where { ?s ?p $v }"""
    row = querytext.query_features(spark.createDataFrame([(text,)], "query STRING")).first()
    assert (row.agg, row.output_operator, row.output_name) == ("COUNT", "IStream", "ex:out")
    assert [tuple(w) for w in row.windows] == [("ex:w1", "ex:a", 90000, 500), ("w2", "b", 10, 10)]
    assert "select ?s $v from" in " ".join(row.bare_query.split())
    odd = spark.createDataFrame([("",), ("REGISTER",), ("FROM NAMED WINDOW w",), ("no query",), (None,)], "query STRING")
    for r in querytext.query_features(odd).collect():
        assert not r.windows and r.output_operator is None and r.output_name is None


def test_query_hash_ignores_white_space(spark):
    df = spark.createDataFrame([(QUERY,), (QUERY.replace("\n", "   \n"),), (QUERY + "x",)], "query STRING")
    a, b, c = (r.h for r in df.select(querytext.query_hash("query").alias("h")).collect())
    assert a == b != c


@pytest.fixture(scope="module")
def pairs(spark):
    data = [("p", 1, 10.0, 11.0), ("p", 2, 0.0, 5.0), ("p", 3, -20.0, -15.0)]
    return spark.createDataFrame(data, "pattern STRING, ord BIGINT, truth DOUBLE, approx DOUBLE")


def test_zero_truths(pairs):
    row = pairs.agg(
        grades.mape("truth", "approx").alias("skip"),
        grades.mape("truth", "approx", "count").alias("count"),
        grades.mae("truth", "approx").alias("mae"),
    ).first()
    assert row.skip == pytest.approx((10 + 25) / 2)
    assert row["count"] == pytest.approx((10 + 25) / 3)
    assert row.mae == pytest.approx(11 / 3)
    metrics = accuracy.accuracy_metrics(pairs, ["pattern"]).first()
    assert (metrics.data_points, metrics.truth_count, metrics.mae) == (2, 3, 3.0)


def test_all_zero_truths_give_null(spark):
    df = spark.createDataFrame([(0.0, 1.0)], "truth DOUBLE, approx DOUBLE")
    row = df.agg(grades.mape("truth", "approx").alias("m"), grades.pearson("truth", "approx").alias("r")).first()
    assert (row.m, row.r) == (None, None)


def test_pair_accuracy(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (10.0, 9.0), (1.0, 9.0)], "t DOUBLE, a DOUBLE")
    assert [r.x for r in df.select(grades.pair_accuracy("t", "a").alias("x")).collect()] == [100.0, 0.0, 90.0, 0.0]


def test_head_and_tail(make_obs):
    obs = make_obs([("long", i, i) for i in range(30)] + [("short", i, i) for i in range(9)])
    got = {r.topic: r for r in trends.head_tail_trend(obs, ["topic"], ["ts", "subject"]).collect()}
    assert (got["long"].start_avg, got["long"].end_avg, got["long"].trend) == (1.0, 28.0, "Increasing")
    assert (got["short"].start_avg, got["short"].trend) == (None, None)


def test_trend_labels(make_obs):
    obs = make_obs([("up", i, 2 * i) for i in range(5)] + [("flat", i, 1) for i in range(5)] + [("one", 0, 1)])
    got = {r.topic: r.trend for r in trends.trend_slope(obs, ["topic"], ["ts", "subject"]).collect()}
    assert got == {"up": "Strong positive trend", "flat": "Stable", "one": "Insufficient data"}


def test_histogram_of_a_constant_series(make_obs):
    got = trends.histogram(make_obs([("t", i, 5) for i in range(4)]), ["topic"], bins=10)
    assert got.count() == 10
    assert got.agg(F.sum("count")).first()[0] == 4
    width = 0.1
    assert got.agg(F.sum(F.col("density") * width)).first()[0] == pytest.approx(1.0)


def test_best_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 0.0)], "name STRING, accuracy DOUBLE")
    got = accuracy.best_worst(df, "accuracy", ["name"])
    assert rows(got, "place", "name") == [("best", "a"), ("worst", "c")]


def test_reported_series_of_the_evaluation(spark):
    """One truth against thirty results: the percentage error of their mean."""
    df = spark.createDataFrame([(10.67777778, 10.7710)], "truth DOUBLE, approx DOUBLE")
    assert df.agg(grades.mape("truth", "approx")).first()[0] == pytest.approx(0.8731, abs=1e-3)


def test_rescale(make_obs):
    obs = make_obs([("t", 0, 10), ("t", 1, 20), ("c", 0, 3), ("c", 1, 3)])
    got = reshape.rescale(obs, 0.0, 100.0)
    assert rows(got, "topic", "value") == [("c", 50.0), ("c", 50.0), ("t", 0.0), ("t", 100.0)]


def test_retime(make_obs):
    got = reshape.retime(make_obs([("t", 50, 2), ("t", 10, 1)]), at(0), 4)
    assert sorted((r.value, seconds(r.ts)) for r in got.collect()) == [(1.0, 0.0), (2.0, 0.25)]


def test_prefixes(make_obs):
    got = reshape.prefixes(make_obs([("t", i, i) for i in range(7)]), sizes=[3, 5, 10])
    assert rows(got.groupBy("prefix").count(), "prefix", "count") == [(3, 3), (5, 5)]


def test_noise_does_not_depend_on_partitioning(make_obs):
    obs = make_obs([("t", i, 0) for i in range(4000)])
    one = reshape.add_noise(obs.repartition(1), 2.0, seed=3)
    many = reshape.add_noise(obs.repartition(9), 2.0, seed=3)
    assert rows(one, "subject", "value") == rows(many, "subject", "value")
    stats = one.agg(F.avg("value"), F.stddev_pop("value")).first()
    assert abs(stats[0]) < 0.15 and abs(stats[1] - 2.0) < 0.1
    assert rows(reshape.add_noise(obs, 2.0, seed=4), "subject", "value") != rows(one, "subject", "value")

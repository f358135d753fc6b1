"""Triples, messages, logs, patterns and rules on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import at, rows
from tidepane.functions.messages import HAS_VALUE, parse_result_value, result_triple
from tidepane.functions.scalars import ext_pow, ext_sqrt
from tidepane.operators import patterns, rules
from tidepane.sources import logs
from tidepane.sources import triples as nt


def test_several_statements_per_line(spark, tmp_path):
    text = (
        '<urn:s> <urn:p> <urn:o> . <urn:s> <urn:v> "a \\"quoted\\" . dot"^^<urn:t> .\n'
        '_:b1 <urn:p> "plain" . <urn:s> <urn:p> "hallo"@de <urn:g> .\n'
        "# a comment\n\n"
    )
    (tmp_path / "data.nt").write_text(text)
    got = rows(nt.read_nt(spark, str(tmp_path)), "s", "p", "o", "o_type")
    assert got == sorted(
        [
            ("urn:s", "urn:p", "urn:o", "iri"),
            ("urn:s", "urn:v", 'a "quoted" . dot', "urn:t"),
            ("_:b1", "urn:p", "plain", nt.XSD_STRING),
            ("urn:s", "urn:p", "hallo", nt.XSD_STRING),
        ]
    )
    assert nt.read_nt(spark, str(tmp_path)).filter("g = 'urn:g'").count() == 1


def _full_obs(spark):
    data = [("obs1", "d", "dev", "M", "temp", at(1.25), -2.5, "t"), ("obs2", "d", "dev", "M", "temp", at(2), 3.0, "t")]
    return spark.createDataFrame(
        data,
        "subject STRING, dataset STRING, device STRING, obs_type STRING, property STRING, ts TIMESTAMP_NTZ, "
        "value DOUBLE, topic STRING",
    )


def test_observations_survive_the_trip_through_text(spark, tmp_path):
    obs = _full_obs(spark)
    nt.to_lines(obs).write.text(str(tmp_path / "lines"))
    back = nt.to_observations(nt.read_nt(spark, str(tmp_path / "lines")), topic="t")
    assert sorted(back.collect()) == sorted(obs.collect())
    assert spark.read.text(str(tmp_path / "lines")).count() == 2
    nt.write_nt(nt.to_triples(obs), str(tmp_path / "statements"))
    assert spark.read.text(str(tmp_path / "statements")).count() == 12
    back = nt.to_observations(nt.read_nt(spark, str(tmp_path / "statements")), topic="t")
    assert sorted(back.collect()) == sorted(obs.collect())


@pytest.mark.parametrize(
    "text,value",
    [
        ("10.5", 10.5),
        ("-3", -3.0),
        (" 7 ms", 7.0),
        ("1e3", 1000.0),
        ("abc", None),
        ("", None),
        ('<urn:r> saref:hasValue> "12.5"^^<x>', 12.5),
        (f'<urn:r> <{HAS_VALUE}> "-4"^^<x> .', -4.0),
        (f'"<urn:r> <{HAS_VALUE}> \\"8.25\\"^^<x> ."', 8.25),
        (f'<urn:r> <{HAS_VALUE}> "none"^^<x> .', None),
    ],
)
def test_result_values(spark, text, value):
    df = spark.createDataFrame([(text,)], "m STRING")
    assert df.select(parse_result_value("m").alias("v")).first().v == value


def test_result_triple_is_repeatable(spark):
    df = spark.createDataFrame([("t", 1.5)], "topic STRING, value DOUBLE")
    event = result_triple("value", ["topic"])
    first, second = (df.select(event.alias("e")).first().e for _ in range(2))
    assert first == second
    assert df.select(parse_result_value(event).alias("v")).first().v == 1.5


def test_ragged_log_lines_are_dropped(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text('timestamp,message\n1,"a, b"\n2,c,d\n3\n4,e\n')
    log = logs.read_log_csv(spark, str(path))
    assert rows(log, "timestamp", "message") == [(1, "a, b"), (4, "e")]
    # One column is enough to notice a ragged row.
    assert log.select("timestamp").count() == 2


def test_resource_log(spark, tmp_path):
    path = tmp_path / "res.csv"
    header = "timestamp,cpu_user,cpu_system,rss,heapTotal,heapUsed,heapUsedMB,external\n"
    path.write_text(header + "1,0.5,0.1,10,20,30,0.25,4\n2,0.5,0.1\n")
    assert logs.read_resource_csv(spark, str(path)).count() == 1


def test_results_keep_their_sign_and_fall_back_per_run(spark):
    data = [
        ("a", 1, 'Final aggregation results: {\\"unifiedResult\\":-1.5}'),
        ("a", 2, "Successfully published unified cross-sensor avg: 9"),
        ("b", 1, "Successfully published unified cross-sensor avg: -2.5 (from 2 topics)"),
        ("b", 2, "Successfully published result: 4"),
        ("c", 1, 'Final aggregation results: {"unifiedAverage":3e2}'),
    ]
    log = spark.createDataFrame(data, "run STRING, pos INT, message STRING")
    got = logs.extract_results(log, "approximation")
    assert rows(got, "run", "pos", "result") == [("a", 1, -1.5), ("b", 1, -2.5), ("c", 1, 300.0)]
    assert rows(logs.extract_results(log, "exact"), "run", "result") == [("b", 4.0)]


def test_pattern_join(spark):
    data = [("s1", "v", "1"), ("s1", "p", "x"), ("s2", "v", "2"), ("s2", "p", "y"), ("s3", "v", "3"), ("s1", "v", "5")]
    triples = spark.createDataFrame(data, "s STRING, p STRING, o STRING")
    got = patterns.bgp(triples, [("?s", "v", "?value"), ("?s", "p", "x")])
    assert rows(got, "s", "value") == [("s1", "1"), ("s1", "5")]
    with pytest.raises(ValueError):
        patterns.bgp(triples, [("?a", "v", "?b"), ("?c", "p", "?d")])


def test_empty_aggregates(spark):
    empty = spark.createDataFrame([], "o STRING")
    result = lambda agg: patterns.simple_agg(empty, agg).first().result
    assert [result(a) for a in ("SUM", "AVG", "COUNT", "MIN", "MAX")] == [0.0, 0.0, 0.0, None, None]
    with pytest.raises(ValueError):
        patterns.simple_agg(empty, "MEDIAN")


def test_duplicate_triples_count_once(spark):
    df = spark.createDataFrame([("s", "p", "1", "g")] * 3 + [("s", "p", "1", "h")], "s STRING, p STRING, o STRING, g STRING")
    assert patterns.dedupe_triples(df).count() == 2


def test_extension_functions(spark):
    df = spark.createDataFrame([("9", "0.5"), ("text", "2")], "x STRING, y STRING")
    got = df.select(ext_sqrt("x").alias("r"), ext_pow("x", "y").alias("p")).collect()
    assert [tuple(r) for r in got] == [(3.0, 3.0), (None, None)]


def test_rules(spark):
    triples = spark.createDataFrame(
        [("s1", "hasValue", "10"), ("s2", "hasValue", "5"), ("s3", "hasValue", "x")], "s STRING, p STRING, o STRING"
    )
    assert rows(rules.derive_threshold(triples, "hasValue", ">=", 6, ("is", "standing")), "s", "p", "o") == [
        ("s1", "is", "standing")
    ]
    assert ("s1", "10", "hasValue") in rows(rules.derive_rewrite(triples, ("s", "o", "p")), "s", "p", "o")


def test_fixpoint(spark):
    chain = spark.createDataFrame([(f"n{i}", "next", f"n{i + 1}") for i in range(8)], "s STRING, p STRING, o STRING")

    def transitive(known):
        steps = patterns.bgp(known, [("?a", "next", "?b"), ("?b", "next", "?c")])
        return steps.select(F.col("a").alias("s"), F.lit("next").alias("p"), F.col("c").alias("o"))

    derived = rules.derive_fixpoint(chain, [transitive])
    assert derived.count() == 9 * 8 // 2 - 8
    with pytest.raises(RuntimeError):
        rules.derive_fixpoint(chain, [transitive], max_iter=1)


def test_fixpoint_of_many_rounds(spark):
    """One step a round: thirty rounds from the newest triples alone, the same as from all known ones."""
    chain = spark.createDataFrame([("n0", "at", "0"), *[(str(i), "then", str(i + 1)) for i in range(30)]], "s STRING, p STRING, o STRING")

    def walk(fresh, known):
        at, then = patterns.match(fresh, p="at"), patterns.match(known, p="then")
        step = at.select("s", F.col("o").alias("k")).join(then.select(F.col("s").alias("k"), "o"), "k")
        return step.select("s", F.lit("at").alias("p"), "o")

    derived = rules.derive_fixpoint(chain, joins=[walk])
    assert sorted(int(r.o) for r in derived.collect()) == list(range(1, 31))


def test_static_facts(spark):
    stream = spark.createDataFrame([("a", 1), ("b", 2)], "topic STRING, v INT")
    static = spark.createDataFrame([("a", "room 1")], "topic STRING, place STRING")
    assert rows(patterns.with_static(stream, static, ["topic"]), "topic", "place") == [("a", "room 1")]

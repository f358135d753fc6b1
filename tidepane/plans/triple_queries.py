"""Registered queries for sources, triple patterns and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepane.functions.messages import HAS_VALUE, parse_result_value, result_triple
from tidepane.functions.scalars import ext_pow, ext_sqrt
from tidepane.operators import patterns, rules
from tidepane.operators.windows import assign_windows
from tidepane.plans.catalog import query
from tidepane.plans.inputs import (
    HOUR,
    MINUTE,
    OBS,
    SCALE,
    SUB,
    observations,
    sql_assigned,
    sql_sub,
    sub_results,
    table,
    with_sql,
)
from tidepane.session import staging_path
from tidepane.sources import logs, triples as nt

_TRIPLES = f"""triples AS (
  SELECT subject AS s, unnest(['{nt.IN_DATASET}', '{nt.MADE_BY}', '{nt.VERSION_OF}',
                               '{nt.PROPERTY}', '{nt.TIMESTAMP}', '{HAS_VALUE}']) AS p,
         unnest([dataset, device, obs_type, property,
                 strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z', CAST(value AS VARCHAR)]) AS o,
         unnest(['iri', 'iri', 'iri', 'iri', '{nt.XSD_DATETIME}', '{nt.XSD_FLOAT}']) AS o_type,
         topic AS g
  FROM obs)"""


def _triples(spark, sf_dir):
    return nt.to_triples(observations(spark, sf_dir))


@query("a1_parse_triples", with_sql("SELECT s, p, o, o_type FROM triples", OBS, _TRIPLES))
def a1(spark, sf_dir):
    """Observations written as text, six statements per line, and read back as triples."""
    path = staging_path(spark, "nt")
    nt.to_lines(observations(spark, sf_dir)).write.text(path)
    return nt.read_nt(spark, path).select("s", "p", "o", "o_type")


@query(
    "a2_to_observations",
    with_sql(
        "SELECT subject, dataset, device, obs_type, property, ts, value, topic FROM obs", OBS
    ),
)
def a2(spark, sf_dir):
    return nt.to_observations(_triples(spark, sf_dir))


@query("a3_to_triples", with_sql("SELECT s, p, o, o_type, g FROM triples", OBS, _TRIPLES))
def a3(spark, sf_dir):
    return _triples(spark, sf_dir)


@query(
    "a4_parse_result_value",
    """SELECT event_id, CASE event_id % 5 WHEN 3 THEN NULL WHEN 4 THEN -value ELSE value END AS parsed
FROM events""",
)
def a4(spark, sf_dir):
    """Bare numbers, triples, quoted triples, texts without a number, numbers with a unit."""
    value = F.col("value").cast("string")
    triple = result_triple("value", ["event_id"])
    forms = [
        value,
        triple,
        F.concat(F.lit('"'), F.replace(triple, F.lit('"'), F.lit('\\"')), F.lit('"')),
        F.concat(F.lit("no value "), value),
        F.concat(F.lit(" -"), value, F.lit(" ms")),
    ]
    kind = F.pmod("event_id", F.lit(len(forms)))
    message = F.coalesce(*[F.when(kind == i, form) for i, form in enumerate(forms)])
    events = table(spark, sf_dir, "events").select("event_id", message.alias("message"))
    return events.select("event_id", parse_result_value("message").alias("parsed"))


@query(
    "a5_format_result_event",
    with_sql(
        """SELECT topic, w_start, '<urn:result:' || md5(topic || '|' || strftime(w_start, '%Y-%m-%d %H:%M:%S'))
  || '> <https://saref.etsi.org/core/hasValue> "' || CAST(value AS VARCHAR)
  || '"^^<http://www.w3.org/2001/XMLSchema#float> .' AS event FROM sub""",
        OBS, sql_sub("MAX"),
    ),
)
def a5(spark, sf_dir):
    results = sub_results(spark, sf_dir, "MAX")
    event = result_triple("value", ["topic", "w_start"])
    return results.select("topic", "w_start", event.alias("event"))


@query(
    "a7_read_log_csv",
    """SELECT event_id AS "timestamp", event_type || ' ' || CAST(value AS VARCHAR) AS message
FROM events WHERE event_id % 7 <> 0""",
)
def a7_log(spark, sf_dir):
    """Every seventh line has a field too many and is dropped by the reader."""
    path = staging_path(spark, "log")
    line = F.concat_ws(
        ",",
        F.col("event_id").cast("string"),
        F.concat_ws(" ", "event_type", F.col("value").cast("string")),
        F.when(F.pmod("event_id", F.lit(7)) == 0, F.lit("extra")),
    )
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return logs.read_log_csv(spark, path, header=False)


@query(
    "a7_read_resource_csv",
    """SELECT event_id * 100 AS "timestamp", value AS cpu_user, value / 2 AS cpu_system,
  user_id * 4096 AS rss, user_id * 2048 AS "heapTotal", user_id * 1024 AS "heapUsed",
  user_id / 1024.0::DOUBLE AS "heapUsedMB", event_id AS "external"
FROM events WHERE event_id % 7 <> 0""",
)
def a7_resource(spark, sf_dir):
    """Every seventh line is cut short and dropped by the reader."""
    path = staging_path(spark, "resource")
    fields = [
        F.col("event_id") * 100,
        F.col("value"),
        F.col("value") / 2,
        F.col("user_id") * 4096,
        F.col("user_id") * 2048,
        F.col("user_id") * 1024,
        F.col("user_id") / F.lit(1024.0),
        F.when(F.pmod("event_id", F.lit(7)) != 0, F.col("event_id")),
    ]
    line = F.concat_ws(",", *[f.cast("string") for f in fields])
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return logs.read_resource_csv(spark, path, header=False)


_LOG = """log AS (
  SELECT user_id AS run, event_id AS pos,
    CASE WHEN user_id % 3 = 0 OR event_id % 4 = 3
         THEN 'Successfully published unified cross-sensor avg: ' || CAST(-value AS VARCHAR)
         WHEN event_id % 4 = 0 THEN 'Final aggregation results: {\\"unifiedResult\\":' || CAST(value AS VARCHAR) || '}'
         WHEN event_id % 4 = 1 THEN 'Final aggregation results: {\\"unifiedAverage\\":' || CAST(value AS VARCHAR) || '}'
         ELSE 'Successfully published result: ' || CAST(-value AS VARCHAR) END AS message
  FROM events)"""


def _log(spark, sf_dir):
    """A log whose runs (users) divisible by three hold no final results."""
    kind = F.pmod("event_id", F.lit(4))
    plain, negative = F.col("value").cast("string"), (-F.col("value")).cast("string")
    final = 'Final aggregation results: {\\"%s\\":'
    message = (
        F.when(
            (F.pmod("user_id", F.lit(3)) == 0) | (kind == 3),
            F.concat(F.lit("Successfully published unified cross-sensor avg: "), negative),
        )
        .when(kind == 0, F.concat(F.lit(final % "unifiedResult"), plain, F.lit("}")))
        .when(kind == 1, F.concat(F.lit(final % "unifiedAverage"), plain, F.lit("}")))
        .otherwise(F.concat(F.lit("Successfully published result: "), negative))
    )
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("run"), F.col("event_id").alias("pos"), message.alias("message")
    )


@query(
    "a8_extract_approximation_results",
    with_sql(
        r"""SELECT run, pos, CASE WHEN has_final THEN final ELSE published END AS result FROM (
  SELECT *, max(final IS NOT NULL) OVER (PARTITION BY run) AS has_final FROM (
    SELECT run, pos,
      coalesce(TRY_CAST(nullif(regexp_extract(message, 'unifiedResult\\":(-?[0-9.]+)', 1), '') AS DOUBLE),
               TRY_CAST(nullif(regexp_extract(message, 'unifiedAverage\\":(-?[0-9.]+)', 1), '') AS DOUBLE)) AS final,
      TRY_CAST(nullif(regexp_extract(message, 'unified cross-sensor avg: (-?[0-9.]+)', 1), '') AS DOUBLE) AS published
    FROM log))
WHERE (CASE WHEN has_final THEN final ELSE published END) IS NOT NULL""",
        _LOG,
    ),
)
def a8_approximation(spark, sf_dir):
    return logs.extract_results(_log(spark, sf_dir), "approximation").select("run", "pos", "result")


@query(
    "a8_extract_exact_results",
    with_sql(
        r"""SELECT run, pos, TRY_CAST(regexp_extract(message, 'result: (-?[0-9.]+)', 1) AS DOUBLE) AS result
FROM log WHERE message LIKE 'Successfully published result:%'""",
        _LOG,
    ),
)
def a8_exact(spark, sf_dir):
    return logs.extract_results(_log(spark, sf_dir), "exact").select("run", "pos", "result")


# --- patterns --------------------------------------------------------------------------------


@query(
    "b1_match",
    with_sql(
        f"SELECT s, o FROM triples WHERE p = '{nt.PROPERTY}' AND o = 'view' AND g = 'view'", OBS, _TRIPLES
    ),
)
def b1(spark, sf_dir):
    return patterns.match(_triples(spark, sf_dir), p=nt.PROPERTY, o="view", g="view").select("s", "o")


@query(
    "b2_bgp_star_join",
    with_sql("SELECT subject AS s, CAST(value AS VARCHAR) AS v, device AS d, topic AS g FROM obs", OBS),
)
def b2(spark, sf_dir):
    """``?s hasValue ?v . ?s measurementMadeBy ?d`` in every graph."""
    return patterns.bgp(
        _triples(spark, sf_dir),
        [("?s", HAS_VALUE, "?v"), ("?s", nt.MADE_BY, "?d")],
        scope=["g"],
    )


@query(
    "b2_bgp_window_average",
    with_sql(
        """SELECT w_start, CAST(sum(cents) AS DOUBLE) / 100.0 / count(*) AS result
FROM assigned WHERE property = 'click' GROUP BY w_start""",
        OBS, sql_assigned(HOUR, 30 * MINUTE),
    ),
)
def b2_average(spark, sf_dir):
    """The usual query body over wide rows: the same pattern needs a filter and no join."""
    windowed = assign_windows(observations(spark, sf_dir), *SUB)
    clicks = windowed.filter(F.col("property") == "click")
    return patterns.group_agg(clicks, ["w_start"], "AVG", scale=SCALE)


@query("b3_scope", with_sql("SELECT s, p, o FROM triples WHERE g = 'purchase'", OBS, _TRIPLES))
def b3(spark, sf_dir):
    return patterns.scope(_triples(spark, sf_dir), "purchase").select("s", "p", "o")


@query(
    "b4_union_streams",
    """SELECT 'event' AS kind, ts, value FROM events
UNION ALL SELECT 'order', o_orderdate::TIMESTAMP, o_totalprice FROM orders""",
)
def b4(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), "ts", "value")
    orders = table(spark, sf_dir, "orders").select(
        F.lit("order").alias("kind"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value")
    )
    return patterns.union_streams(events, orders)


@query(
    "b5_with_static",
    """SELECT event_id, event_type, n_name, r_name FROM events
JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey""",
)
def b5(spark, sf_dir):
    """Stream rows get the home country of their user."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    homes = (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("user_id"), "n_name", "r_name")
    )
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return patterns.with_static(events, homes, ["user_id"]).select(
        "event_id", "event_type", "n_name", "r_name"
    )


@query(
    "b6_dedupe_triples",
    with_sql(
        """SELECT DISTINCT w_start, device AS s, property AS o FROM assigned""",
        OBS, sql_assigned(HOUR, 30 * MINUTE),
    ),
)
def b6(spark, sf_dir):
    """Set semantics per window over ``device relatesToProperty property``."""
    facts = assign_windows(observations(spark, sf_dir), *SUB).select(
        "w_start", F.col("device").alias("s"), F.col("property").alias("o")
    )
    return patterns.dedupe_triples(facts, ["w_start", "s", "o"])


@query(
    "b7_group_agg",
    with_sql("SELECT device, topic, CAST(sum(cents) AS DOUBLE) / 100.0 AS result FROM obs GROUP BY ALL", OBS),
)
def b7(spark, sf_dir):
    return patterns.group_agg(observations(spark, sf_dir), ["device", "topic"], "SUM", scale=SCALE)


@query(
    "b8_simple_agg",
    with_sql(
        """SELECT 'AVG' AS agg, CAST(sum(cents) AS DOUBLE) / 100.0 / count(*) AS result FROM obs
UNION ALL SELECT 'SUM', CAST(sum(cents) AS DOUBLE) / 100.0 FROM obs
UNION ALL SELECT 'COUNT', CAST(count(*) AS DOUBLE) FROM obs
UNION ALL SELECT 'MIN', min(value) FROM obs UNION ALL SELECT 'MAX', max(value) FROM obs""",
        OBS,
    ),
)
def b8(spark, sf_dir):
    values = patterns.match(_triples(spark, sf_dir), p=HAS_VALUE)
    kinds = ("AVG", "SUM", "COUNT", "MIN", "MAX")
    row = patterns.simple_aggs(values, kinds, scale=SCALE)
    pairs = [x for kind in kinds for x in (F.lit(kind), F.col(kind))]
    return row.select(F.stack(F.lit(len(kinds)), *pairs).alias("agg", "result"))


@query(
    "b9_extension_functions",
    with_sql(
        f"""SELECT s, p, round(sqrt(x), 9) AS root, round(pow(x, 2), 6) AS square
FROM (SELECT s, p, CASE WHEN p = '{HAS_VALUE}' THEN TRY_CAST(o AS DOUBLE) END AS x FROM triples)""",
        OBS, _TRIPLES,
    ),
)
def b9(spark, sf_dir):
    """Over all objects: terms that are no numbers give null."""
    return _triples(spark, sf_dir).select(
        "s",
        "p",
        F.round(ext_sqrt("o"), 9).alias("root"),
        F.round(ext_pow("o", F.lit(2)), 6).alias("square"),
    )


# --- rules -----------------------------------------------------------------------------------


@query(
    "i1_derive_threshold",
    with_sql("SELECT subject AS s, 'urn:state' AS p, 'urn:high' AS o FROM obs WHERE value >= 60", OBS),
)
def i1(spark, sf_dir):
    return rules.derive_threshold(
        _triples(spark, sf_dir), HAS_VALUE, ">=", 60, ("urn:state", "urn:high")
    )


@query("i2_derive_rewrite", with_sql("SELECT DISTINCT s, o AS p, p AS o FROM triples", OBS, _TRIPLES))
def i2(spark, sf_dir):
    return rules.derive_rewrite(_triples(spark, sf_dir), ("s", "o", "p"))


@query(
    "i3_derive_fixpoint",
    """WITH RECURSIVE facts AS (
  SELECT 'c' || c_custkey AS s, 'n' || c_nationkey AS o FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region),
closure AS (SELECT s, o FROM facts
            UNION SELECT c.s, f.o FROM closure c JOIN facts f ON c.o = f.s)
SELECT s, 'partOf' AS p, o FROM closure EXCEPT SELECT s, 'partOf', o FROM facts""",
)
def i3(spark, sf_dir):
    """``partOf`` is transitive: customers lie in nations, nations in regions, regions in the world."""
    def fact(df, s, o):
        return df.select(s.alias("s"), F.lit("partOf").alias("p"), o.alias("o"))

    def key(prefix, column):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    facts = patterns.union_streams(
        fact(table(spark, sf_dir, "customer"), key("c", "c_custkey"), key("n", "c_nationkey")),
        fact(table(spark, sf_dir, "nation"), key("n", "n_nationkey"), key("r", "n_regionkey")),
        fact(table(spark, sf_dir, "region"), key("r", "r_regionkey"), F.lit("world")),
    )

    def transitive(fresh, known):
        def link(df, s, o):
            return patterns.match(df, p="partOf").select(F.col("s").alias(s), F.col("o").alias(o))

        # a new link continues a known one, or is continued by one
        steps = patterns.union_streams(
            link(fresh, "a", "b").join(link(known, "b", "c"), "b"),
            link(known, "a", "b").join(link(fresh, "b", "c"), "b"),
        )
        return fact(steps, F.col("a"), F.col("c"))

    return rules.derive_fixpoint(facts, joins=[transitive])

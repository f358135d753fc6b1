"""Registered queries for stream profiling and query-log columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepane.functions import querytext
from tidepane.operators import profile
from tidepane.plans.catalog import query
from tidepane.plans.inputs import OBS, observations, table, with_sql

_BUFFER = """buffer AS (
  SELECT * FROM (SELECT topic, subject, ts, us, value,
                        row_number() OVER (PARTITION BY topic ORDER BY ts DESC, subject DESC) AS recency
                 FROM obs) WHERE recency <= 1000)"""


def _buffer(spark, sf_dir):
    obs = observations(spark, sf_dir).select("topic", "subject", "ts", "value")
    return profile.last_n(obs)


@query("f1_last_n", with_sql("SELECT topic, subject, ts, value, recency FROM buffer", OBS, _BUFFER))
def f1(spark, sf_dir):
    return _buffer(spark, sf_dir)


@query(
    "f1_last_n_global",
    """SELECT event_id, ts, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS recency
FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000""",
)
def f1_global(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return profile.last_n(events, by=None, tie=("event_id",))


@query(
    "f2_buffer_stats",
    with_sql(
        """SELECT topic, count(*) AS buffer_size, min(value) AS "min", max(value) AS "max",
  round(avg(value), 7) AS mean, round(var_pop(value), 6) AS variance,
  (max(us) - min(us)) / 1000.0::DOUBLE / (count(*) - 1) AS mean_interval_ms,
  min(ts) AS start_ts, max(ts) AS end_ts, (max(us) - min(us)) / 1000.0::DOUBLE AS duration_ms,
  1000.0::DOUBLE / ((max(us) - min(us)) / 1000.0::DOUBLE / (count(*) - 1)) AS rate_hz
FROM buffer GROUP BY topic""",
        OBS, _BUFFER,
    ),
)
def f2(spark, sf_dir):
    stats = profile.buffer_stats(_buffer(spark, sf_dir))
    return stats.withColumns({"mean": F.round("mean", 7), "variance": F.round("variance", 6)})


_SIGNATURE = """stats AS (
  SELECT topic, count(*) AS n, min(value) AS lo, max(value) AS hi, avg(value) AS mean,
         var_pop(value) AS variance FROM buffer GROUP BY topic HAVING count(*) >= 5),
binned AS (
  SELECT topic, n, least(CAST(floor((value - lo) / ((hi - lo) / 10)) AS BIGINT), 9) AS bin, count(*) AS c
  FROM buffer JOIN stats USING (topic) GROUP BY ALL),
entropies AS (
  SELECT topic, sum(-(c / n::DOUBLE) * log2(c / n::DOUBLE)) AS entropy FROM binned GROUP BY topic),
thirds AS (
  SELECT topic, avg(pow(value - mean, 3)) AS third FROM buffer JOIN stats USING (topic) GROUP BY topic),
power AS (
  SELECT topic, k, pow(sum(value * cos(2 * pi() * k * (n - recency) / n)), 2)
                 + pow(sum(value * sin(2 * pi() * k * (n - recency) / n)), 2) AS p
  FROM buffer JOIN stats USING (topic), range(1, 501) f(k) WHERE k <= n // 2 GROUP BY topic, k),
spectrum AS (
  SELECT topic, sum(-(p / total) * log2(p / total)) AS fft_entropy
  FROM (SELECT *, sum(p) OVER (PARTITION BY topic) AS total FROM power) GROUP BY topic),
signature AS (
  SELECT topic, n * 2 AS triple_count, variance, entropy, third / pow(variance, 1.5) AS skewness, fft_entropy
  FROM stats JOIN entropies USING (topic) JOIN thirds USING (topic) JOIN spectrum USING (topic))"""


def _signature(spark, sf_dir):
    return profile.stream_signature(_buffer(spark, sf_dir))


@query(
    "f3_stream_signature",
    with_sql(
        """SELECT topic, triple_count, round(variance, 6) AS variance, round(entropy, 9) AS entropy,
  round(skewness, 6) AS skewness, round(fft_entropy, 6) AS fft_entropy FROM signature""",
        OBS, _BUFFER, _SIGNATURE,
    ),
)
def f3(spark, sf_dir):
    return _signature(spark, sf_dir).select(
        "topic", "triple_count",
        F.round("variance", 6).alias("variance"), F.round("entropy", 9).alias("entropy"),
        F.round("skewness", 6).alias("skewness"), F.round("fft_entropy", 6).alias("fft_entropy"),
    )


# Signatures per device and topic are many and of every kind. They are rounded, so that a bound falls on the same
# side of a value in both engines.
_USER_SIGNATURE = (
    """buffer AS (
  SELECT device || '/' || topic AS topic, value, recency FROM (
    SELECT *, row_number() OVER (PARTITION BY device, topic ORDER BY ts DESC, subject DESC) AS recency FROM obs)
  WHERE recency <= 1000),
"""
    + _SIGNATURE
    + """,
sig AS (
  SELECT topic, triple_count, spread AS variance, round(entropy, 9) AS entropy, round(skewness, 6) AS skewness,
    round(fft_entropy, 6) AS fft_entropy
  FROM signature JOIN (
    SELECT topic, CAST(count(*) * sum(cents * cents) - sum(cents) * sum(cents) AS DOUBLE) / (count(*) * count(*)) / 10000.0::DOUBLE AS spread
    FROM (SELECT topic, CAST(round(value * 100) AS BIGINT) AS cents FROM buffer) GROUP BY topic) USING (topic))"""
)


def _user_signature(spark, sf_dir):
    obs = observations(spark, sf_dir).select(F.concat_ws("/", "device", "topic").alias("topic"), "subject", "ts", "value")
    buffer = profile.last_n(obs)
    signature = profile.stream_signature(buffer)
    # The variance in whole cents, so that both engines get the same bits; it is held against that of the signature.
    cents = F.round(F.col("value") * 100).cast("bigint")
    n, total = F.count("value"), F.sum(cents)
    spread = buffer.groupBy("topic").agg(
        ((n * F.sum(cents * cents) - total * total).cast("double") / (n * n) / F.lit(10000.0)).alias("spread")
    )
    variance = F.when(F.abs(F.col("variance") - F.col("spread")) < 1e-6, F.col("spread")).otherwise(F.col("variance"))
    return signature.join(spread, "topic").select(
        "topic", "triple_count", variance.alias("variance"),
        F.round("entropy", 9).alias("entropy"), F.round("skewness", 6).alias("skewness"),
        F.round("fft_entropy", 6).alias("fft_entropy"),
    )


@query(
    "f4_classify_stream",
    with_sql(
        """SELECT topic, CASE WHEN variance < 10 AND entropy < 2 THEN 'stable' WHEN variance > 50 THEN 'volatile'
    WHEN abs(skewness) > 1 THEN 'irregular' WHEN fft_entropy > 2 THEN 'periodic' ELSE 'mixed' END AS stream_type,
  least(CAST(ceil(entropy) AS BIGINT), 10) AS complexity,
  greatest(0.0, 1 - entropy / 5) AS predictability, variance / 100 AS volatility FROM sig""",
        OBS, _USER_SIGNATURE,
    ),
)
def f4(spark, sf_dir):
    out = profile.classify_stream(_user_signature(spark, sf_dir))
    return out.select("topic", "stream_type", "complexity", "predictability", "volatility")


_RECOMMENDED = """shares AS (
  SELECT *, ((variance <= 10)::INT + (entropy <= 2)::INT + (fft_entropy <= 1.5)::INT) / 3.0::DOUBLE AS a,
         ((variance >= 50)::INT + (entropy >= 3)::INT) / 2.0::DOUBLE AS f,
         ((triple_count >= 100)::INT + (variance <= 30)::INT) / 2.0::DOUBLE AS c FROM sig),
recommended AS (
  SELECT *, greatest(a, f, c) AS confidence,
    CASE WHEN greatest(a, f, c) = 0 THEN 'fetching-client-side' WHEN a >= greatest(f, c) THEN 'approximation-approach'
         WHEN f >= c THEN 'fetching-client-side' ELSE 'chunked-approach' END AS recommended FROM shares)"""


@query(
    "f5_recommend",
    with_sql(
        """SELECT topic, recommended, confidence, CASE WHEN recommended LIKE 'approx%' THEN 100 ELSE 0 END AS approximation,
  CASE WHEN recommended LIKE 'fetching%' THEN 100 ELSE 0 END AS fetching,
  CASE WHEN recommended LIKE 'chunked%' THEN 100 ELSE 0 END AS chunked,
  CAST((a = 1)::INT + (f = 1)::INT + (c = 1)::INT AS INTEGER) AS n_matching FROM recommended""",
        OBS, _USER_SIGNATURE, _RECOMMENDED,
    ),
)
def f5(spark, sf_dir):
    out = profile.recommend(_user_signature(spark, sf_dir))
    return out.select("topic", "recommended", "confidence", "scores.*", F.size("matching").alias("n_matching"))


@query(
    "f6_reasoning",
    with_sql(
        """SELECT topic, recommended, reason, field, CAST(figure AS DOUBLE) AS "value", bound FROM recommended, LATERAL (VALUES
  (recommended LIKE 'approx%', 'steady_values', 'variance', variance, NULL::DOUBLE),
  (recommended LIKE 'approx%' AND entropy < 2, 'repeating_values', 'entropy', entropy, 2),
  (recommended LIKE 'fetch%', 'wide_spread', 'variance', variance, NULL),
  (recommended LIKE 'fetch%' AND entropy > 3, 'irregular_values', 'entropy', entropy, 3),
  (recommended LIKE 'chunk%', 'many_triples', 'triple_count', triple_count, NULL),
  (recommended LIKE 'chunk%' AND variance < 30, 'bounded_spread', 'variance', variance, 30),
  ((a = 1)::INT + (f = 1)::INT + (c = 1)::INT > 1, 'several_match', 'matching', (a = 1)::INT + (f = 1)::INT + (c = 1)::INT, 1)
) r(holds, reason, field, figure, bound) WHERE holds""",
        OBS, _USER_SIGNATURE, _RECOMMENDED,
    ),
)
def f6(spark, sf_dir):
    """One row per reason of each recommendation."""
    told = profile.reasoning(profile.recommend(_user_signature(spark, sf_dir)))
    return told.select("topic", "recommended", F.explode("reasons").alias("_r")).select("topic", "recommended", "_r.*")


@query(
    "f7_choose_approach",
    with_sql(
        """SELECT topic, mode, CASE WHEN mode = 'manual' THEN 'chunked-approach'
    WHEN mode = 'automatic' AND confidence > 0.6 THEN recommended
    WHEN mode = 'hybrid' AND confidence > 0.7 THEN recommended
    WHEN mode = 'hybrid' THEN 'chunked-approach' ELSE 'fetching-client-side' END AS chosen
FROM recommended, (VALUES ('manual'), ('automatic'), ('hybrid'), ('off')) m(mode)""",
        OBS, _USER_SIGNATURE, _RECOMMENDED,
    ),
)
def f7(spark, sf_dir):
    modes = F.array(*[F.lit(m) for m in ("manual", "automatic", "hybrid", "off")])
    recommended = profile.recommend(_user_signature(spark, sf_dir)).withColumn("mode", F.explode(modes))
    chosen = profile.choose_approach(recommended, F.col("mode"), manual=profile.CHUNKED)
    return chosen.select("topic", "mode", "chosen")


@query(
    "f8_recommendation_summary",
    """WITH kept AS (
  SELECT * FROM (SELECT user_id, event_type AS recommended, value / 100 AS confidence,
                        row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age FROM events)
  WHERE age <= 10),
totals AS (SELECT user_id, count(*) AS history_length, round(avg(confidence) FILTER (age <= 5), 7) AS mean_confidence
           FROM kept GROUP BY user_id),
uses AS (SELECT user_id, recommended, count(*) AS uses FROM kept WHERE age <= 5 GROUP BY ALL)
SELECT user_id, recommended, uses, history_length, mean_confidence FROM uses JOIN totals USING (user_id)""",
)
def f8(spark, sf_dir):
    history = table(spark, sf_dir, "events").select(
        "user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("recommended"),
        (F.col("value") / 100).alias("confidence"),
    )
    out = profile.recommendation_summary(history, by=["user_id"])
    return out.withColumn("mean_confidence", F.round("mean_confidence", 7))


# --- query texts -----------------------------------------------------------------------------

_QUERY_LOG = r"""qlog AS (
  SELECT event_id AS id, event_id AS seq, 'REGISTER ' || CASE event_id % 3 WHEN 0 THEN 'RStream' WHEN 1 THEN 'IStream' ELSE 'DStream' END
    || ' <out' || user_id || '> AS' || chr(10) || 'SELECT (' || CASE event_id % 4 WHEN 0 THEN 'AVG' WHEN 1 THEN 'MAX' WHEN 2 THEN 'COUNT' ELSE 'SUM' END
    || '(?v) AS ?' || event_type || ')' || chr(10) || 'FROM NAMED WINDOW <w1> ON STREAM <' || event_type || '> [RANGE ' || (user_id + 1) * 1000 || ' STEP ' || (user_id % 7 + 1) * 500 || ']' || chr(10)
    || CASE WHEN event_id % 5 = 0 THEN 'FROM NAMED WINDOW <w2> ON STREAM <' || event_type || '_2> [RANGE 60000 STEP 30000]' || chr(10) ELSE '' END
    || 'WHERE { WINDOW <w1> { ?s ?p ?v . } ' || CASE WHEN event_id % 2 = 0 THEN 'FILTER(?v > ' || CAST(value AS VARCHAR) || ') ' ELSE '' END || '}' AS query
  FROM events)"""


def _query_log(spark, sf_dir):
    """One registered query text per event, with one or two windows."""
    number = F.col("event_id")

    def pick(modulus, *options):
        kind = F.pmod(number, F.lit(modulus))
        chosen = F.lit(options[-1])
        for i in range(len(options) - 2, -1, -1):
            chosen = F.when(kind == i, options[i]).otherwise(chosen)
        return chosen

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    user, topic = F.col("user_id"), F.col("event_type")
    second = text("FROM NAMED WINDOW <w2> ON STREAM <", topic, "_2> [RANGE 60000 STEP 30000]\n")
    condition = text("FILTER(?v > ", F.col("value"), ") ")
    return table(spark, sf_dir, "events").select(
        number.alias("id"),
        number.alias("seq"),
        text(
            "REGISTER ", pick(3, "RStream", "IStream", "DStream"), " <out", user, "> AS\nSELECT (",
            pick(4, "AVG", "MAX", "COUNT", "SUM"), "(?v) AS ?", topic, ")\nFROM NAMED WINDOW <w1> ON STREAM <",
            topic, "> [RANGE ", (user + 1) * 1000, " STEP ", (user % 7 + 1) * 500, "]\n",
            F.when(number % 5 == 0, second).otherwise(""), "WHERE { WINDOW <w1> { ?s ?p ?v . } ",
            F.when(number % 2 == 0, condition).otherwise(""), "}",
        ).alias("query"),
    )


@query(
    "f9_query_complexity",
    with_sql(
        r"""SELECT id, least(1 + 2 * len(regexp_extract_all(query, '\b(SUM|AVG|MAX|MIN|COUNT)\b', 0, 'i'))
  + 3 * len(regexp_extract_all(query, '\bJOIN\b', 0, 'i')) + len(regexp_extract_all(query, '\bFILTER\b', 0, 'i'))
  + 2 * len(regexp_extract_all(query, '\bWINDOW\b', 0, 'i')), 10)::BIGINT AS complexity FROM qlog""",
        _QUERY_LOG,
    ),
)
def f9(spark, sf_dir):
    log = _query_log(spark, sf_dir)
    return log.select("id", querytext.query_complexity("query").alias("complexity"))


@query(
    "f10_query_hash",
    with_sql(r"SELECT id, md5(regexp_replace(query, '\s', '', 'g')) AS query_hash FROM qlog", _QUERY_LOG),
)
def f10(spark, sf_dir):
    return _query_log(spark, sf_dir).select("id", querytext.query_hash("query").alias("query_hash"))


@query(
    "f11_registry",
    """SELECT user_id AS id, query AS rspql_query, topic AS r2s_topic, data AS data_topic, seq FROM (
  SELECT user_id, event_type AS topic, CASE WHEN event_id % 6 <> 0 THEN 'q' || event_id END AS query,
         CASE WHEN event_id % 10 <> 0 THEN event_type || '/data' ELSE '' END AS data, event_id AS seq
  FROM events) WHERE query IS NOT NULL AND data <> ''
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1""",
)
def f11(spark, sf_dir):
    """Registrations of users; some lack the query text or the data topic."""
    number = F.col("event_id")
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"),
        F.when(number % 6 != 0, F.concat(F.lit("q"), number.cast("string"))).alias("rspql_query"),
        F.col("event_type").alias("r2s_topic"),
        F.when(number % 10 != 0, F.concat("event_type", F.lit("/data"))).otherwise("").alias("data_topic"),
        number.alias("seq"),
    )
    return profile.registry(events)


@query(
    "f12_query_features",
    with_sql(
        # read off the parts the texts are made of
        r"""SELECT id, agg, CASE WHEN agg IN ('AVG', 'COUNT', 'SUM') THEN agg ELSE 'MAX' END AS contained_agg,
  replace(query, '(' || agg || '(?v) AS ?' || event_type || ')', '?v') AS bare_query, output_operator, 'out' || user_id AS output_name
FROM (SELECT *, ['AVG', 'MAX', 'COUNT', 'SUM'][event_id % 4 + 1] AS agg,
        ['RStream', 'IStream', 'DStream'][event_id % 3 + 1] AS output_operator FROM qlog JOIN events ON id = event_id)""",
        _QUERY_LOG,
    ),
)
def f12(spark, sf_dir):
    features = querytext.query_features(_query_log(spark, sf_dir))
    return features.select("id", "agg", "contained_agg", "bare_query", "output_operator", "output_name")


@query(
    "f12_query_windows",
    with_sql(
        r"""SELECT id, regexp_extract(clause, 'WINDOW <([^>]+)>', 1) AS "window", regexp_extract(clause, 'STREAM <([^>]+)>', 1) AS stream,
  regexp_extract(clause, 'RANGE (\d+)', 1)::BIGINT AS width, regexp_extract(clause, 'STEP (\d+)', 1)::BIGINT AS slide
FROM (SELECT id, unnest(regexp_extract_all(query, 'FROM NAMED WINDOW [^\]]+\]')) AS clause FROM qlog)""",
        _QUERY_LOG,
    ),
)
def f12_windows(spark, sf_dir):
    log = _query_log(spark, sf_dir)
    return log.select("id", F.explode(querytext.windows("query")).alias("_w")).select("id", "_w.*")

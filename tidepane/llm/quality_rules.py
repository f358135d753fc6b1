"""Quality rules of documents and verdicts on their hosts, by built-in functions only.

Every text is measured on its own row. A document fails the base rules if it has fewer than 10 words or if over a fifth
of its words lie in five-word windows that occur again in it. Further rules mark it as suspect: many symbols for
its words, many lines seen before, words too short or too long on average. Failures of any rule are counted by host (counts are summed
before the shuffle, so a host with a third of all rows is one row per task), and the rate of a host is drawn towards the
rate of all by a beta prior with the moments of the host rates. The documents of a host whose drawn rate is beyond
``host_limit`` must pass every rule; those of other hosts may fail one of the further rules. A document that fails no
rule is kept wherever it is from.

Null texts have no words, and so fail; a null host is a host of its own. Equal rows are counted and returned as often as
they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepane.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Columns that :func:`measure` adds.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _windows(words: Column, n: int) -> Column:
    """Hash of every window of ``n`` hashed words; ``words`` must be a column, since it is read for every window."""
    starts = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(
        F.size(words) >= n, F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))
    ).otherwise(F.array().cast("array<bigint>"))


def with_repeated_words(docs: DataFrame, words: str, out: str, n: int = 5) -> DataFrame:
    """Adds the number of words that lie in windows of ``n`` words found twice or more in the array ``words``.

    Windows are compared by 64-bit hashes. Only texts in which a hash occurs twice are sorted; the places of repeated
    windows then cover ``n`` words each, less what the window before covers already. Every array that is read by
    index is a column of its own, so that it is made once for a text.
    """
    steps = docs.withColumn("__hashed", F.transform(words, lambda w: F.xxhash64(w)))
    steps = steps.withColumn("__windows", _windows(F.col("__hashed"), n))
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    steps = steps.withColumn("__placed", F.when(repeats, placed))
    again = F.filter(
        "__placed",
        lambda s, k: (s["h"] == F.get("__placed", k - 1)["h"]) | (s["h"] == F.get("__placed", k + 1)["h"]),
    )
    covered = F.aggregate(
        F.array_sort(F.transform(again, lambda s: s["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(-n).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(n), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    steps = steps.withColumn(out, F.coalesce(covered, F.lit(0)).cast("bigint"))
    return steps.drop("__hashed", "__windows", "__placed")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with :data:`MEASURES` (longs) in place of columns of these names."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(WORD))
    staged = docs.withColumns({
        "__words": F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)),
        "__lines": lines,
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOL)).cast("bigint"),
    })
    staged = staged.withColumns({
        "n_words": F.size("__words").cast("bigint"),
        "word_chars": F.aggregate("__words", F.lit(0).cast("bigint"), lambda n, w: n + F.length(w)),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
    })
    staged = with_repeated_words(staged.drop(text), "__words", "n_repeat_words")
    return staged.drop("__words", "__lines")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def suspicions() -> Column:
    """How many of the further rules a measured document fails, in whole numbers throughout."""
    rules = [
        10 * F.col("n_symbols") > F.col("n_words"),  # more than a symbol in ten words
        10 * F.col("n_dup_lines") > F.col("n_words"),  # lines seen before, one for fewer than ten words
        (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
    ]
    return sum((r.cast("int") for r in rules[1:]), rules[0].cast("int"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", host_limit: float = 0.5) -> DataFrame:
    """``docs`` without ``text``, with :data:`MEASURES`, ``base_failed``, ``host_rate`` and ``kept`` in place of columns
    of these names."""
    own = [*MEASURES, "base_failed", "host_rate", "kept"]  # documents may have such columns already
    columns = [c for c in docs.columns if c != text and (c not in own or c == host)]
    measured = measure(docs.select(text, *[c for c in columns if c != text]), text)
    measured = cut_lineage(measured.withColumn("base_failed", base_failed()).withColumn("__suspect", suspicions()))
    failed = (F.col("base_failed") | (F.col("__suspect") > 0)).cast("bigint")
    hosts = measured.groupBy(F.col(host).alias("__host")).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(failed).alias("__k")
    )
    prior = beta_prior(hosts)
    rated = hosts.select(
        "__host", ((F.col("__k") + prior[0]) / (F.col("__n") + prior[0] + prior[1])).alias("host_rate")
    )
    allowed = F.when(F.col("host_rate") > host_limit, 0).otherwise(1)
    return (
        measured.join(rated, F.col(host).eqNullSafe(F.col("__host")), "left")
        .withColumn("kept", ~F.col("base_failed") & (F.col("__suspect") <= allowed))
        .select(*columns, *MEASURES, "base_failed", "host_rate", "kept")
    )


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Parameters of a beta distribution with the mean and variance of the host rates; one row reaches the driver.

    Moments are sums of rounded decimals, so they don't depend on the order of hosts. Without spread among the hosts,
    or without hosts, the prior is as strong as ten documents.
    """
    rate = (F.col("__k") / F.col("__n")).cast("decimal(18,12)")
    row = hosts.agg(
        F.count(F.lit(1)).alias("n"), F.sum(rate).alias("one"), F.sum((rate * rate).cast("decimal(24,18)")).alias("two")
    ).first()
    if not row.n:
        return 1.0, 9.0
    mean = float(row.one) / row.n
    spread = float(row.two) / row.n - mean * mean
    strength = mean * (1 - mean) / spread - 1 if spread > 1e-9 else 10.0
    strength = max(strength, 1.0)
    return mean * strength, (1 - mean) * strength


ORACLE = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT doc_id, unnest(range(len(w) - 4)) AS i,
    unnest(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS g
  FROM words WHERE len(w) >= 5
), again AS (
  SELECT doc_id, i, i - lag(i, 1, -5) OVER (PARTITION BY doc_id ORDER BY i) AS gap
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, sum(least(5, gap))::BIGINT AS n FROM again GROUP BY doc_id
), lines AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM words
), measured AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), flagged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    (10 * n_symbols > n_words)::INT + (10 * n_dup_lines > n_words)::INT
      + (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT AS suspect
  FROM measured
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR suspect > 0) AS k FROM flagged GROUP BY source
), moments AS (
  SELECT avg(k / n) AS m, avg((k / n) * (k / n)) - avg(k / n) * avg(k / n) AS v FROM hosts
), prior AS (
  SELECT m, greatest(CASE WHEN v > 1e-9 THEN m * (1 - m) / v - 1 ELSE 10 END, 1) AS s FROM moments
), rated AS (
  SELECT source, (k + m * s) / (n + s) AS host_rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND suspect <= CASE WHEN host_rate > 0.5 THEN 0 ELSE 1 END AS kept
FROM flagged JOIN rated ON flagged.source IS NOT DISTINCT FROM rated.source
"""

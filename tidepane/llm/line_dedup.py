"""Removal of passages that repeat across documents, in content-defined chunks of lines; built-in functions only.

A text is cut into chunks where a rolling hash over the hashes of the last ``WINDOW`` lines falls on a multiple of
``DIVISOR``, and before and after a line of over ``LONG`` words. Borders depend on the lines around them only, so a
passage is cut alike wherever it stands. Chunks of several lines, and single lines of over ``LONG`` words, that occur more than once in the
table are removed but for their first place: the smallest id, there the smallest position.

Equal chunks are found by hash and by their bytes: counts are kept by (hash, text), summed in the map tasks first, so
a passage in a third of all rows is one row per task. A hash that stands for two different texts is left alone. Then
only hashes, ids and positions are joined, and each document gets the list of its own lines to remove.

Null texts count as empty; they have one empty line, which is no passage. A text of which all goes is empty. Rows with
equal ids count as one place: repeats between them stay. A null id counts as larger than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 3
DIVISOR = 4
LONG = 50

# Prime modulus and multiplier of the rolling hash, small enough that sums stay within a long.
_MODULUS = 1_000_003
_MULTIPLIER = 31


def _line_hash(line: Column) -> Column:
    """60 bits of an MD5 digest, taken below the modulus."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("bigint") % _MODULUS


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def chunked(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """A row per chunk: ``__id``, ``__th`` (hash of the whole text), ``start``, ``n_lines``, ``chunk``; all lines are in one."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lined = docs.select(
        F.col(id_col).alias("__id"), F.xxhash64(whole).alias("__th"), F.split(whole, "\n").alias("lines")
    ).withColumns({
        "hashes": F.transform("lines", _line_hash),
        # few lines are long enough to need their words counted
        "long": F.transform("lines", lambda x: F.when(F.length(x) > 2 * LONG, _words(x) > LONG).otherwise(F.lit(False))),
    })
    rolling = lambda i: sum(
        (F.coalesce(F.get("hashes", i - j), F.lit(0)) * _MULTIPLIER**j for j in range(1, WINDOW)), F.get("hashes", i)
    ) % _MODULUS
    ends = F.filter(
        F.sequence(F.lit(0), F.size("lines") - 1),
        lambda i: (i == F.size("lines") - 1)
        | (rolling(i) % DIVISOR == 0)
        | F.get("long", i)
        | F.get("long", i + 1),
    )
    spans = F.transform(
        F.col("ends"),
        lambda e, k: F.struct(
            F.coalesce(F.get("ends", k - 1) + 1, F.lit(0)).alias("start"),
            (e - F.coalesce(F.get("ends", k - 1), F.lit(-1))).alias("n_lines"),
            F.get("long", e).alias("long"),
        ),
    )
    spanned = lined.withColumn("ends", ends).withColumn("spans", spans)
    # inline() alone lets Spark derive a filter on the spans and write their whole definition into it, arrays and all
    return (
        spanned.select("__id", "__th", "lines", F.inline_outer("spans"))
        .filter("n_lines > 1 OR long")
        .select("__id", "__th", "start", "n_lines", F.expr("array_join(slice(lines, start + 1, n_lines), '\n')").alias("chunk"))
    )


def _key() -> Column:
    return F.unhex(F.md5(F.col("chunk").cast("binary")))


def repeated(chunks: DataFrame) -> DataFrame:
    """``hash, first`` of every chunk text that occurs more than once: the smallest id it is found in."""
    texts = chunks.withColumn("hash", _key()).groupBy("hash", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.min("__id").alias("first")
    )
    return (
        texts.groupBy("hash")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"))
        .filter("n > 1 AND texts = 1")
        .select("hash", "first")
    )


def removals(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``__id, __th, __spans``: places to remove from each text that holds any, as an array of (start, n_lines)."""
    chunks = chunked(docs, text, id_col)
    places = chunks.select("__id", "__th", "start", "n_lines", _key().alias("hash"))
    within = Window.partitionBy("__id", "__th", "hash")  # the places of one chunk in one text
    found = places.join(repeated(chunks), "hash").distinct()  # repeated rows have equal places
    found = found.withColumn("earliest", F.min("start").over(within))
    gone = found.filter(~(F.col("__id").eqNullSafe(F.col("first")) & (F.col("start") == F.col("earliest"))))
    return gone.groupBy("__id", "__th").agg(F.collect_set(F.struct("start", "n_lines")).alias("__spans"))


def without_repeats(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", removed: str | None = None
) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; ``removed`` names a column for the number of lines cut."""
    gone = removals(docs, text, id_col)
    whole = F.coalesce(F.col(text), F.lit(""))
    joined = docs.withColumn("__key", F.xxhash64(whole)).join(
        gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__th")), "left"
    )
    # arrays read by index are columns of their own, made once for a text, and only for texts that lose lines
    joined = joined.withColumn("__lines", F.when(F.col("__spans").isNotNull(), F.split(whole, "\n")))
    cut = F.flatten(F.transform("__spans", lambda s: F.sequence(s["start"], s["start"] + s["n_lines"] - 1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), cut)
    kept = F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n")
    out = {text: F.when(F.col("__spans").isNull(), F.col(text)).otherwise(kept)}
    columns = [F.col(c) if c != text else out[text].alias(text) for c in docs.columns if c != removed]
    if removed:
        count = F.aggregate("__spans", F.lit(0).cast("bigint"), lambda n, s: n + s["n_lines"])
        columns.append(F.coalesce(count, F.lit(0)).alias(removed))
    return joined.select(*columns)


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 15))::BIGINT % 1000003 AS h,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 50 AS long
  FROM lines
), cut AS (
  SELECT *, i = max(i) OVER (PARTITION BY doc_id) OR long OR lead(long, 1, false) OVER o
    OR (h + 31 * lag(h, 1, 0) OVER o + 961 * lag(h, 2, 0) OVER o) % 1000003 % 4 = 0 AS ends
  FROM hashed WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i) - ends::INT AS c FROM cut
), chunks AS (
  SELECT doc_id, c, min(i) AS start, string_agg(line, chr(10) ORDER BY i) AS chunk
  FROM numbered GROUP BY doc_id, c HAVING count(*) > 1 OR bool_or(long)
), gone AS (
  SELECT doc_id, c FROM (
    SELECT doc_id, c, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, start) AS place FROM chunks
  ) WHERE place > 1
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.c IS NULL), '') AS text,
  count(*) FILTER (WHERE g.c IS NOT NULL) AS n_removed
FROM numbered n LEFT JOIN gone g USING (doc_id, c) GROUP BY doc_id
"""

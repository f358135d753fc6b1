"""Column functions over the texts of registered queries. They look at words, not at grammar.

A text is cut at its keywords and each part read word by word, so keywords may be in any case and any white space,
line breaks included, may stand between words. Window sizes are milliseconds or ISO 8601 durations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepane.functions.aggregates import AGGREGATES

# The relation-to-stream operators of the language, as they are written in results.
OPERATORS = ("RStream", "IStream", "DStream")
_VARIABLE = r"[?$]\w+"


def _count(query: str | Column, words: str) -> Column:
    return F.regexp_count(query, F.lit(rf"(?i)\b({words})\b"))


def query_complexity(query: str) -> Column:
    """1 + 2 per aggregate + 3 per JOIN + 1 per FILTER + 2 per WINDOW, at most 10."""
    score = (
        1
        + 2 * _count(query, "|".join(AGGREGATES))
        + 3 * _count(query, "JOIN")
        + _count(query, "FILTER")
        + 2 * _count(query, "WINDOW")
    )
    return F.least(score, F.lit(10)).cast("bigint")


def query_hash(query: str) -> Column:
    """Fingerprint that does not change with white space."""
    return F.md5(F.regexp_replace(query, r"\s", ""))


def _parts(query: str | Column, *keywords: str) -> Column:
    """The text cut at a sequence of keywords; the first part is what stands before it."""
    return F.split(query, r"(?i)\b" + r"\s+".join(keywords) + r"\b")


def _words(part: Column) -> Column:
    """Words of a part; brackets are words of their own, so they end the ones beside them."""
    return F.split(F.trim(F.regexp_replace(part, r"\s+|([\[\](){}])", " $1 ")), " +")


def _after(words: Column, keyword: str) -> Column:
    """The word that follows a keyword; null if the keyword does not occur."""
    at = F.array_position(F.transform(words, lambda w: F.upper(w)), keyword)
    return F.when(at > 0, F.get(words, at.cast("int")))


def _bare(name: Column) -> Column:
    """An IRI without its angle brackets; prefixed names stay as they are."""
    return F.regexp_replace(name, "[<>]", "")


def _projection(query: str) -> Column:
    """What is selected: the text between the first SELECT and the clause that follows it."""
    selected = F.get(_parts(query, "SELECT"), F.lit(1))
    return F.get(F.split(selected, r"(?i)\b(FROM|WHERE)\b|\{"), F.lit(0))


def selected_aggregate(query: str) -> Column:
    """The first function that is called in the projection, in capitals; AVG if there is none."""
    calls = F.regexp_extract_all(_projection(query), F.lit(r"(?<![?$\w])(\w+)\s*\("), F.lit(1))
    return F.upper(F.coalesce(F.get(calls, F.lit(0)), F.lit("AVG")))


def contained_aggregate(query: str) -> Column:
    """First of SUM, AVG, COUNT, MIN, MAX that occurs anywhere in the text."""
    col = F.col(query)
    return F.coalesce(
        *[F.when(col.contains(name), name) for name in ("SUM", "AVG", "COUNT", "MIN", "MAX")]
    )


def without_aggregates(query: str) -> Column:
    """``(F(?v) AS ?x)`` becomes ``?v``; DISTINCT inside the call goes too."""
    call = rf"\w+\s*\(\s*(?:DISTINCT\b\s*)?({_VARIABLE})\s*\)"
    return F.regexp_replace(query, rf"(?i)\(\s*{call}\s*AS\s*{_VARIABLE}\s*\)", "$1")


def _registration(query: str) -> Column:
    return _words(F.get(_parts(query, "REGISTER"), F.lit(1)))


def output_operator(query: str) -> Column:
    """The operator the query registers its output with, as :data:`OPERATORS` write it; null for others."""
    word = F.upper(F.get(_registration(query), F.lit(0)))
    return F.coalesce(*[F.when(word == name.upper(), name) for name in OPERATORS])


def output_name(query: str) -> Column:
    """The name of the registered output; null without an operator."""
    return F.when(output_operator(query).isNotNull(), _bare(F.get(_registration(query), F.lit(1))))


def duration_ms(size: Column) -> Column:
    """Milliseconds of a number or of an ISO 8601 duration of days, hours, minutes and seconds; else null."""
    total = F.lit(0).cast("decimal(38,3)")
    for unit, ms in (("D", 86_400_000), ("H", 3_600_000), ("M", 60_000), ("S", 1_000)):
        amount = F.regexp_extract(F.upper(size), rf"([0-9.]+){unit}", 1)
        total = total + F.coalesce(amount.try_cast("decimal(18,3)"), F.lit(0)) * ms
    iso = F.upper(size).rlike(r"^P(?=.)([0-9]+D)?(T(?=.)([0-9]+H)?([0-9]+M)?([0-9]+(\.[0-9]+)?S)?)?$")
    return F.coalesce(size.try_cast("bigint"), F.when(iso, total.cast("bigint")))


def windows(query: str) -> Column:
    """All window clauses as ``ARRAY<STRUCT<window, stream, width, slide>>``, sizes in ms.

    Each stands between ``FROM NAMED WINDOW`` and a closing bracket; without STEP the slide is the width.
    """
    clauses = F.transform(
        F.slice(_parts(query, "FROM", "NAMED", "WINDOW"), 2, 1_000_000),
        lambda part: _words(F.get(F.split(part, r"\]"), F.lit(0))),
    )
    read = F.transform(
        clauses,
        lambda words: F.struct(
            _bare(F.get(words, F.lit(0))).alias("window"),
            _bare(_after(words, "STREAM")).alias("stream"),
            duration_ms(_after(words, "RANGE")).alias("width"),
            duration_ms(F.coalesce(_after(words, "STEP"), _after(words, "RANGE"))).alias("slide"),
        ),
    )
    return F.filter(read, lambda w: w["stream"].isNotNull())


def query_features(log: DataFrame, query: str = "query") -> DataFrame:
    """The log with the text features of each query added."""
    return log.withColumns(
        {
            "query_hash": query_hash(query),
            "complexity": query_complexity(query),
            "agg": selected_aggregate(query),
            "contained_agg": contained_aggregate(query),
            "bare_query": without_aggregates(query),
            "output_operator": output_operator(query),
            "output_name": output_name(query),
            "windows": windows(query),
        }
    )

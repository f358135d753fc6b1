"""Secrets in texts: fixed patterns, and sliding-window entropy of candidate strings; built-in functions only.

Base spans are the matches of three patterns. A candidate for the entropy scan is a run of ``WINDOW`` or more letters,
digits and ``+/_=-`` that holds a letter and a digit, lies in no base span and is on no allow-list (identifiers like UUIDs, dates, words
joined by signs, one sign over and over). A window of ``WINDOW`` characters slides over it; the number of each
character in the window is kept, so a step adds one character, takes one away and corrects the sum of n log n by these
two. If the largest entropy of a window reaches the bound of the narrowest character class that holds the
candidate, it is a span of kind ``entropy``.

Positions are code points, ends exclusive: the texts between matches and the matches are lined up and their lengths
summed. Null texts count as empty and have no spans. Every row is handled alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 20

# The base patterns, in the order their kinds are listed, and the least length of what they must hold.
ASSIGN = (
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LENGTH = 6

#: Runs looked at: not inside a longer run, with a digit and a letter.
CANDIDATE = (
    r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{20})(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]+"
)
#: Character classes from narrow to wide, with the bits a window must reach.
CLASSES = [
    ("^[0-9a-f]+$|^[0-9A-F]+$", 3.0),
    ("^[0-9a-z]+$|^[0-9A-Z]+$", 3.5),
    ("^[0-9A-Za-z]+$", 3.7),
    ("", 3.9),
]
#: Candidates that are no secrets whatever their entropy.
ALLOWED = [
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[A-Za-z0-9_+-]*$",  # date first
    r"^([A-Za-z]+[0-9]{0,4}[+/_=-]+)+[A-Za-z]*[0-9]{0,4}$",  # words joined by signs, with short numbers
    r"(.)\1{7,}",  # a sign over and over
    r"(?i)0123456789|abcdefghij|example|sample|test",
]


def _spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """``(start, end)`` of every match whose ``group`` has ``least`` characters or more; null without any match."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("held"),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    lined = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0))).alias("at"),
            F.when(
                F.length(p["held"]) >= least,
                F.concat(
                    a["spans"],
                    F.array(
                        F.struct(
                            (a["at"] + F.length(p["gap"])).alias("start"),
                            (a["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return F.coalesce(F.when(text.rlike(pattern), lined), none)


def _entropy(word: Column) -> Column:
    """Largest entropy in bits of a window that slides over ``word``, from counts that change by two per step."""
    f = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(WINDOW + 2)])
    counts = F.array_repeat(F.lit(0), 128)
    codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c))
    def step(a: Column, p: Column) -> Column:
        new, old = p["new"], p["old"]
        n = F.get(a["counts"], new)
        # the old character leaves first, so equal ones cancel out
        same = new == old
        n_old = F.get(a["counts"], old)
        less = F.when(old.isNull() | same, F.lit(0.0)).otherwise(F.get(f, n_old - 1) - F.get(f, n_old))
        more = F.when(same, F.lit(0.0)).otherwise(F.get(f, n + 1) - F.get(f, n))
        moved = F.transform(
            a["counts"],
            lambda v, j: v + (j == new).cast("int") - F.coalesce((j == old).cast("int"), F.lit(0)),
        )
        total = a["sum"] + less + more
        full = a["seen"] + 1 >= WINDOW
        return F.struct(
            moved.alias("counts"),
            total.alias("sum"),
            (a["seen"] + 1).alias("seen"),
            F.when(full, F.greatest(a["best"], math.log2(WINDOW) - total / WINDOW)).otherwise(a["best"]).alias("best"),
        )

    shifted = F.concat(F.array_repeat(F.lit(None).cast("int"), WINDOW), codes)
    pairs = F.filter(F.arrays_zip(codes.alias("new"), shifted.alias("old")), lambda p: p["new"].isNotNull())
    start = F.struct(
        counts.alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("seen"), F.lit(0.0).alias("best")
    )
    return F.aggregate(pairs, start, step, lambda a: a["best"])


def _labelled(spans: str | Column, rank: int, kind: str) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")
        ),
    )


def with_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with ``out``: an array of ``(start, rank, kind, end)`` by start, then kind; rank 3 is the entropy scan."""
    whole = F.coalesce(F.col(text), F.lit(""))
    steps = docs.withColumn("__t", whole).withColumns({
        "__k0": _spans(F.col("__t"), ASSIGN, 2, ASSIGN_LENGTH),
        "__k1": _spans(F.col("__t"), ACCESS, 0, 0),
        "__k2": _spans(F.col("__t"), HEX, 0, 0),
        "__k3": _spans(F.col("__t"), CANDIDATE, 0, 0),
    })
    base = F.concat(*[_labelled(f"__k{k}", k, kind) for k, kind in enumerate(("assign", "access", "hex"))])
    steps = steps.withColumn("__base", base)
    alone = F.filter(
        "__k3",
        lambda c: ~F.exists("__base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    named = F.transform(
        alone,
        lambda c: F.struct(
            c["start"].alias("start"),
            c["end"].alias("end"),
            F.substring("__t", c["start"] + 1, c["end"] - c["start"]).alias("word"),
        ),
    )
    steps = steps.withColumn("__named", named)

    def secret(c: Column) -> Column:
        bound = F.lit(CLASSES[-1][1])
        for pattern, bits in reversed(CLASSES[:-1]):
            bound = F.when(c["word"].rlike(pattern), F.lit(bits)).otherwise(bound)
        allowed = F.lit(False)
        for pattern in ALLOWED:
            allowed = allowed | c["word"].rlike(pattern)
        return F.when(allowed, False).otherwise(_entropy(c["word"]) >= bound)

    found = _labelled(F.filter("__named", secret), 3, "entropy")
    return steps.withColumn(out, F.array_sort(F.concat("__base", found))).drop(
        "__t", "__k0", "__k1", "__k2", "__k3", "__base", "__named"
    )


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def _oracle() -> str:
    """The query's rows in SQL: candidates are all runs, and their windows are counted anew instead of slid."""

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''").replace('\\"', '"').replace("\\'", "'") + "'"

    assign = quoted(ASSIGN.replace('[\\"\']', "[\"']"))
    kinds = [(0, assign, 2, ASSIGN_LENGTH), (1, quoted(ACCESS), 0, 0), (2, quoted(HEX), 0, 0), (3, "'[A-Za-z0-9+/_=-]{20,}'", 0, 0)]
    parts = " UNION ALL ".join(
        f"SELECT doc_id, {rank} AS rank, string_split_regex(t, {p}) AS gap, regexp_extract_all(t, {p}) AS hit, "
        f"regexp_extract_all(t, {p}, {group}) AS held, {least} AS least FROM docs WHERE regexp_matches(t, {p})"
        for rank, p, group, least in kinds
    )
    bound = " ".join(f"WHEN regexp_matches(word, {quoted(p)}) THEN {bits}" for p, bits in CLASSES[:-1])
    simple = [p for p in ALLOWED if "\\1" not in p]
    allowed = " OR ".join(f"regexp_matches(word, {quoted(p)})" for p in simple)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS ({parts}),
placed AS (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM parts),
spans AS (
  SELECT doc_id, rank, hit[i] AS word, CAST(list_sum(list_transform(gap[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM placed WHERE length(held[i]) >= least
), base AS (SELECT * FROM spans WHERE rank < 3),
candidates AS (
  SELECT * FROM spans c WHERE rank = 3 AND regexp_matches(word, '[0-9]') AND regexp_matches(word, '[A-Za-z]') AND NOT ({allowed})
    AND NOT EXISTS (FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.s + length(c.word) AND c.s < b.s + length(b.word))
    AND NOT list_bool_or(list_transform(range(1, length(word) - 6), lambda k: word[k:k + 7] = repeat(word[k:k], 8)))
), windows AS (SELECT doc_id, s, word, unnest(range(1, length(word) - {WINDOW} + 2)) AS k FROM candidates),
signs AS (
  SELECT doc_id, s, word, k, sign, count(*) / {WINDOW} AS share
  FROM (SELECT *, unnest(string_split(word[k:k + {WINDOW - 1}], '')) AS sign FROM windows) GROUP BY ALL
), best AS (
  SELECT doc_id, s, word, max(bits) AS bits FROM (SELECT doc_id, s, word, k, -sum(share * log2(share)) AS bits FROM signs GROUP BY ALL)
  GROUP BY ALL
), every AS (
  SELECT doc_id, rank, s, s + length(word) AS e FROM base
  UNION ALL SELECT doc_id, 3, s, s + length(word) FROM best WHERE bits >= CASE {bound} ELSE {CLASSES[-1][1]} END
), named AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][rank + 1] || ':' || s || ':' || e AS name FROM every)
SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access,
  count(*) FILTER (WHERE rank = 2) AS n_hex,
  sha256(coalesce(string_agg(name, ',' ORDER BY s, rank) FILTER (WHERE rank < 3), '')) AS base_sha256,
  coalesce(string_agg(name, ',' ORDER BY s, rank), '') AS spans
FROM docs LEFT JOIN named USING (doc_id) GROUP BY doc_id"""


ORACLE = _oracle()

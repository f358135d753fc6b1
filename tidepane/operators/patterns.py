"""Triple patterns as DataFrame filters, joins and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepane.functions.aggregates import final

_TERMS = ("s", "p", "o", "g")


def match(
    triples: DataFrame,
    s: str | None = None,
    p: str | None = None,
    o: str | None = None,
    g: str | None = None,
) -> DataFrame:
    """Triples whose given terms are equal to the bound values; the filter reaches the scan."""
    bound = {"s": s, "p": p, "o": o, "g": g}
    for term, value in bound.items():
        if value is not None:
            triples = triples.filter(F.col(term) == value)
    return triples


def bgp(
    triples: DataFrame,
    patterns: Sequence[tuple[str, str, str]],
    scope: Sequence[str] = (),
) -> DataFrame:
    """Solutions of a basic graph pattern; ``?name`` terms are variables, others are bound.

    Each pattern is a filtered scan with only its variables; patterns are joined on the variables
    they share, and on the ``scope`` columns (graph or window). Stars over one subject share one
    partitioning, so only the first join shuffles each side.
    """
    solutions: DataFrame | None = None
    for pattern in patterns:
        columns: dict[str, Column] = {}
        rows = triples
        for term, column in zip(pattern, ("s", "p", "o")):
            if not term.startswith("?"):
                rows = rows.filter(F.col(column) == term)
            elif term[1:] in columns:
                rows = rows.filter(columns[term[1:]] == F.col(column))
            else:
                columns[term[1:]] = F.col(column)
        part = rows.select(*scope, *[col.alias(name) for name, col in columns.items()])
        if solutions is None:
            solutions = part
            continue
        shared = [name for name in columns if name in solutions.columns]
        if not shared:
            raise ValueError(f"pattern {pattern} shares no variable with those before it")
        solutions = solutions.join(part, [*scope, *shared])
    if solutions is None:
        raise ValueError("a graph pattern needs at least one triple pattern")
    return solutions


def scope(triples: DataFrame, graph: str) -> DataFrame:
    """The triples of one named window or graph."""
    return match(triples, g=graph)


def union_streams(*streams: DataFrame) -> DataFrame:
    """All rows of all branches, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b), streams)


def with_static(df: DataFrame, static: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Add static facts to stream rows. Spark broadcasts the static side if it is small enough."""
    return df.join(static, list(on), how)


def dedupe_triples(df: DataFrame, keys: Sequence[str] = _TERMS) -> DataFrame:
    """Set semantics inside one evaluation; add the window to ``keys`` to dedupe per window."""
    return df.dropDuplicates(list(keys))


def group_agg(
    df: DataFrame, keys: Sequence[str], agg: str, col: str = "value", scale: int | None = None
) -> DataFrame:
    return df.groupBy(*keys).agg(final(agg, col, scale).alias("result"))


def simple_agg(df: DataFrame, agg: str, col: str = "o", scale: int | None = None) -> DataFrame:
    """One aggregate over all objects that are numbers; an empty SUM, AVG or COUNT is 0."""
    return simple_aggs(df, [agg], col, scale).withColumnRenamed(agg, "result")


def simple_aggs(df: DataFrame, aggs: Sequence[str], col: str = "o", scale: int | None = None) -> DataFrame:
    """Several aggregates over all objects that are numbers, in one pass and one row, named as they are given."""
    value = df.select(F.col(col).try_cast("double").alias("v"))

    def result(agg: str) -> Column:
        out = final(agg, "v", scale).cast("double")
        return F.coalesce(out, F.lit(0.0)) if agg.upper() in ("SUM", "AVG", "COUNT") else out

    return value.agg(*[result(agg).alias(agg) for agg in aggs])

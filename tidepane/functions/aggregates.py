"""The five aggregates of window queries, as mergeable partials and final values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AGGREGATES = ("AVG", "SUM", "COUNT", "MIN", "MAX")


def check_aggregate(agg: str) -> str:
    name = agg.upper()
    if name not in AGGREGATES:
        raise ValueError(f"unsupported aggregate {agg!r}; use one of {', '.join(AGGREGATES)}")
    return name


def total(col: str | Column, scale: int | None = None) -> Column:
    """Sum; with ``scale`` decimals kept exactly, so partial sums in any order give equal bits."""
    col = F.col(col) if isinstance(col, str) else col
    if scale is None:
        return F.sum(col)
    unit = float(10**scale)
    return F.sum(F.round(col * unit).cast("bigint")) / F.lit(unit)


def final(agg: str, col: str | Column, scale: int | None = None) -> Column:
    """One-step aggregate of raw values."""
    name = check_aggregate(agg)
    col = F.col(col) if isinstance(col, str) else col
    if name == "AVG":
        return F.try_divide(total(col, scale), F.count(col)) if scale is not None else F.avg(col)
    if name == "SUM":
        return total(col, scale)
    return {"COUNT": F.count, "MIN": F.min, "MAX": F.max}[name](col).cast("double")


def partials(col: str, scale: int | None = None) -> list[Column]:
    return [
        F.count(col).alias("n"),
        total(col, scale).alias("sum"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
    ]


def merge_partials(scale: int | None = None) -> list[Column]:
    return [
        F.sum("n").alias("n"),
        total("sum", scale).alias("sum"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    ]


def from_partials(agg: str) -> Column:
    name = check_aggregate(agg)
    return {
        "AVG": F.try_divide(F.col("sum"), F.col("n")),
        "SUM": F.col("sum"),
        "COUNT": F.col("n").cast("double"),
        "MIN": F.col("min"),
        "MAX": F.col("max"),
    }[name]

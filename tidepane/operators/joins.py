"""Join per-group figures back to the rows they describe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepane.session import cut_lineage

# What every executor can hold: rows, looked at first, and their bytes as text.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def fits_broadcast(df: DataFrame) -> bool:
    """Whether a saved table is within both bounds; no more than ``BROADCAST_ROWS`` + 1 rows are measured."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns]))))
    row = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), size.alias("size")).first()
    return row.n <= BROADCAST_ROWS and (row["size"] or 0) <= BROADCAST_BYTES


def attach(
    df: DataFrame, figures: DataFrame, by: Sequence[str], how: str = "left"
) -> DataFrame:
    """Add the columns of ``figures`` (one row per group) to the rows of ``df``; null keys match.

    The figures are computed once and measured. Up to ``BROADCAST_ROWS`` groups of ``BROADCAST_BYTES`` together they
    are broadcast, so the rows are not shuffled and a hot group stays where it is; more are joined by shuffle, where
    adaptive execution splits hot ones.
    """
    saved = cut_lineage(figures)
    values = [c for c in figures.columns if c not in by]
    small = fits_broadcast(saved)
    right = saved.select(*[F.col(k).alias(f"_key_{k}") for k in by], *values)
    on = [df[k].eqNullSafe(right[f"_key_{k}"]) for k in by]
    joined = df.join(F.broadcast(right) if small else right, on, how)
    return joined.select(*df.columns, *values)

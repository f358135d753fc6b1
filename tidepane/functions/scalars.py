"""Extension scalar functions of query texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(col: str | Column) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return col.try_cast("double")


def ext_sqrt(x: str | Column) -> Column:
    """Square root; null for anything that is not a number."""
    return F.sqrt(_number(x))


def ext_pow(x: str | Column, y: str | Column) -> Column:
    """``x`` to the power ``y``; null if either is not a number."""
    return F.pow(_number(x), _number(y))

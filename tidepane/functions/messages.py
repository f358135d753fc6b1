"""Result messages: the text forms in which window results travel between queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ontology terms used in observation and result triples.
SAREF = "https://saref.etsi.org/core/"
HAS_VALUE = SAREF + "hasValue"
XSD_FLOAT = "http://www.w3.org/2001/XMLSchema#float"

_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_VALUE_LITERAL = r'hasValue>\s*"([^"]*)"'


def _column(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def leading_number(col: str | Column) -> Column:
    """The number a text starts with (leading blanks allowed), else null."""
    prefix = F.regexp_extract(_column(col), rf"^\s*({_NUMBER})", 1)
    return F.when(prefix != "", prefix).try_cast("double")


def unwrap_message(col: str | Column) -> Column:
    """Remove the quotes and escapes of a JSON string; other texts are left as they are."""
    col = _column(col)
    quoted = F.length(col) >= 2
    quoted = quoted & col.startswith('"') & col.endswith('"')
    inner = F.substring(col, F.lit(2), F.length(col) - 2)
    return F.when(quoted, F.regexp_replace(inner, r'\\(["\\/])', "$1")).otherwise(col)


def parse_result_value(col: str | Column) -> Column:
    """Number carried by a result message: the literal of its value triple, else a bare number."""
    text = unwrap_message(col)
    literal = F.regexp_extract(text, _VALUE_LITERAL, 1)
    return F.when(literal != "", leading_number(literal)).otherwise(leading_number(text))


def is_result_triple(col: str | Column) -> Column:
    """Messages that carry a value triple, as opposed to the bare number sent beside it."""
    text = unwrap_message(col)
    return (
        text.contains("https://")
        & text.contains("hasValue")
        & ~F.trim(text).rlike(r"^-?\d+\.?\d*$")
    )


def result_triple(value: str | Column, keys: Sequence[str | Column]) -> Column:
    """A result as one N-Triples statement; the subject is derived from the keys, so that a
    repeated task writes the same statement."""
    texts = [_column(k).cast("string") for k in keys]
    return F.concat(
        F.lit("<urn:result:"),
        F.md5(F.concat_ws("|", *texts)),
        F.lit(f'> <{HAS_VALUE}> "'),
        _column(value).cast("string"),
        F.lit(f'"^^<{XSD_FLOAT}> .'),
    )

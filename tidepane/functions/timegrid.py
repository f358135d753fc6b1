"""Time arithmetic on the window grid, for TIMESTAMP and TIMESTAMP_NTZ columns."""

from __future__ import annotations

from math import gcd, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNITS_US = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
}


def duration_us(duration: str | int) -> int:
    """``"30 minutes"`` in microseconds; a plain number is milliseconds, as in query texts."""
    if isinstance(duration, int):
        return duration * 1000
    amount, unit = duration.split()
    return int(amount) * _UNITS_US[unit.rstrip("s")]


def interval(us: int) -> str:
    return f"{us} microseconds"


#: Zones in which a reading of the clock is the instant itself.
UTC_NAMES = ("UTC", "Etc/UTC", "Z", "GMT", "+00:00")


def micros(col: Column | str) -> Column:
    """Microseconds since the epoch, as :func:`pyspark.sql.functions.window` counts them.

    A TIMESTAMP is an instant and counts from 1970 in UTC. A TIMESTAMP_NTZ is a reading of the calendar and the
    clock and counts from the same reading; casting it would shift it by the zone of the session. In a session in UTC
    there is no such shift, and the cast is several times faster than reading the clock. Type and zone are known when
    a query is planned, so one of the three branches is left of the expression.
    """
    col = F.col(col) if isinstance(col, str) else col
    clock = col.cast("timestamp_ntz")
    days = F.unix_date(clock.cast("date")).cast("bigint")
    seconds = (days * 24 + F.hour(clock)) * 3600 + F.minute(clock) * 60
    read = seconds * 1_000_000 + (F.extract(F.lit("SECOND"), clock) * 1_000_000).cast("bigint")
    cast = F.unix_micros(col.cast("timestamp"))
    return F.when((F.typeof(col) != "timestamp_ntz") | F.current_timezone().isin(*UTC_NAMES), cast).otherwise(read)


def from_micros(col: Column, dtype: str = "timestamp_ntz") -> Column:
    """The time of a number of microseconds; the reverse of :func:`micros` for the same type."""
    if dtype != "timestamp_ntz":
        return F.timestamp_micros(col).cast(dtype)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.expr("INTERVAL '0.000001' SECOND") * F.round(col).cast("bigint")


def time_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def start_offset_us(width_us: int, slide_us: int) -> int:
    """Window starts are congruent to ``-width`` modulo ``slide``."""
    return (-width_us) % slide_us


def pane_us(*durations: str | int) -> int:
    """Widest pane that divides every given width and slide."""
    return gcd(*[duration_us(d) for d in durations])


def common_period_us(*durations: str | int) -> int:
    """Shortest time after which all given slides meet again."""
    return lcm(*[duration_us(d) for d in durations])


def explode_range(df: DataFrame, name: str, first: Column, last: Column, run: int = 4096) -> DataFrame:
    """A row per whole number from ``first`` to ``last`` (none if it is less), added as ``name``.

    Numbers are laid out in runs of ``run``, so a row holds no array longer than that or than the number of runs.
    """
    first, last = first.cast("bigint"), last.cast("bigint")
    runs = F.when(first <= last, F.sequence(first, last, F.lit(run).cast("bigint")))
    begun = df.withColumn("_last", last).withColumn("_run", F.explode(runs))
    numbers = F.sequence(F.col("_run"), F.least(F.col("_run") + (run - 1), F.col("_last")))
    return begun.withColumn(name, F.explode(numbers)).drop("_run", "_last")

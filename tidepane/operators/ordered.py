"""Order-dependent operators over groups of any size.

``row_number``, ``lag`` or a running maximum over ``partitionBy(topic)`` puts every row of a topic
into one task. That is right while topics are small, and it breaks once one topic holds a third of
the data. The operators here first measure the groups. If all fit, they use the plain window. If
not, a large group is cut into many blocks that follow each other in order; each block is processed
on its own, and a small per-block summary carries counts, maxima and last values over the block
borders. All ways give the same result.

Blocks are equal steps of the first order column, a plain expression that needs no shuffle. Where
that leaves a block too large (many rows at one instant), the rows are range-partitioned on the
whole order instead, which can split even those.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, TimestampNTZType, TimestampType

from tidepane.functions.timegrid import micros
from tidepane.operators.joins import attach
from tidepane.session import cut_lineage

# Rows one task may sort for one group before the group is cut into blocks.
MAX_GROUP_ROWS = 1_000_000
# Blocks are made smaller than that, so that they spread evenly over tasks.
BLOCKS_PER_LIMIT = 8
# Range partitions beyond this number cost more in shuffle bookkeeping than smaller sorts save; larger partitions are
# cut into blocks by position.
MAX_RANGE_PARTITIONS = 50_000
SALTS = 64

_BLOCK = "_block"


@dataclass(frozen=True)
class Blocks:
    """Rows with group keys ``by`` and total order ``order``; ``split`` when cut into blocks.

    ``sizes`` then holds the row count per group and block.
    """

    df: DataFrame
    by: tuple[str, ...]
    order: tuple[str, ...]
    sizes: DataFrame | None = None

    @property
    def split(self) -> bool:
        return self.sizes is not None

    @property
    def keys(self) -> list[str]:
        return [*self.by, _BLOCK] if self.split else list(self.by)

    def window(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def finish(self, df: DataFrame) -> DataFrame:
        return df.drop(_BLOCK)


def group_sizes(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """Row counts of the largest group and of all groups, counted before the shuffle."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    largest, total = counts.agg(F.max("n"), F.sum("n")).first()
    return largest or 0, total or 0


def to_blocks(
    df: DataFrame, by: Sequence[str], order: Sequence[str], max_group_rows: int | None = None
) -> Blocks:
    """Cut ``df`` into ordered blocks if some group is too large for one task.

    ``order`` must be a total order within a group (end it with a unique id), so that equal sort
    keys can be spread over several blocks too. One pass over the keys and the first order column measures all groups.
    """
    limit = MAX_GROUP_ROWS if max_group_rows is None else max_group_rows
    at = _position(df, order[0])
    place = F.lit(None).cast("double") if at is None else at
    figures = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.min(place).alias("_from"), F.max(place).alias("_to")
    )
    measured = cut_lineage(figures)  # a row per group
    span = F.col("_to") - F.col("_from")
    uneven = (F.col("_n") > limit) & ~F.coalesce((span > 0) & (span < float("inf")), F.lit(False))
    row = measured.agg(F.max("_n"), F.sum("_n"), F.coalesce(F.max(uneven), F.lit(False))).first()
    largest, total, uneven_found = row[0] or 0, row[1] or 0, row[2]
    if largest <= limit:
        return Blocks(df, tuple(by), tuple(order))
    cut = None if at is None or not by or uneven_found else _step_blocks(df, by, order, limit, at, measured)
    return cut or _range_blocks(df, by, order, limit, total)


def _position(df: DataFrame, column: str) -> Column | None:
    """The column as a number that grows with it, if it is a time or a number."""
    kind = df.schema[column].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return micros(column).cast("double")
    return F.col(column).cast("double") if isinstance(kind, NumericType) else None


def _step_blocks(
    df: DataFrame, by: Sequence[str], order: Sequence[str], limit: int, at: Column, measured: DataFrame
) -> Blocks | None:
    """Blocks of equal steps of the first order column; None if some block would be too large."""
    borders = (
        measured.filter(F.col("_n") > limit)
        .withColumn("_steps", F.ceil(F.col("_n") * BLOCKS_PER_LIMIT / limit))
        .select(*by, "_from", "_to", "_steps")
    )
    step = F.floor((at - F.col("_from")) / (F.col("_to") - F.col("_from")) * F.col("_steps"))
    # Small groups are one block; nulls sort first.
    block = F.when(F.col("_from").isNull(), F.lit(0)).otherwise(F.coalesce(step, F.lit(-1)))
    cut = attach(df, borders, by).withColumn(_BLOCK, block.cast("bigint")).select(*df.columns, _BLOCK)
    sizes = cut_lineage(cut.groupBy(*by, _BLOCK).agg(F.count(F.lit(1)).alias("_size")))
    if sizes.agg(F.max("_size")).first()[0] > limit:
        return None
    return Blocks(cut, tuple(by), tuple(order), sizes)


def _range_blocks(
    df: DataFrame, by: Sequence[str], order: Sequence[str], limit: int, total: int
) -> Blocks:
    """Blocks of at most ``limit`` rows: range partitions on group and whole order, cut by position inside."""
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(default, min(ceil(2 * total / limit), MAX_RANGE_PARTITIONS))
    ranged = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    # Spark's row ids hold the partition above bit 33 and count the sorted rows of a partition below it.
    row = F.monotonically_increasing_id()
    inside = F.floor(row.bitwiseAND(F.lit((1 << 33) - 1)) / limit)
    cut = ranged.withColumn(_BLOCK, F.shiftright(row, 33) * F.lit(1 << 33) + inside)
    # The checkpoint fixes block numbers: all uses below must see the same range borders.
    saved = cut_lineage(cut)
    sizes = saved.groupBy(*by, _BLOCK).agg(F.count(F.lit(1)).alias("_size"))
    return Blocks(saved, tuple(by), tuple(order), sizes)


def _earlier(blocks: Blocks):
    return Window.partitionBy(*blocks.by).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def ordinal_in(blocks: Blocks, name: str = "n") -> DataFrame:
    """1-based position of each row in its group."""
    numbered = blocks.df.withColumn(name, F.row_number().over(blocks.window()).cast("bigint"))
    if not blocks.split:
        return blocks.finish(numbered)
    offsets = blocks.sizes.withColumn("_before", F.sum("_size").over(_earlier(blocks)))
    joined = attach(numbered, offsets.drop("_size"), blocks.keys)
    joined = joined.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
    return blocks.finish(joined.drop("_before"))


def ordinal(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    name: str = "n",
    max_group_rows: int | None = None,
) -> DataFrame:
    """``row_number`` for groups of any size."""
    return ordinal_in(to_blocks(df, by, order, max_group_rows), name)


_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def running_in(
    blocks: Blocks, aggs: dict[str, tuple[str, str]], inclusive: bool = True
) -> DataFrame:
    """Running aggregates ``{name: ("sum" | "max" | "min", column)}`` up to (and with) each row.

    With ``inclusive=False`` the current row is left out, and the first row of a group gets null.
    """
    frame = blocks.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = blocks.df
    for name, (kind, column) in aggs.items():
        out = out.withColumn(name, _COMBINE[kind](column).over(frame))
    if not blocks.split:
        return blocks.finish(out)
    summary = blocks.df.groupBy(*blocks.keys).agg(
        *[_COMBINE[kind](column).alias(f"_t_{name}") for name, (kind, column) in aggs.items()]
    )
    for name, (kind, _) in aggs.items():
        summary = summary.withColumn(f"_p_{name}", _COMBINE[kind](f"_t_{name}").over(_earlier(blocks)))
    joined = attach(out, summary.drop(*[f"_t_{name}" for name in aggs]), blocks.keys)
    for name, (kind, _) in aggs.items():
        joined = joined.withColumn(name, _merge(kind, F.col(f"_p_{name}"), F.col(name)))
    return blocks.finish(joined.drop(*[f"_p_{name}" for name in aggs]))


def _merge(kind: str, a: Column, b: Column) -> Column:
    if kind == "max":
        return F.greatest(a, b)
    if kind == "min":
        return F.least(a, b)
    return F.coalesce(a + b, a, b)


def neighbour_in(blocks: Blocks, columns: dict[str, str], step: int = -1) -> DataFrame:
    """Value of the previous (``step=-1``) or next (``step=1``) row: ``{name: column}``."""
    pick = F.lag if step < 0 else F.lead
    out = blocks.df.withColumns({name: pick(col).over(blocks.window()) for name, col in columns.items()})
    if not blocks.split:
        return blocks.finish(out)
    position = F.struct(*blocks.order)
    edge = F.max_by if step < 0 else F.min_by
    summary = blocks.df.groupBy(*blocks.keys).agg(
        edge(F.struct(*dict.fromkeys(columns.values())), position).alias("_edge")
    )
    across = Window.partitionBy(*blocks.by).orderBy(_BLOCK)
    summary = summary.withColumn("_beyond", pick("_edge").over(across))
    out = out.withColumn("_at_edge", pick(F.lit(True)).over(blocks.window()).isNull())
    joined = attach(out, summary.drop("_edge"), blocks.keys)
    joined = joined.withColumns(
        {
            name: F.when(F.col("_at_edge"), F.col(f"_beyond.{col}")).otherwise(F.col(name))
            for name, col in columns.items()
        }
    )
    return blocks.finish(joined.drop("_at_edge", "_beyond"))


def trailing_frames(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    frames: dict[str, tuple[Column, int]],
    max_group_rows: int | None = None,
    chunk_rows: int = 1_000_000,
) -> DataFrame:
    """Aggregates over the last ``rows`` rows: ``{name: (aggregate, rows)}``; null until full.

    Large groups are cut into chunks by exact position; the last rows of a chunk are repeated at
    the head of the next one so that no frame is cut short.
    """
    halo = max(rows for _, rows in frames.values()) - 1
    blocks = to_blocks(df, by, order, max_group_rows)
    numbered = ordinal_in(blocks, "_n")
    if not blocks.split:
        keys, out = list(by), numbered
    else:
        chunk_rows = max(min(chunk_rows, max_group_rows or MAX_GROUP_ROWS), halo + 1)
        own = F.floor((F.col("_n") - 1) / chunk_rows)
        into_next = F.pmod(F.col("_n") - 1, F.lit(chunk_rows)) >= chunk_rows - halo
        out = numbered.withColumn("_own", own).withColumn(
            "_chunk", F.explode(F.when(into_next, F.array(own, own + 1)).otherwise(F.array(own)))
        )
        keys = [*by, "_chunk"]
    for name, (aggregate, rows) in frames.items():
        frame = Window.partitionBy(*keys).orderBy("_n").rowsBetween(-(rows - 1), 0)
        out = out.withColumn(name, F.when(F.col("_n") >= rows, aggregate.over(frame)))
    if "_chunk" in keys:
        out = out.filter(F.col("_chunk") == F.col("_own")).drop("_own", "_chunk")
    return out.drop("_n")


def first_n(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column | str],
    n: int,
    name: str = "n",
) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, numbered from 1.

    Spark keeps at most ``n`` rows per group in each map task (for an ``n`` up to its own threshold; beyond it, all
    rows of a group are spread over ``SALTS`` tasks). The kept rows of some tasks at a time are cut again before
    the whole group meets in one task, so at most ``SALTS * n`` rows arrive there, for any ``n``.
    Without group keys this is a plain top-n over the whole frame.
    """
    if not by:
        top = df.orderBy(*order).limit(n)
        return top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    inner = Window.partitionBy(*by, "_salt").orderBy(*order)
    outer = Window.partitionBy(*by).orderBy(*order)
    kept = salted.withColumn("_k", F.row_number().over(inner)).filter(F.col("_k") <= n)
    return (
        kept.drop("_k", "_salt")
        .withColumn(name, F.row_number().over(outer))
        .filter(F.col(name) <= n)
        .withColumn(name, F.col(name).cast("bigint"))
    )

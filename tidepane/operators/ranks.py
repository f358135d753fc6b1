"""Values at exact ranks of groups of any size, by narrowing histograms; nothing is sorted or saved but the histograms.

Each pass over the rows counts them in ``BINS`` steps of the range in which a wanted rank must lie, and keeps of that
range the one bin that holds the rank, cut to the least and the greatest value found in it. The range of a rank thus
shrinks to one value, which is a value of the data with its own bits. Rows are counted in the map tasks, so a hot group
sends a row per bin and task. Steps are equal in the values and in their logarithms by turns, so values of one size
and of many sizes both take three or four passes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepane.operators.joins import attach
from tidepane.session import cut_lineage

BINS = 4096
#: Added to logarithms, which lie above -1075, so that those of positive values are positive; places of infinity and NaN.
_SHIFT, _INFINITE, _NAN = 1080.0, 3000.0, 4000.0


def _spread(v: Column) -> Column:
    """A rising function of the value with finite results, in even steps of its size on both sides of 0."""
    size = F.least(F.log2(F.abs(v)) + _SHIFT, F.lit(_INFINITE))
    return F.when(F.isnan(v), F.lit(_NAN)).when(v == 0, F.lit(0.0)).when(v < 0, -size).otherwise(size)


def _bin(v: Column, low: Column, high: Column, by_size: bool) -> Column:
    """Rising step of ``v`` in ``[low, high]``; the ends lie in different steps unless sizes don't tell them apart."""
    wide = high - low
    plain = F.floor((v - low) / wide * BINS)
    sized = F.floor((_spread(v) - _spread(low)) / (_spread(high) - _spread(low)) * BINS)
    told_apart = _spread(high) > _spread(low)
    finite = (wide < float("inf")) & ~F.isnan(wide)
    step = F.when(told_apart & (~finite | F.lit(by_size)), sized).otherwise(plain)
    return F.least(step, F.lit(BINS - 1)).cast("int")


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, [left[c].eqNullSafe(right[f"_of_{c}"]) for c in columns])


def values_at(
    df: DataFrame, by: Sequence[str], value: str, ranks: Mapping[str, Callable[[Column], Column]]
) -> DataFrame:
    """``(*by, n, least, most, *ranks)``: for every group its size and the values at 0-based ranks.

    ``ranks`` are functions of the group's size; a rank outside of the group gives null. Values count as doubles,
    rows without one are left out.
    """
    if not by:
        raise ValueError("values_at needs at least one group column")
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    groups = cut_lineage(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most")))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), f(F.col("n")).cast("bigint").alias("rank")) for name, f in ranks.items()])
    search = groups.withColumn("_w", F.explode(wanted)).filter((F.col("_w.rank") >= 0) & (F.col("_w.rank") < F.col("n")))
    search = cut_lineage(
        search.select(*by, "_w.name", "_w.rank", F.col("least").alias("low"), F.col("most").alias("high"), F.lit(0).cast("bigint").alias("below"))
    )
    found, number = [], 0
    while True:
        done = F.col("low") == F.col("high")
        found.append(search.filter(done))
        search = search.filter(~done)
        if search.isEmpty():
            break
        search = cut_lineage(_narrowed(rows, by, search, by_size=number % 2 == 1))
        number += 1
    held = reduce(DataFrame.unionByName, found)
    values = held.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("low"))).alias(name) for name in ranks])
    values = values.select(*[F.col(c).alias(f"_of_{c}") for c in by], *ranks)
    return groups.join(values, _same(groups, values, by), "left").select(*by, "n", "least", "most", *ranks)


def _narrowed(rows: DataFrame, by: Sequence[str], search: DataFrame, by_size: bool) -> DataFrame:
    """``search`` with every range cut to the bin that holds its rank."""
    # the ranges of a group are equal or apart
    ranges = search.groupBy(*by).agg(F.collect_set(F.struct("low", "high")).alias("_ranges"))
    v = F.col("_v")
    met = attach(rows, ranges, by, "inner").withColumn(
        "_r", F.explode(F.filter("_ranges", lambda r: (r["low"] <= v) & (v <= r["high"])))
    )
    met = met.select(*by, "_v", F.col("_r.low").alias("low"), F.col("_r.high").alias("high"))
    keys = [*by, "low", "high"]
    bins = met.groupBy(*keys, _bin(v, F.col("low"), F.col("high"), by_size).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_bin"))  # no more than BINS rows
    bins = bins.withColumn("_upto", upto).select(*[F.col(c).alias(f"_of_{c}") for c in keys], "_c", "_upto", "_low", "_high")
    here = F.col("rank") - F.col("below")
    inside = (here >= F.col("_upto") - F.col("_c")) & (here < F.col("_upto"))
    return search.join(bins, _same(search, bins, keys) & inside).select(
        *by, "name", "rank", F.col("_low").alias("low"), F.col("_high").alias("high"), (F.col("below") + F.col("_upto") - F.col("_c")).alias("below")
    )


def interpolated(low: Column, high: Column, n: Column, q: float) -> Column:
    """Exact quantile between the values at the ranks around ``q * (n - 1)``."""
    position = F.lit(q) * (n - 1)
    fraction = position - F.floor(position)
    return low * (1 - fraction) + high * fraction


def quantiles(df: DataFrame, by: Sequence[str], value: str, qs: Mapping[str, float]) -> DataFrame:
    """``(*by, n, least, most, *qs)``: exact quantiles of every group with linear interpolation."""
    ends = {}
    for name, q in qs.items():
        ends[f"_{name}_low"] = lambda n, q=q: F.floor(F.lit(q) * (n - 1))
        ends[f"_{name}_high"] = lambda n, q=q: F.ceil(F.lit(q) * (n - 1))
    at = values_at(df, by, value, ends)
    return at.select(
        *by, "n", "least", "most",
        *[interpolated(F.col(f"_{name}_low"), F.col(f"_{name}_high"), F.col("n"), q).alias(name) for name, q in qs.items()],
    )

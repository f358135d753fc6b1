"""Compare result series: alignment, error metrics, winners, summaries and matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepane.functions.grades import accuracy_metrics as metric_columns
from tidepane.functions.grades import percentage_error
from tidepane.operators.joins import attach
from tidepane.operators.ordered import first_n, ordinal
from tidepane.operators.ranks import quantiles, values_at
from tidepane.session import cut_lineage


def align_by_ordinal(
    a: DataFrame,
    b: DataFrame,
    by: Sequence[str],
    order_a: Sequence[str],
    order_b: Sequence[str],
    value_a: str = "value",
    value_b: str = "value",
    max_group_rows: int | None = None,
) -> DataFrame:
    """Pair the n-th rows of two series; the longer one is cut: ``(*by, ord, truth, approx)``.

    Result series are small against the streams they come from, so each is computed once and saved
    before its groups are measured and numbered.
    """
    def numbered(df, order, value, name):
        series = cut_lineage(df.select(*by, *order, F.col(value).alias(name)))
        return ordinal(series, by, order, "ord", max_group_rows).select(*by, "ord", name)

    left = numbered(a, order_a, value_a, "truth")
    right = numbered(b, order_b, value_b, "approx")
    return left.join(right, [*by, "ord"])


def accuracy_metrics(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    return pairs.groupBy(*by).agg(*metric_columns("truth", "approx"))


def series_stats(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Count, mean, population deviation, extremes and exact median per series."""
    basic = df.groupBy(*by).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    return attach(basic, quantiles(df, by, value, {"median": 0.5}).select(*by, "median"), by)


def floor_rank_percentiles(
    df: DataFrame,
    by: Sequence[str],
    value: str = "value",
    qs: Sequence[tuple[str, float]] = (("median", 0.5), ("p95", 0.95), ("p99", 0.99)),
) -> DataFrame:
    """``sorted[floor(n * q)]``, with extremes, mean and count."""
    at = values_at(df, by, value, {name: lambda n, q=q: F.floor(n * F.lit(q)) for name, q in qs})
    means = df.groupBy(*by).agg(F.avg(value).alias("avg"))
    return attach(at, means, by).select(
        *by, F.col("least").alias("min"), F.col("most").alias("max"), "avg", *[name for name, _ in qs], F.col("n").alias("samples")
    )


def five_number(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Minimum, quartiles and maximum per group, quartiles interpolated."""
    at = quantiles(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return at.select(*by, F.col("least").alias("min"), "q1", "median", "q3", F.col("most").alias("max"))


def first_vs_average(pairs: DataFrame, by: Sequence[str], order: str = "ord") -> DataFrame:
    """Error of the first pair and mean error over all pairs, in percent, per pattern."""
    error = percentage_error("truth", "approx")
    return pairs.groupBy(*by).agg(
        F.min_by("approx", order).alias("first_approx"),
        F.min_by("truth", order).alias("first_truth"),
        F.min_by(error, F.col(order)).alias("first_error"),
        F.avg(error).alias("average_error"),
        F.count(F.lit(1)).alias("results"),
    )


def summary_by(df: DataFrame, dims: Sequence[str], metric: str = "accuracy") -> DataFrame:
    """Average, minimum, maximum and count of a metric for each of several groupings in one pass.

    ``grouping`` names the dimension a row summarises; the other dimensions are null.
    """
    # Sums per combination first: the copies for the groupings are made of a few rows.
    partial = df.groupBy(*dims).agg(
        F.sum(metric).alias("_s"), F.count(metric).alias("_n"), F.min(metric).alias("_lo"), F.max(metric).alias("_hi")
    )
    which = F.coalesce(*[F.when(F.grouping(d) == 0, d) for d in dims])
    return (
        partial.groupingSets([[d] for d in dims], *dims)
        .agg(
            which.alias("grouping"),
            F.try_divide(F.sum("_s"), F.sum("_n")).alias("avg"),
            F.min("_lo").alias("min"),
            F.max("_hi").alias("max"),
            F.sum("_n").alias("tests"),
        )
        .select("grouping", *dims, "avg", "min", "max", "tests")
    )


def band_distribution(df: DataFrame, band: Column, by: Sequence[str] = ()) -> DataFrame:
    """How many rows fall in each band."""
    return df.groupBy(*by, band.alias("band")).agg(F.count(F.lit(1)).alias("tests"))


def best_worst(
    df: DataFrame, metric: str, tie: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """The rows with the highest and the lowest metric; of equals the first by ``tie`` wins."""
    valid = df.filter(F.col(metric).isNotNull())
    row = F.struct(*df.columns)
    picked = valid.groupBy(*by).agg(
        F.min_by(row, F.struct((-F.col(metric)).alias("m"), *tie)).alias("best"),
        F.min_by(row, F.struct(F.col(metric).alias("m"), *tie)).alias("worst"),
    )
    both = F.array(
        F.struct(F.lit("best").alias("place"), F.col("best").alias("row")),
        F.struct(F.lit("worst").alias("place"), F.col("worst").alias("row")),
    )
    return picked.select(F.explode(both).alias("_p")).select("_p.place", "_p.row.*").filter(
        F.col(metric).isNotNull()
    )


def winners(df: DataFrame, approx_error: str = "approx_error", exact_error: str = "exact_error") -> DataFrame:
    """Which side is nearer to the expected value; a tie goes to the exact side."""
    return df.withColumn(
        "winner", F.when(F.col(approx_error) < F.col(exact_error), "Approximation").otherwise("Fetching")
    )


def win_counts(won: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Wins of each side overall and by each dimension."""
    partial = won.groupBy(*dims).agg(
        F.count_if(F.col("winner") == "Approximation").alias("_a"),
        F.count_if(F.col("winner") == "Fetching").alias("_f"),
    )
    which = F.coalesce(*[F.when(F.grouping(d) == 0, d) for d in dims], F.lit("overall"))
    return (
        partial.groupingSets([[], *[[d] for d in dims]], *dims)
        .agg(
            which.alias("grouping"),
            F.sum("_a").alias("approximation_wins"),
            F.sum("_f").alias("fetching_wins"),
            (F.sum("_a") + F.sum("_f")).alias("total"),
        )
        .select("grouping", *dims, "approximation_wins", "fetching_wins", "total")
    )


def risk_summary(df: DataFrame, risk: str = "risk") -> DataFrame:
    """Mean accuracy, mean MAPE and size of each risk group."""
    return df.groupBy(risk).agg(
        F.avg("accuracy").alias("mean_accuracy"),
        F.avg("mape").alias("mean_mape"),
        F.count(F.lit(1)).alias("tests"),
    )


def head_mean_truth(
    df: DataFrame, stream: str, order: Sequence[str], n: int = 240, value: str = "value"
) -> DataFrame:
    """Mean of the first ``n`` values of each stream, and the mean of those means."""
    heads = first_n(df, [stream], list(order), n, "_k").groupBy(stream).agg(
        F.avg(value).alias("stream_mean")
    )
    return heads.agg(F.avg("stream_mean").alias("truth"), F.count(F.lit(1)).alias("streams"))


def explode_result_lists(
    df: DataFrame, lists: str, keep: Sequence[str], delimiter: str = "|"
) -> DataFrame:
    """``a|b|c`` columns as one row per number; what is not a number is dropped."""
    parts = F.split(F.regexp_replace(lists, '"', ""), rf"\{delimiter}")
    numbers = F.transform(parts, lambda x: F.trim(x).try_cast("double"))
    kept = F.filter(numbers, lambda x: x.isNotNull() & ~F.isnan(x))
    return df.select(*keep, F.posexplode(kept).alias("pos", "result"))


def mean_positive(col: str) -> Column:
    """Mean over values above 0; 0 if there is none."""
    return F.coalesce(F.avg(F.when(F.col(col) > 0, F.col(col))), F.lit(0.0))


def threshold_counts(df: DataFrame, diff: str, by: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """How many differences are perfect (0.01), near perfect (0.1) and good (5), cumulatively."""
    d = F.col(diff)
    perfect = d < 0.01 if strict else d <= 0.01
    return df.groupBy(*by).agg(
        F.count(diff).alias("total"),
        F.count_if(perfect).alias("perfect"),
        F.count_if(d <= 0.1).alias("near_perfect"),
        F.count_if(d <= 5).alias("good"),
    )


def pivot_matrix(df: DataFrame, row: str, column: str, values: Sequence[str], metric: str) -> DataFrame:
    """Mean metric per row and column value; missing cells are 0."""
    matrix = df.groupBy(row).agg(
        *[F.avg(F.when(F.col(column) == v, F.col(metric))).alias(v) for v in values]
    )
    return matrix.fillna(0.0, subset=list(values))


def ordered_report(
    df: DataFrame, metric: str, tie: Sequence[str], descending: bool = False
) -> DataFrame:
    """Rows with the metric, sorted by it; ties by key."""
    first = F.desc(metric) if descending else F.asc(metric)
    return df.dropna(subset=[metric]).orderBy(first, *tie)


def run_summary(runs: DataFrame, by: Sequence[str] = ("pattern",)) -> DataFrame:
    """Runs, successes and failures per pattern, and which approach was faster by how much.

    ``runs`` has ``approach`` ("approximation" or "fetching"), ``success`` and ``duration_ms``;
    the slowest successful run of an approach counts.
    """
    def slowest(approach):
        mine = F.col("success") & (F.col("approach") == approach)
        return F.max(F.when(mine, F.col("duration_ms")))

    faster = F.col("approximation_ms") - F.col("fetching_ms")
    return (
        runs.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if("success").alias("succeeded"),
            F.count_if(~F.col("success")).alias("failed"),
            slowest("approximation").alias("approximation_ms"),
            slowest("fetching").alias("fetching_ms"),
        )
        .withColumn(
            "faster",
            F.when(faster > 0, "fetching").when(faster <= 0, "approximation"),
        )
        .withColumn("faster_by_ms", F.abs(faster))
    )

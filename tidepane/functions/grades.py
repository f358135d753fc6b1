"""Accuracy measures, bands and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def percentage_error(truth: str | Column, approx: str | Column) -> Column:
    """``|truth - approx| / |truth| * 100``; null where the truth is 0."""
    truth, approx = _col(truth), _col(approx)
    return F.when(truth != 0, F.abs((truth - approx) / truth) * 100)


def pair_accuracy(truth: str | Column, approx: str | Column) -> Column:
    """``100 - error %``, not below 0. For a truth of 0: 100 if both are 0, else 0."""
    truth, approx = _col(truth), _col(approx)
    return F.when(truth == 0, F.when(approx == 0, 100.0).otherwise(0.0)).otherwise(
        F.greatest(F.lit(0.0), 100 - percentage_error(truth, approx))
    )


def rel_diff(a: str | Column, b: str | Column, kind: str) -> Column:
    """Difference in percent, against the larger value (``max``) or the second one (``truth``)."""
    a, b = _col(a), _col(b)
    if kind == "max":
        base = F.greatest(a, b)
    elif kind == "truth":
        base = F.abs(b)
    else:
        raise ValueError("kind must be 'max' or 'truth'")
    return F.try_divide(F.abs(a - b), base) * 100


# --- aggregates over (truth, approx) pairs ---------------------------------------------------


def mape(truth: str, approx: str, zero: str = "skip") -> Column:
    """Mean absolute percentage error.

    Zero truths add nothing; ``skip`` leaves them out of the divisor too, ``count`` does not.
    """
    error = percentage_error(truth, approx)
    if zero == "skip":
        return F.avg(error)
    if zero == "count":
        return F.try_divide(F.coalesce(F.sum(error), F.lit(0.0)), F.count(F.lit(1)))
    raise ValueError("zero must be 'skip' or 'count'")


def mae(truth: str, approx: str) -> Column:
    return F.avg(F.abs(F.col(truth) - F.col(approx)))


def rmse(truth: str, approx: str) -> Column:
    return F.sqrt(F.avg(F.pow(F.col(truth) - F.col(approx), 2)))


def pearson(truth: str, approx: str) -> Column:
    """Correlation; null if one side does not vary."""
    both = F.col(truth).isNotNull() & F.col(approx).isNotNull()
    spread = F.var_pop(F.when(both, F.col(truth))) * F.var_pop(F.when(both, F.col(approx)))
    return F.when(spread > 0, F.corr(truth, approx))


def percentage_accuracy(truth: str, approx: str) -> Column:
    """Mean of ``1 - |error|``, in percent."""
    return F.avg(100 - percentage_error(truth, approx))


def accuracy_metrics(truth: str, approx: str) -> list[Column]:
    """MAE, RMSE, MAPE and accuracy over pairs with a truth other than 0, and the counts."""
    valid = F.col(truth) != 0
    gap = F.when(valid, F.col(truth) - F.col(approx))
    error = F.avg(percentage_error(truth, approx))
    return [
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        error.alias("mape"),
        F.greatest(F.lit(0.0), 100 - error).alias("accuracy"),
        F.count(gap).alias("data_points"),
        F.count(truth).alias("truth_count"),
        F.count(approx).alias("approx_count"),
    ]


# --- bands and labels ------------------------------------------------------------------------


def accuracy_band(accuracy: str | Column) -> Column:
    a = _col(accuracy)
    return (
        F.when(a >= 95, "Excellent").when(a >= 90, "Good").when(a >= 80, "Acceptable").when(a < 80, "Poor")
    )


def mape_grade(error: str | Column) -> Column:
    e = _col(error)
    return F.when(e > 10, "Poor").when(e > 5, "Fair").when(e > 1, "Good").when(e <= 1, "Excellent")


def approximation_quality(accuracy: str | Column) -> Column:
    a = _col(accuracy)
    return (
        F.when(a > 95, "Excellent approx")
        .when(a > 85, "Good approx")
        .when(a > 70, "Fair approx")
        .when(a <= 70, "Poor approx")
    )


def better_side(approx_accuracy: str | Column, exact_accuracy: str | Column) -> Column:
    diff = _col(exact_accuracy) - _col(approx_accuracy)
    return (
        F.when(F.abs(diff) < 1, "Similar")
        .when(diff > 0, "Fetching better")
        .when(diff <= 0, "Approximation better")
    )


def trend_label(slope: str | Column) -> Column:
    s = _col(slope)
    return (
        F.when(s.isNull(), "Insufficient data")
        .when(s > 1, "Strong positive trend")
        .when(s > 0.1, "Positive trend")
        .when(s > -0.1, "Stable")
        .when(s > -1, "Negative trend")
        .otherwise("Strong negative trend")
    )


def impact_band(percent_change: str | Column) -> Column:
    size = F.abs(_col(percent_change))
    return F.when(size < 5, "Low impact").when(size < 20, "Medium impact").when(size >= 20, "High impact")


def pattern_type(pattern: str | Column) -> Column:
    return F.when(_col(pattern).startswith("challenging"), "Challenging").otherwise("Favorable")


def nyquist_ratio(frequency: str | Column, sampling_hz: float | Column = 4.0) -> Column:
    """Signal frequency against half the sampling rate."""
    sampling = F.lit(sampling_hz) if isinstance(sampling_hz, (int, float)) else sampling_hz
    return _col(frequency) / (sampling / 2)


def aliasing_risk(ratio: str | Column, variant: int = 1) -> Column:
    r = _col(ratio)
    if variant == 1:
        return F.when(r <= 0.5, "Low").when(r <= 0.75, "Medium").when(r > 0.75, "High")
    if variant == 2:
        return F.when(r > 0.8, "High").when(r > 0.5, "Medium").when(r <= 0.5, "Low")
    raise ValueError("variant must be 1 or 2")


def frequency_label(frequency: str | Column) -> Column:
    f = _col(frequency)
    return (
        F.when(f <= 0.1, "Low frequency")
        .when(f <= 0.5, "Medium-low frequency")
        .when(f <= 1.0, "Medium frequency")
        .when(f <= 1.5, "High frequency")
        .when(f > 1.5, "Near Nyquist frequency")
    )


def closed_form_truth(pattern: str, rate: str, elapsed_s: str | Column, period_s: float = 120.0) -> Column:
    """``exp(±rate * elapsed / period)`` for growth and decay patterns, null for others."""
    x = F.col(rate) * _col(elapsed_s) / period_s
    return F.when(F.col(pattern).endswith("exponential_growth"), F.exp(x)).when(
        F.col(pattern).endswith("exponential_decay"), F.exp(-x)
    )


def bytes_to_mb(size: str | Column) -> Column:
    return _col(size) / F.lit(1024.0 * 1024.0)
